"""Table operators: scans, statistics, features, vocabularies, splits, metrics."""
