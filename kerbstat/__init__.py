"""Citation analytics as Spark jobs: scans, statistics, summary views, features, models, metrics."""
