"""Where citation tables come from: files and catalog tables, relational databases, TPC-H shapes."""
