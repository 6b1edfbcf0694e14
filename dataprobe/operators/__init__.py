"""Table operators: DataFrames keyed by an explicit id in, DataFrames out."""
