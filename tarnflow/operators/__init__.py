"""Table-agnostic operators: DataFrames in, DataFrames out."""
