"""Process analytics for run logs on Spark: DataFrames in, DataFrames out."""
