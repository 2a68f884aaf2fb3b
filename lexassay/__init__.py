"""lexassay: text-quality checks and corpus operators on Spark DataFrames."""
