"""Record search, comparison and corpus preparation on Spark DataFrames."""
