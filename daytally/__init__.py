"""Daily retail sales analytics on Spark DataFrames."""
