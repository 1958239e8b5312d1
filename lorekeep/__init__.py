"""Personal-knowledge analytics on Spark DataFrames."""
