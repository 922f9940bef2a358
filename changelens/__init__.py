"""Change-set analytics on Spark: every function maps DataFrames to DataFrames."""
