"""Security log analytics on Spark DataFrames."""
