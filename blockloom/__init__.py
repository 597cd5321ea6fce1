"""Block-transform image analytics on Spark DataFrames."""
