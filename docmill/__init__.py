"""Document search, aggregation and corpus preparation on Spark DataFrames."""
