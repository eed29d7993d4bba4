"""Vector compression and similarity search on Spark DataFrames."""
