"""siltstone: configuration review and finding analytics on Spark DataFrames."""
