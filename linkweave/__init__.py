"""linkweave: record linkage and deduplication on Spark DataFrames."""
