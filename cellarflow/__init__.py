"""cellarflow: retrieval, entity-resolution and ranking analytics on Spark DataFrames."""
