"""quarry: knowledge indexing, retrieval and query analytics on Spark DataFrames."""
