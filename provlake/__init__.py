"""Document retrieval, chunking and evaluation operators over Spark DataFrames."""
