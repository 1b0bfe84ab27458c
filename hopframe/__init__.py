"""hopframe: multi-hop question answering data and retrieval on Spark DataFrames."""
