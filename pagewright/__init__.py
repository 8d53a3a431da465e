"""Document analytics on Spark: structure, metadata, chunks, search, retrieval, citations, evaluation."""
