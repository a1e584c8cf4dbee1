"""Document analytics on Spark: text, retrieval, graphs, glossaries, streams and evaluation as DataFrame jobs."""
