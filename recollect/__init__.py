"""Memory analytics on Spark: retrieval, graph, lifecycle and streaming operators as DataFrame code."""
