"""tidemark: point-in-time market research and corpus processing as Spark DataFrame jobs."""
