"""tidemark: timeline analytics expressed as Spark DataFrame jobs."""
