"""tidemark: risk, regime and training-data analytics expressed as Spark DataFrame jobs."""
