"""Sales analytics expressed as Spark DataFrame jobs."""
