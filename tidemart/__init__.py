"""A real-time commerce warehouse expressed as Spark DataFrame jobs."""
