"""Page-corpus extraction expressed as Spark DataFrame jobs."""
