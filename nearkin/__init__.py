"""Identity search over labelled embedding vectors, as Spark DataFrame jobs."""
