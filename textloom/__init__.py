"""Text-chunk, retrieval and evaluation analytics as Spark DataFrame plans."""
