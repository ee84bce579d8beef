"""tidemark: point-in-time analytics expressed as Spark DataFrame plans."""
