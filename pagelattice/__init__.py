"""Document-extraction analytics expressed as Spark DataFrame plans."""
