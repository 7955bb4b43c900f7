"""lodestone: evidence retrieval and data audit as Spark DataFrame plans."""
