"""Site and search analytics as Spark DataFrame plans."""
