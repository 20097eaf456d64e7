"""Assessment analytics as Spark DataFrame operators."""
