"""Care demand and capacity analytics as Spark DataFrame operators."""
