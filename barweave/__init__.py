"""Price-bar analytics as Spark DataFrame operators."""
