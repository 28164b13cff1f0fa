"""Consumer and operations analytics as Spark DataFrame operators."""
