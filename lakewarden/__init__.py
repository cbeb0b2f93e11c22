"""Financial-crime analytics as declarative Spark DataFrame operators."""
