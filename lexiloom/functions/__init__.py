"""Text functions as Spark columns."""
