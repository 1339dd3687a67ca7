"""partwise: part-of-whole analytics as Spark DataFrame operators."""
