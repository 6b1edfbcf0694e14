"""Find, repair and explain data problems in ML data preparation, as Spark DataFrame operators."""
