"""DNS traffic analytics expressed as Spark DataFrame programs."""
