"""gitstrata: repository analytics as Spark DataFrame operators."""
