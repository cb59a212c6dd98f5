"""Column functions: pure expressions, and Arrow UDFs where Spark has no built-in."""
