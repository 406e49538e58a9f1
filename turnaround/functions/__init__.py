"""Column functions built from Spark built-ins."""
