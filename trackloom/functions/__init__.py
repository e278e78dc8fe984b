"""Column functions: everything here is built from Spark's own expressions."""
