"""Column expressions whose meaning differs from Spark's own."""
