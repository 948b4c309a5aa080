"""Column-to-column functions; all of them are native Spark expressions."""
