"""Column-to-column functions. All are built-in Spark expressions; there is no Python UDF."""
