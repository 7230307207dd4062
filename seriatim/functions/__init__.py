"""Column-to-column expressions over Spark built-ins."""
