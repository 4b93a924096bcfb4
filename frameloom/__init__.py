"""Media-operations analytics as Spark DataFrame, SQL and streaming jobs."""
