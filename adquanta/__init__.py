"""Campaign and ad-event analytics as PySpark DataFrame operations."""
