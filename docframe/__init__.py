"""Document analytics as Spark jobs."""
