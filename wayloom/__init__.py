"""Street-network access analytics as Spark jobs."""
