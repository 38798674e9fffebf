"""Source-code facts and corpus analytics as Spark DataFrame jobs."""
