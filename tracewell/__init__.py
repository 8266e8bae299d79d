"""tracewell: evidence and provenance analytics as Spark DataFrame jobs."""
