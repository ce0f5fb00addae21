"""Job-posting pipelines as Spark jobs."""
