"""Document-derived knowledge graphs as Spark jobs."""
