"""Document-retrieval analytics and training-data preparation as Spark jobs."""
