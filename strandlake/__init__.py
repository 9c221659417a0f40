"""strandlake: a Spark-first engine for sequence analytics and training-data preparation."""
