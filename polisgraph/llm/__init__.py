"""Operators for large-scale training-data preparation, all running as Spark jobs."""
