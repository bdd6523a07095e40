"""Feedback analytics on Spark: DataFrame jobs, one module for each kind of work."""
