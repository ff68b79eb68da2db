"""Harmonising noisy coded records on Spark: cleaning, matching, sampling, encoding and evaluation as DataFrame operations."""
