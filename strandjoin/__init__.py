"""Paired-read merging on Spark."""
