"""Batch and streaming catalog jobs on Spark DataFrames."""
