"""Embedding analytics on Spark DataFrames."""
