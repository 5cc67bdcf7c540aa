"""Sparse linear algebra on Spark DataFrames."""
