"""Reconciling a source library with a target catalog, on Spark DataFrames."""
