"""Orrerix: ranking, graph patterns, similarity and incremental prediction on Spark DataFrames."""
