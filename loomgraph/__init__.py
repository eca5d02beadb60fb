"""Directed-hypergraph analytics on PySpark DataFrames."""
