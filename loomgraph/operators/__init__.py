"""Operators over whole hypergraphs: DataFrames in, one lazy DataFrame out."""
