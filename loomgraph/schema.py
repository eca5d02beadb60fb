"""Schemas of the three frames that hold a hypergraph.

``incidence`` is the ordered list of each hyperedge, one row a position, positions dense from 0. ``data`` is a payload
that operators copy and never read; any type will do, JSON text is the default.
"""

from pyspark.sql import types as T

VERTICES = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("data", T.StringType())])
HYPEREDGES = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("weight", T.LongType(), False), T.StructField("data", T.StringType())])
INCIDENCE = T.StructType([T.StructField("hyperedge_id", T.LongType(), False), T.StructField("pos", T.LongType(), False), T.StructField("vertex_id", T.LongType(), False)])
