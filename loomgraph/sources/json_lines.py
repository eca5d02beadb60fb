"""Bulk ingestion of JSON lines."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.projections import Frames
from loomgraph.plans.tables import numbered

if TYPE_CHECKING:
    from loomgraph.graph import Hypergraph


def read(spark: SparkSession, vertices: str, hyperedges: str) -> Hypergraph:
    """Lines are numbered by file and byte order within it, without a task that sees them all."""
    from loomgraph.graph import Hypergraph

    def lines(path: str, first: int):
        text = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("place"))
        return numbered(text, "file", "place", name="id", first=first)

    v = lines(vertices, 1)
    n = v.count()
    h = lines(hyperedges, n + 1).select("id", "value", F.from_json("value", "members array<long>, weight long").alias("j"))
    incidence = h.select(F.col("id").alias("hyperedge_id"), F.posexplode("j.members").alias("pos", "line")).select("hyperedge_id", F.col("pos").cast("long").alias("pos"), (F.col("line") + 1).alias("vertex_id"))
    edges = h.select("id", F.coalesce("j.weight", F.lit(1)).cast("long").alias("weight"), F.col("value").alias("data"))
    return Hypergraph(spark, Frames(v.select("id", F.col("value").alias("data")), edges, incidence))
