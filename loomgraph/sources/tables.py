"""A hypergraph as a folder of three Parquet tables."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import SparkSession

if TYPE_CHECKING:
    from loomgraph.graph import Hypergraph


def write(graph: Hypergraph, path: str, *, buckets: int | None = None) -> None:
    """``buckets`` deals incidences by hyperedge, so that later scans of one hyperedge read one file."""
    graph.vertex_frame.write.mode("overwrite").parquet(f"{path}/vertices")
    graph.hyperedge_frame.write.mode("overwrite").parquet(f"{path}/hyperedges")
    incidence = graph.incidence
    if buckets:
        incidence = incidence.repartition(buckets, "hyperedge_id").sortWithinPartitions("hyperedge_id", "pos")
    incidence.write.mode("overwrite").parquet(f"{path}/incidence")


def read(spark: SparkSession, path: str) -> Hypergraph:
    from loomgraph.graph import Hypergraph
    from loomgraph.operators.projections import Frames

    return Hypergraph(spark, Frames(*(spark.read.parquet(f"{path}/{t}") for t in ("vertices", "hyperedges", "incidence"))))
