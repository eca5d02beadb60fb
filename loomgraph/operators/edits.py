"""Edits of ordered lists as expressions over incidences. Only the hyperedges touched are ranked anew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.frames import reranked


def _rows(df: DataFrame, hyperedge_id: int, vertex_ids: Sequence[int], first: int) -> DataFrame:
    return df.sparkSession.createDataFrame([(int(hyperedge_id), first + k, int(v)) for k, v in enumerate(vertex_ids)], "hyperedge_id long, pos long, vertex_id long")


def insert(incidence: DataFrame, hyperedge_id: int, vertex_ids: Sequence[int], index: int) -> DataFrame:
    """Vertices put in before position ``index``."""
    later = (F.col("hyperedge_id") == hyperedge_id) & (F.col("pos") >= index)
    moved = incidence.withColumn("pos", F.when(later, F.col("pos") + len(vertex_ids)).otherwise(F.col("pos")))
    return moved.unionByName(_rows(incidence, hyperedge_id, vertex_ids, index))


def _split_touched(incidence: DataFrame, touched: DataFrame) -> tuple[DataFrame, DataFrame]:
    return incidence.join(touched, "hyperedge_id", "left_semi"), incidence.join(touched, "hyperedge_id", "left_anti")


def remove(incidence: DataFrame, rows: Column) -> DataFrame:
    """Without the rows that the condition holds for."""
    touched, rest = _split_touched(incidence, incidence.where(rows).select("hyperedge_id").distinct())
    return rest.unionByName(reranked(touched.where(~rows)))


def without_vertices(incidence: DataFrame, vertices: DataFrame) -> DataFrame:
    """Without all places of ``vertices`` (vertex_id)."""
    hit = incidence.join(vertices, "vertex_id", "left_semi").select("hyperedge_id").distinct()
    touched, rest = _split_touched(incidence, hit)
    return rest.unionByName(reranked(touched.join(vertices, "vertex_id", "left_anti")))


def reverse(incidence: DataFrame, hyperedge_id: int, length: int) -> DataFrame:
    here = F.col("hyperedge_id") == hyperedge_id
    return incidence.withColumn("pos", F.when(here, F.lit(length - 1) - F.col("pos")).otherwise(F.col("pos")))


def reverse_all(incidence: DataFrame) -> DataFrame:
    """Every hyperedge reversed."""
    lengths = incidence.groupBy("hyperedge_id").agg(F.max("pos").alias("last"))
    return incidence.join(lengths, "hyperedge_id").select("hyperedge_id", (F.col("last") - F.col("pos")).alias("pos"), "vertex_id")


def merge(incidence: DataFrame, ids: Sequence[int], lengths: Sequence[int]) -> DataFrame:
    """Hyperedges ``ids`` in turn as the first of them."""
    pos, before = F.col("pos"), 0
    for i, n in zip(ids, lengths):
        pos = F.when(F.col("hyperedge_id") == i, F.col("pos") + before).otherwise(pos)
        before += n
    first = F.when(F.col("hyperedge_id").isin(list(ids)), F.lit(ids[0]).cast("long")).otherwise(F.col("hyperedge_id"))
    return incidence.select(first.alias("hyperedge_id"), pos.alias("pos"), "vertex_id")


def split(incidence: DataFrame, hyperedge_id: int, at: int, new_id: int) -> DataFrame:
    tail = (F.col("hyperedge_id") == hyperedge_id) & (F.col("pos") >= at)
    return incidence.select(F.when(tail, F.lit(new_id).cast("long")).otherwise(F.col("hyperedge_id")).alias("hyperedge_id"), F.when(tail, F.col("pos") - at).otherwise(F.col("pos")).alias("pos"), "vertex_id")


def _collapsed(rows: DataFrame, vertex_id: int) -> DataFrame:
    """Runs of one vertex as one place, positions dense again."""
    before = F.lag("vertex_id").over(Window.partitionBy("hyperedge_id").orderBy("pos"))
    kept = rows.withColumn("_before", before).where(~((F.col("vertex_id") == vertex_id) & F.col("_before").eqNullSafe(F.lit(vertex_id))))
    return reranked(kept.drop("_before"))


def replace(incidence: DataFrame, rows: Column, vertex_id: int) -> DataFrame:
    """``vertex_id`` in the rows that the condition holds for; in the hyperedges touched its runs become one place."""
    touched, rest = _split_touched(incidence, incidence.where(rows).select("hyperedge_id").distinct())
    new = touched.withColumn("vertex_id", F.when(rows, F.lit(vertex_id).cast("long")).otherwise(F.col("vertex_id")))
    return rest.unionByName(_collapsed(new, vertex_id))


def contract(incidence: DataFrame, pairs: DataFrame, hyperedge_id: int, last: int) -> DataFrame:
    """Members of a hyperedge give way to ``last`` in each hyperedge where a pair ends at them, at all their places
    there; runs of ``last`` that this makes become one. The hyperedge itself goes."""
    members = incidence.where(F.col("hyperedge_id") == hyperedge_id).select("vertex_id").distinct()
    others = incidence.where(F.col("hyperedge_id") != hyperedge_id)
    hit = pairs.where(F.col("hyperedge_id") != hyperedge_id).join(members.withColumnRenamed("vertex_id", "dst"), "dst", "left_semi").select("hyperedge_id", F.col("dst").alias("vertex_id")).distinct().withColumn("_hit", F.lit(True))
    touched, rest = _split_touched(others, hit.select("hyperedge_id").distinct())
    new = touched.join(hit, ["hyperedge_id", "vertex_id"], "left").select("hyperedge_id", "pos", F.when(F.col("_hit"), F.lit(last).cast("long")).otherwise(F.col("vertex_id")).alias("vertex_id"))
    return rest.unionByName(_collapsed(new, last))
