"""The derived frames that every operator reads: ordered incidences, distinct members, consecutive pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Positions that one window group holds, so that a long hyperedge is cut over many tasks.
BLOCK = 4096


def incidence_from_table(df: DataFrame, edge: str, vertex: str, order: list[str], pos: str | None = None) -> DataFrame:
    """(hyperedge_id, pos, vertex_id) of a table with a row for each position, ordered by ``order``, or by ``pos`` if
    the table has dense positions from 0 already, which costs no shuffle."""
    ids = [F.col(edge).cast("long").alias("hyperedge_id"), F.col(vertex).cast("long").alias("vertex_id")]
    if pos is not None:
        return df.select(*ids, F.col(pos).cast("long").alias("pos")).select("hyperedge_id", "pos", "vertex_id")
    # partitioned by the new name, so that windows over hyperedge_id that follow need no exchange of their own
    named = df.select(*ids, *(F.col(c).alias(f"_order{k}") for k, c in enumerate(order)))
    place = F.row_number().over(Window.partitionBy("hyperedge_id").orderBy(*(f"_order{k}" for k in range(len(order))))).cast("long") - 1
    return named.select("hyperedge_id", place.alias("pos"), "vertex_id")


def incidence_from_arrays(df: DataFrame, edge: str = "id", members: str = "members") -> DataFrame:
    """The same of a table with a row for each hyperedge and its vertices as an array."""
    return df.select(F.col(edge).cast("long").alias("hyperedge_id"), F.posexplode(members).alias("pos", "vertex_id")).select("hyperedge_id", F.col("pos").cast("long").alias("pos"), F.col("vertex_id").cast("long").alias("vertex_id"))


def members_of(incidence: DataFrame) -> DataFrame:
    """(hyperedge_id, vertex_id, first_pos, times): each hyperedge as a set."""
    return incidence.groupBy("hyperedge_id", "vertex_id").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("times"))


def pairs_of(incidence: DataFrame) -> DataFrame:
    """(hyperedge_id, pos, src, dst): consecutive pairs, the directed multigraph. ``pos`` is that of ``src``.

    One shuffle: positions go in blocks, and the first row of a block also closes the block before it.
    """
    block = F.expr(f"pos div {BLOCK}")
    blocks = F.when((F.col("pos") % BLOCK == 0) & (F.col("pos") > 0), F.array(block, block - 1)).otherwise(F.array(block))
    dealt = incidence.select("hyperedge_id", "pos", F.col("vertex_id").alias("src"), F.explode(blocks).alias("block"))
    after = F.lead("src").over(Window.partitionBy("hyperedge_id", "block").orderBy("pos"))
    return dealt.withColumn("dst", after).where("dst is not null").select("hyperedge_id", "pos", "src", "dst")


def pairs_from_arrays(df: DataFrame, edge: str = "id", members: str = "members") -> DataFrame:
    """The same of a table with a row for each hyperedge and its vertices as an array, without a shuffle."""
    two = F.transform(F.slice(members, 1, F.greatest(F.size(members) - 1, F.lit(0))), lambda v, i: F.struct(v.cast("long").alias("src"), F.element_at(members, i + 2).cast("long").alias("dst")))
    each = df.select(F.col(edge).cast("long").alias("hyperedge_id"), F.posexplode(two).alias("pos", "pair"))
    return each.select("hyperedge_id", F.col("pos").cast("long").alias("pos"), "pair.src", "pair.dst")


def sizes_of(incidence: DataFrame) -> DataFrame:
    """(hyperedge_id, length, size) of hyperedges that aren't empty: with and without repeats."""
    return members_of(incidence).groupBy("hyperedge_id").agg(F.sum("times").alias("length"), F.count(F.lit(1)).alias("size"))


def arrays_of(incidence: DataFrame) -> DataFrame:
    """(hyperedge_id, members array<long>): ordered lists, for hyperedges that fit in a row."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "vertex_id")))
    return incidence.groupBy("hyperedge_id").agg(F.transform(listed, lambda x: x["vertex_id"]).alias("members"))


def reranked(incidence: DataFrame) -> DataFrame:
    """Positions made dense again after rows were taken out, in their order."""
    place = F.row_number().over(Window.partitionBy("hyperedge_id").orderBy("pos")).cast("long") - 1
    return incidence.select("hyperedge_id", place.alias("pos"), "vertex_id")
