"""Inclusion between hyperedges as sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.tables import joined, largest_key, parts_of, stored


def inclusions(members: DataFrame) -> DataFrame:
    """(subset, superset) of all pairs of hyperedges of which one set holds the other and more. Empty ones don't count.

    A superset holds the subset's rarest member, so candidates meet on that member only. A word of 64 bits, which has
    one set for each member, tells most of them apart there; the members of those left are counted, but for sets of one.
    """
    rows = stored(members.select("hyperedge_id", "vertex_id"), "members")
    most = largest_key(rows, "vertex_id", "hyperedge_id")
    bit = F.expr("shiftleft(1L, cast(pmod(xxhash64(vertex_id), 64) as int))")
    sets = rows.groupBy("hyperedge_id").agg(F.count(F.lit(1)).alias("size"), F.bit_or(bit).alias("bits"))
    degree = rows.groupBy("vertex_id").agg(F.count(F.lit(1)).alias("degree"))
    rarest = joined(rows, degree, "vertex_id", ["hyperedge_id"], most).groupBy("hyperedge_id").agg(F.min(F.struct("degree", "vertex_id"))["vertex_id"].alias("vertex_id"))
    subset = sets.join(rarest, "hyperedge_id").select(F.col("hyperedge_id").alias("subset"), F.col("size").alias("n"), "vertex_id", F.col("bits").alias("own"))
    larger = joined(rows, sets, "hyperedge_id", ["vertex_id"], most).where("size > 1").select(F.col("hyperedge_id").alias("superset"), "vertex_id", "size", "bits")
    parts = parts_of(rows)
    candidates = subset.repartition(parts, "vertex_id").join(larger.repartition(parts, "vertex_id"), "vertex_id").where("size > n and (own & ~bits) = 0")
    candidates = stored(candidates.select("subset", "superset", "n"), "candidates")
    own = rows.select(F.col("hyperedge_id").alias("subset"), "vertex_id")
    other = rows.select(F.col("hyperedge_id").alias("superset"), "vertex_id")
    shared = candidates.where("n > 1").join(own, "subset").join(other, ["superset", "vertex_id"])
    several = shared.groupBy("subset", "superset", "n").agg(F.count(F.lit(1)).alias("k")).where("k = n").select("subset", "superset")
    return candidates.where("n = 1").select("subset", "superset").unionByName(several)


def nestedness(members: DataFrame) -> DataFrame:
    """(size, included, total): of the hyperedges of each set size, how many there are and how many lie in another."""
    sizes = members.groupBy("hyperedge_id").agg(F.count(F.lit(1)).alias("size"))
    inside = inclusions(members).select(F.col("subset").alias("hyperedge_id")).distinct().withColumn("inside", F.lit(1))
    both = sizes.join(inside, "hyperedge_id", "left")
    return both.groupBy("size").agg(F.count("inside").alias("included"), F.count(F.lit(1)).alias("total"))
