"""Incidence matrix and Laplacians, sparse and in long form; dense rows on request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.tables import numbered


def incidence_coo(vertices: DataFrame, hyperedges: DataFrame, members: DataFrame) -> DataFrame:
    """(row, col, vertex_id, hyperedge_id) of the ones; row and col count vertices and hyperedges from 0 by id."""
    rows = numbered(vertices.select(F.col("id").alias("vertex_id")), "vertex_id", name="row")
    cols = numbered(hyperedges.select(F.col("id").alias("hyperedge_id")), "hyperedge_id", name="col")
    return members.select("hyperedge_id", "vertex_id").join(rows, "vertex_id").join(cols, "hyperedge_id").select("row", "col", "vertex_id", "hyperedge_id")


def incidence_rows(vertices: DataFrame, hyperedges: DataFrame, members: DataFrame) -> DataFrame:
    """(row, vertex_id, ones): the matrix by rows, each as the sorted columns of its ones."""
    coo = incidence_coo(vertices, hyperedges, members)
    lists = coo.groupBy("vertex_id").agg(F.array_sort(F.collect_list("col")).alias("ones"))
    rows = numbered(vertices.select(F.col("id").alias("vertex_id")), "vertex_id", name="row")
    return rows.join(lists, "vertex_id", "left").select("row", "vertex_id", F.coalesce("ones", F.array().cast("array<long>")).alias("ones"))


def laplacian(vertices: DataFrame, hyperedges: DataFrame, members: DataFrame, *, normalized: bool = True) -> DataFrame:
    """(row_id, col_id, value) of the entries that aren't zero by construction, the diagonal always.

    Unnormalized: D_v - H W D_e^-1 H^T. Normalized: I - D_v^-1/2 H W D_e^-1 H^T D_v^-1/2; a vertex of degree 0 has its
    1. D_v holds the vertices' sums of hyperedge weights, D_e the distinct sizes.
    """
    size = members.groupBy("hyperedge_id").agg(F.count(F.lit(1)).alias("size"))
    share = size.join(hyperedges.select(F.col("id").alias("hyperedge_id"), "weight"), "hyperedge_id").select("hyperedge_id", "weight", (F.col("weight") / F.col("size")).alias("share"))
    weighted = members.select("hyperedge_id", "vertex_id").join(share, "hyperedge_id")
    sums = weighted.groupBy("vertex_id").agg(F.sum("weight").alias("d"))
    degree = vertices.select(F.col("id").alias("vertex_id")).join(sums, "vertex_id", "left").withColumn("d", F.coalesce("d", F.lit(0)).cast("double"))
    # each member brings its factor, so that no pair is joined with it
    inverse = degree.where("d > 0").select("vertex_id", (1 / F.sqrt("d")).alias("i"))
    named = weighted.join(inverse, "vertex_id") if normalized else weighted.withColumn("i", F.lit(1.0))
    a = named.select("hyperedge_id", F.col("vertex_id").alias("row_id"), "share", F.col("i").alias("p"))
    b = named.select("hyperedge_id", F.col("vertex_id").alias("col_id"), F.col("i").alias("q"))
    # both matrices are symmetric: pairs go once, and are turned as they are read
    none = F.lit(None).cast("double")
    both = a.join(b, "hyperedge_id").where("row_id <= col_id").select("row_id", "col_id", "share", "p", "q", none.alias("own"))
    diagonal = degree.select(F.col("vertex_id").alias("row_id"), F.col("vertex_id").alias("col_id"), none.alias("share"), none.alias("p"), none.alias("q"), (F.lit(1.0) if normalized else F.col("d")).alias("own"))
    sums = diagonal.unionByName(both).groupBy("row_id", "col_id")
    half = sums.agg(F.sum("share").alias("s"), F.max("p").alias("p"), F.max("q").alias("q"), F.sum("own").alias("own"))

    def entry(row: str, col: str, p: str, q: str) -> Column:
        over = F.coalesce(F.col("s") * F.col(p) * F.col(q) if normalized else F.col("s"), F.lit(0.0))
        return F.struct(F.col(row).alias("row_id"), F.col(col).alias("col_id"), (F.coalesce("own", F.lit(0.0)) - over).alias("value"))

    one = entry("row_id", "col_id", "p", "q")
    ways = F.when(F.col("row_id") < F.col("col_id"), F.array(one, entry("col_id", "row_id", "q", "p"))).otherwise(F.array(one))
    return half.select(F.explode(ways).alias("at")).select("at.*")
