"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import local, tables
from .tables import dropped, largest_key, spread_join, stored


def components(edges: DataFrame, plain_rows: int = 0) -> DataFrame:
    """(v, component) for every end of ``edges`` (a, b: long); component is the smallest id reachable.

    Each round every vertex takes the smallest label among itself and its neighbours, and then the label of that
    label, so that chains shorten as fast as they double. Labels are stored between rounds. Hot vertices are met in
    buckets and their neighbours' labels combined before the shuffle; where no vertex has more than ``plain_rows``
    edges, plain joins do. Large tables are first thinned out to trees by ranges of edges.
    """
    less = _thin(stored(edges.where("a <> b").select("a", "b"), "edges"))
    both = stored(less.unionByName(less.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    dropped(less)
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    last = labels
    plain = plain_rows > 0 and largest_key(both, "a") <= plain_rows
    meet = (lambda rows, per_key, key, by: rows.join(per_key, key)) if plain else spread_join
    while True:
        near = meet(both.withColumnRenamed("a", "v"), labels, "v", ["b"]).groupBy(F.col("b").alias("v")).agg(F.min("component").alias("near"))
        moved = labels.join(near, "v").select("v", F.col("component").alias("was"), F.least("component", "near").alias("next"))
        further = labels.select(F.col("v").alias("next"), F.col("component").alias("far"))
        new = meet(moved, further, "next", ["v"]).select("v", "was", F.least("next", "far").alias("component"))
        new = stored(new, "labels")
        dropped(last)
        last, labels = new, new.select("v", "component")
        if new.where("was <> component").isEmpty():
            dropped(both)
            return labels


def _thin(edges: DataFrame) -> DataFrame:
    """Stored edges with the same components and ends: each range of them is put as trees in a task, whose ends meet the
    smallest of theirs, and trees of trees in the next round, as long as it pays."""
    n = edges.count()
    while n > tables.THINNED_ROWS:
        last, edges = edges, stored(tables.thinned(edges, n, local.forest, "b", "a"), "edges")
        dropped(last)
        m = edges.count()
        if m > 0.7 * n:
            break
        n = m
    return edges
