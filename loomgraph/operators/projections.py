"""Hypergraph to hypergraph: each returns (vertices, hyperedges, incidence)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.frames import members_of, pairs_of
from loomgraph.operators.measures import meeting
from loomgraph.plans.tables import dealt, numbered, parts_of, stored


class Frames(NamedTuple):
    """The three frames of a hypergraph."""

    vertices: DataFrame
    hyperedges: DataFrame
    incidence: DataFrame


def _largest(*columns: tuple[DataFrame, str]) -> int:
    return max(int(df.agg(F.max(c)).first()[0] or 0) for df, c in columns)


def _listed(edges: DataFrame, *ends: str) -> DataFrame:
    """Incidence of edges (id, ...) whose vertices are the given columns in turn."""
    each = F.posexplode(F.array(*(F.col(e).cast("long") for e in ends))).alias("pos", "vertex_id")
    return edges.select(F.col("id").alias("hyperedge_id"), each).select("hyperedge_id", F.col("pos").cast("long").alias("pos"), "vertex_id")


def expand_to_graph(g: Frames) -> Frames:
    """Every consecutive pair as a hyperedge of its own, with the weight and payload of the one it is from; ids follow
    the largest vertex id in order of hyperedge and position."""
    base = _largest((g.vertices, "id"))
    pairs = numbered(pairs_of(g.incidence), "hyperedge_id", "pos", name="id", first=base + 1)
    payload = g.hyperedges.withColumnRenamed("id", "hyperedge_id")
    edges = pairs.join(payload, "hyperedge_id").select("id", "src", "dst", "weight", "data")
    return Frames(g.vertices, edges.select("id", "weight", "data"), _listed(edges, "src", "dst"))


def expand_to_star(g: Frames, to_vertex: Column | None = None) -> Frames:
    """A hub vertex for every hyperedge, and a (member, hub) hyperedge for each distinct member. Ids follow the largest
    of all: hub, its edges, next hub. ``to_vertex`` makes a hub's payload from its hyperedge's."""
    base = _largest((g.vertices, "id"), (g.hyperedges, "id"))
    hubs = g.hyperedges.select(F.col("id").alias("h"), F.lit(-1).cast("long").alias("at"), F.lit(None).cast("long").alias("member"))
    spokes = members_of(g.incidence).select(F.col("hyperedge_id").alias("h"), F.col("first_pos").alias("at"), F.col("vertex_id").alias("member"))
    rows = numbered(hubs.unionByName(spokes), "h", "at", name="id", first=base + 1)
    wanted = g.vertices.schema["data"].dataType
    if to_vertex is None:  # payloads of another type can't be vertices' ones
        to_vertex = F.col("data") if g.hyperedges.schema["data"].dataType == wanted else F.lit(None).cast(wanted)
    payload = g.hyperedges.select(F.col("id").alias("h"), "weight", "data", to_vertex.alias("as_vertex"))
    hub = rows.where("member is null").select("h", F.col("id").alias("hub")).join(payload, "h")
    edges = dealt(rows.where("member is not null"), rows, "h").join(hub, "h")
    vertices = g.vertices.select("id", "data").unionByName(hub.select(F.col("hub").alias("id"), F.col("as_vertex").alias("data")))
    return Frames(vertices, edges.select("id", "weight", "data"), _listed(edges, "member", "hub"))


def dual(g: Frames, to_vertex: Column | None = None, to_hyperedge: Column | None = None) -> Frames:
    """Hyperedges become vertices 1 to m and vertices hyperedges m+1 to m+n, each with the distinct hyperedges it was
    in, in their order."""
    data = F.col("data")
    hyperedges = numbered(g.hyperedges.select("id", (to_vertex if to_vertex is not None else data).alias("data")), "id", name="new", first=1)
    m = hyperedges.count()
    vertices = numbered(g.vertices.select("id", (to_hyperedge if to_hyperedge is not None else data).alias("data")), "id", name="new", first=m + 1)
    both = members_of(g.incidence).join(hyperedges.select(F.col("id").alias("hyperedge_id"), F.col("new").alias("v")), "hyperedge_id").join(vertices.select(F.col("id").alias("vertex_id"), F.col("new").alias("h")), "vertex_id")
    place = F.row_number().over(Window.partitionBy("h").orderBy("v")).cast("long") - 1
    incidence = both.select(F.col("h").alias("hyperedge_id"), place.alias("pos"), F.col("v").alias("vertex_id"))
    return Frames(hyperedges.select(F.col("new").alias("id"), "data"), vertices.select(F.col("new").alias("id"), F.lit(1).cast("long").alias("weight"), "data"), incidence)


def line_pairs(g: Frames, to_vertex: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The line graph's vertices (new, data), from 1, and its hyperedges (id, a, b).

    Pairs are kept as a list for each ``a``, in ranges of ``a`` that are numbered by a running sum; a row for each pair
    is only made as it is read.
    """
    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds how many values the lists of the same range before a row hold; rows come by range."""
        last, total = None, 0
        for batch in batches:
            ranges, sizes = batch.column("range").to_numpy(), pc.list_value_length(batch.column("later")).to_numpy().astype(np.int64)
            if not len(ranges):
                continue
            sums = np.concatenate([[0], np.cumsum(sizes)])
            begins = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]]))
            base = np.repeat(sums[begins], np.diff(np.append(begins, len(ranges))))
            before = sums[:-1] - base
            if ranges[0] == last:
                before[ranges == last] += total
            total, last = int(before[-1] + sizes[-1]), ranges[-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("range", "a", "later")), pa.array(before, pa.int64())], names=["range", "a", "later", "before"])

    new = numbered(g.hyperedges.select("id", (to_vertex if to_vertex is not None else F.col("data")).alias("data")), "id", name="new", first=1)
    m, parts = new.count(), parts_of(g.incidence)
    members = members_of(g.incidence).join(new.select(F.col("id").alias("hyperedge_id"), "new"), "hyperedge_id").select("vertex_id", F.col("new").alias("hyperedge_id"))
    ranges = 8 * parts
    rows = meeting(members).withColumn("range", F.expr(f"(a - 1) * {ranges} div {max(m, 1)}")).repartition(parts, "range")
    lists = rows.groupBy("range", "a").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("later")))).alias("later"))
    lists = stored(lists.sortWithinPartitions("range", "a").mapInArrow(before, "range long, a long, later array<long>, before long"), "line-pairs")
    sums = lists.groupBy("range").agg(F.max(F.col("before") + F.size("later")).alias("n"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    first = sums.select("range", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) + m + 1).alias("first"))
    pairs = lists.join(F.broadcast(first), "range").select("a", "before", "first", F.posexplode("later").alias("i", "b"))
    return new, pairs.select((F.col("first") + F.col("before") + F.col("i")).alias("id"), "a", "b")


def line_graph(g: Frames, to_vertex: Column | None = None, data: Column | None = None, weight: int = 1) -> Frames:
    """Hyperedges become vertices 1 to m, and each two that share a vertex a hyperedge of two with the given payload and
    weight; ids follow in order of the pair."""
    new, pairs = line_pairs(g, to_vertex)
    return Frames(new.select(F.col("new").alias("id"), "data"), pairs.select("id", F.lit(weight).cast("long").alias("weight"), (data if data is not None else F.lit("{}")).alias("data")), _listed(pairs, "a", "b"))


def k_skeleton(g: Frames, k: int) -> Frames:
    """Hyperedges of ``k`` positions at most, repeats counted and empty ones kept; all vertices."""
    long = g.incidence.where(F.col("pos") >= k).select(F.col("hyperedge_id")).distinct()
    return Frames(g.vertices, g.hyperedges.join(long, F.col("id") == F.col("hyperedge_id"), "left_anti"), g.incidence.join(long, "hyperedge_id", "left_anti"))


def vertex_induced(g: Frames, ids: DataFrame) -> Frames:
    """The vertices of ``ids`` (id) and the hyperedges that lie wholly within them, empty ones among those."""
    outside = g.incidence.join(ids.select(F.col("id").alias("vertex_id")), "vertex_id", "left_anti").select("hyperedge_id").distinct()
    return Frames(g.vertices.join(ids.select("id"), "id", "left_semi"), g.hyperedges.join(outside, F.col("id") == F.col("hyperedge_id"), "left_anti"), g.incidence.join(outside, "hyperedge_id", "left_anti"))


def edge_induced(g: Frames, ids: DataFrame) -> Frames:
    """The hyperedges of ``ids`` (id) and their vertices."""
    incidence = g.incidence.join(ids.select(F.col("id").alias("hyperedge_id")), "hyperedge_id", "left_semi")
    return Frames(g.vertices.join(incidence.select(F.col("vertex_id").alias("id")), "id", "left_semi"), g.hyperedges.join(ids.select("id"), "id", "left_semi"), incidence)
