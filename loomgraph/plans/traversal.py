"""Directed traversal over consecutive pairs, a round for each step away from the start."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import local
from .local import LOCAL_ROWS, LOCAL_WORK
from .tables import appended, dropped, fits_broadcast, joined, largest_key, numbered, placed, screened, spread_join, stored


def _ids(df: DataFrame, ids: list[int], name: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(int(i),) for i in ids], f"{name} long")


def edges_of(pairs: DataFrame) -> DataFrame:
    """(src, dst, hyperedge_id, pos): parallel pairs once, with the first hyperedge and position they are found at."""
    first = pairs.groupBy("src", "dst").agg(F.min(F.struct("hyperedge_id", "pos")).alias("at"))
    return first.select("src", "dst", "at.hyperedge_id", "at.pos")


def bfs(pairs: DataFrame, start: int, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(vertex_id, level, place) of the vertices reached; ordered by level and place they are in breadth-first order,
    neighbours by hyperedge and position."""
    edges = stored(pairs.select("hyperedge_id", "pos", "src", "dst"), "pairs")
    if (here := local.fetched(edges, local_rows)) is not None:
        return local.frame(edges, local.bfs(here, int(start)), "vertex_id long, level int, place long")
    first = _ids(pairs, [start], "vertex_id").withColumn("level", F.lit(0)).withColumn("place", F.lit(0).cast("long"))
    seen, last, level = stored(first, "bfs"), stored(first, "frontier"), 0
    frontier = last
    while True:
        level += 1
        found = spread_join(edges.withColumnRenamed("src", "vertex_id"), frontier.select("vertex_id", "place"), "vertex_id", ["hyperedge_id", "pos"])
        new = found.groupBy(F.col("dst").alias("vertex_id")).agg(F.min(F.struct("place", "hyperedge_id", "pos")).alias("key")).join(seen.select("vertex_id"), "vertex_id", "left_anti")
        new = placed(new, "key")
        dropped(last)
        last, frontier = new, new.select("vertex_id", F.lit(level).alias("level"), "place")
        if frontier.isEmpty():
            return seen
        seen = appended(seen, frontier)


def reachable(pairs: DataFrame, sources: DataFrame, until: int | None = None, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(vertex_id, hops) of the vertices that a path from any of ``sources`` (vertex_id) ends at, those included; stops
    early once ``until`` is among them."""
    edges = stored(pairs.select("src", "dst").distinct(), "edges")
    starts = stored(sources.select("vertex_id").distinct(), "sources")
    if (here := local.fetched(edges, local_rows)) is not None and (begin := local.fetched(starts, local_rows)) is not None:
        return local.frame(edges, sorted(local.hops(here, [int(v) for v in begin["vertex_id"]]).items()), "vertex_id long, hops int")
    first = starts.withColumn("hops", F.lit(0))
    seen, frontier, hops = stored(first, "reached"), stored(first, "frontier"), 0
    while True:
        hops += 1
        if until is not None and not frontier.where(F.col("vertex_id") == until).isEmpty():
            return seen
        new = edges.join(frontier.select(F.col("vertex_id").alias("src")), "src", "left_semi").select(F.col("dst").alias("vertex_id")).distinct()
        last, frontier = frontier, stored(new.join(seen.select("vertex_id"), "vertex_id", "left_anti").withColumn("hops", F.lit(hops)), "frontier")
        dropped(last)
        if frontier.isEmpty():
            return seen
        seen = appended(seen, frontier)


def shortest_paths(pairs: DataFrame, start: int | None, target: int | None = None, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(vertex_id, cost, hops, path) of the least path from ``start`` to every vertex, or those no dearer than
    ``target``: by cost, then hops, then the path's ids. ``pairs`` has a weight that isn't negative, which a step costs.
    Without ``start`` it is the least vertex that a pair has.

    Pairs are stored as they come, parallel ones too, since the least path to a vertex is chosen among all steps to it
    anyway. A round moves those at most that begin where the round before ended, but for few. Paths are appended to one
    table, and that is only written anew after a round that found a better path to a vertex found before.
    """
    edges = stored(pairs.select("src", "dst", F.col("weight").cast("long").alias("w")), "edges")
    if start is None:
        start = edges.agg(F.min(F.least("src", "dst"))).first()[0]
    if (here := local.fetched(edges, local_rows)) is not None:
        best, previous = local.shortest(here, int(start))
        wanted = best if target is None else [v for v in (int(target),) if v in best]
        if sum(best[v][1] for v in wanted) <= LOCAL_WORK:
            return local.frame(edges, [(v, *best[v], local.path_to(v, previous)) for v in wanted], "vertex_id long, cost long, hops long, path array<long>")
    zero = F.lit(0).cast("long")
    best = frontier = stored(_ids(pairs, [start], "vertex_id").select("vertex_id", zero.alias("cost"), zero.alias("hops"), F.array("vertex_id").alias("path")), "paths")
    ahead, last, n = edges.withColumnRenamed("src", "vertex_id"), None, 1
    while True:
        if target is not None:
            known = best.where(F.col("vertex_id") == target).select("cost").first()
            if known is not None:
                frontier = frontier.where(F.col("cost") <= known["cost"])
        near = ahead if fits_broadcast(frontier) else screened(ahead, "vertex_id", frontier.select("vertex_id"), n)
        step = frontier.join(near, "vertex_id")
        keyed = step.select(F.col("dst").alias("vertex_id"), F.struct((F.col("cost") + F.col("w")).alias("cost"), (F.col("hops") + 1).alias("hops"), F.concat("path", F.array("dst")).alias("path")).alias("k"))
        new = keyed.groupBy("vertex_id").agg(F.min("k").alias("k"))
        old = best.select("vertex_id", F.struct("cost", "hops", "path").alias("was"))
        better = new.join(old, "vertex_id", "left").where("was is null or k < was").select("vertex_id", "k.cost", "k.hops", "k.path", F.expr("was is not null").alias("again"))
        better = stored(better, "frontier")
        found = better.agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again")).first()
        if not found["n"]:
            return best
        frontier, n = better.drop("again"), found["n"]
        if found["again"]:
            before, best = best, stored(best.join(better.select("vertex_id"), "vertex_id", "left_anti").unionByName(frontier), "paths")
            dropped(before)
        else:
            best = appended(best, frontier)
        if last is not None:
            dropped(last)
        last = better


def all_paths(pairs: DataFrame, start: int, target: int) -> DataFrame:
    """(path, keys) of all simple paths; parallel pairs count once. By falling ``keys``, the hyperedge and position of
    each step, they are in a depth-first search's order. The result can be exponentially large."""
    edges = stored(edges_of(pairs).select(F.col("src").alias("at"), "dst", F.struct("hyperedge_id", "pos").alias("key")), "edges")
    none = F.array().cast("array<struct<hyperedge_id:long,pos:long>>")
    paths = _ids(pairs, [start], "at").select("at", F.array("at").alias("path"), none.alias("keys"))
    done = stored(paths.where(F.col("at") == target), "all-paths")
    open_paths = stored(paths.where(F.col("at") != target), "open-paths")
    while not open_paths.isEmpty():
        step = open_paths.join(edges, "at").where("not array_contains(path, dst)")
        step = stored(step.select(F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"), F.concat("keys", F.array("key")).alias("keys")), "steps")
        done = appended(done, step.where(F.col("at") == target))
        open_paths = step.where(F.col("at") != target)
    return done.select("path", "keys")


def transitive_closure(pairs: DataFrame) -> DataFrame:
    """(src, dst) of the pairs joined by a path of one step or more; (u, u) only where u lies on a cycle.

    Paths double in length each round: what is new is joined with all that is known. Vertices are numbered, those that
    no pair begins at first, and what a vertex reaches is kept as words of 64 bits of those numbers, so that close ones
    share a row and ones that lead nowhere are never joined; rows for pairs are only made as the result is read.
    """
    edges = stored(pairs.select("src", "dst").distinct(), "closure-edges")
    ends = edges.select(F.col("src").alias("v"), F.lit(1).alias("out")).unionByName(edges.select(F.col("dst").alias("v"), F.lit(0).alias("out")))
    ids = stored(numbered(ends.groupBy("v").agg(F.max("out").alias("out")), "out", "v", name="n"), "closure-ids")
    sinks = ids.where("out = 0").count()
    at = lambda c: ids.select(F.col("v").alias(c), F.col("n").alias(f"{c}_n"))
    most = largest_key(edges, "src", "dst")
    inner = joined(joined(edges, at("src"), "src", ["dst"], most), at("dst"), "dst", ["src"], most)
    known = stored(inner.groupBy(F.col("src_n").alias("s"), F.expr("dst_n div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(dst_n % 64 as int))")).alias("bits")), "closure")
    delta = stored(known, "closure-delta")
    bit = F.explode(F.array(*(F.lit(k) for k in range(64)))).alias("k")

    def through(first: DataFrame, then: DataFrame) -> DataFrame:
        """What ``then`` reaches from where ``first`` comes to."""
        via = first.where(F.col("w") >= sinks // 64).select("s", "w", "bits", bit).where("(shiftright(bits, k) & 1L) = 1").select("s", (F.col("w") * 64 + F.col("k")).alias("via"))
        return via.where(F.col("via") >= sinks).join(then.select(F.col("s").alias("via"), "w", "bits"), "via").select("s", "w", "bits", F.lit(0).cast("long").alias("old"))

    while True:
        both = through(delta, known).unionByName(through(known, delta)).unionByName(known.select("s", "w", F.lit(0).cast("long").alias("bits"), F.col("bits").alias("old")))
        new = both.groupBy("s", "w").agg(F.bit_or("bits").alias("b"), F.bit_or("old").alias("o")).select("s", "w", F.expr("b & ~o").alias("bits"))
        last, delta = delta, stored(new.where("bits <> 0"), "closure-delta")
        dropped(last)
        if delta.isEmpty():
            break
        known = appended(known, delta)
    words = ids.groupBy(F.expr("n div 64").alias("w")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "v"))), lambda x: x["v"]).alias("ids"))
    most = largest_key(known, "s", "w")
    named = joined(known, ids.select(F.col("n").alias("s"), F.col("v").alias("src")), "s", ["w"], most)
    whole = joined(named.select("src", "w", "bits"), words, "w", ["src"], most)
    return whole.select("src", "bits", F.posexplode("ids").alias("k", "dst")).where("(shiftright(bits, k) & 1L) = 1").select("src", "dst")


def random_walks(members: DataFrame, weights: DataFrame, starts: DataFrame, steps: int, seed: int) -> DataFrame:
    """(walker, step, vertex_id) of walks from ``starts`` (walker, vertex_id): each step takes an incident hyperedge by
    its weight, then any of its distinct members. Where no hyperedge has weight the walker stays.

    Draws are hashes of (seed, walker, step, candidate): the least -ln(u) / weight is a hyperedge by weight, the least
    hash a member by chance. The same seed gives the same walks.
    """
    weighted = members.select("hyperedge_id", "vertex_id").join(weights.select(F.col("id").alias("hyperedge_id"), "weight").where("weight > 0"), "hyperedge_id")
    incident = stored(weighted.select("vertex_id", "hyperedge_id", "weight"), "walk-incidence")
    at = stored(starts.select("walker", "vertex_id").withColumn("step", F.lit(0)), "walk")
    walk = at
    for step in range(1, steps + 1):
        draw = lambda c: F.xxhash64(F.lit(seed), "walker", F.lit(step), c)
        u = (F.shiftright(draw("hyperedge_id"), 11).bitwiseAND(F.lit((1 << 53) - 1)) + 0.5) / float(1 << 53)
        chosen = at.join(incident, "vertex_id").groupBy("walker").agg(F.min_by("hyperedge_id", F.struct((-F.log(u) / F.col("weight")).alias("k"), "hyperedge_id")).alias("hyperedge_id"))
        moved = chosen.join(incident.select("hyperedge_id", "vertex_id"), "hyperedge_id").groupBy("walker").agg(F.min_by("vertex_id", F.struct(draw("vertex_id").alias("k"), "vertex_id")).alias("to"))
        at = stored(at.select("walker", "vertex_id").join(moved, "walker", "left").select("walker", F.coalesce("to", "vertex_id").alias("vertex_id"), F.lit(step).alias("step")), "walk")
        walk = walk.unionByName(at)
    return walk.select("walker", "step", "vertex_id")


def dfs(pairs: DataFrame, start: int) -> DataFrame:
    """(place, vertex_id) in depth-first preorder, neighbours by hyperedge and position.

    The order is inherently sequential: the part of the graph that ``start`` reaches is cut out in parallel and then
    walked in one task.
    """
    reached = reachable(pairs, _ids(pairs, [start], "vertex_id"))
    part = edges_of(pairs).join(reached.select(F.col("vertex_id").alias("src")), "src", "left_semi")
    seed = _ids(pairs, [start], "src").select("src", F.lit(None).cast("long").alias("dst"), F.lit(None).cast("long").alias("hyperedge_id"), F.lit(None).cast("long").alias("pos"))
    return part.unionByName(seed).groupBy(F.lit(0).alias("one")).applyInPandas(_preorder(start), "place long, vertex_id long")


def _preorder(start: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def walk(edges: pd.DataFrame) -> pd.DataFrame:
        edges = edges.dropna().sort_values(["src", "hyperedge_id", "pos"])
        following = {int(s): [int(x) for x in d] for s, d in edges.groupby("src")["dst"]}
        order, seen, stack = [], set(), [start]
        while stack:
            v = stack.pop()
            if v not in seen:
                seen.add(v)
                order.append(v)
                stack.extend(reversed(following.get(v, [])))
        return pd.DataFrame({"place": range(len(order)), "vertex_id": order})

    return walk
