"""PageRank of the undirected hypergraph walk, and centralities of the directed pairs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import local
from .local import LOCAL_ROWS, LOCAL_WORK
from .tables import PLAIN_ROWS, appended, dropped, joined, largest_key, spread_join, stored
from .walk_blocks import WalkBlocks


class PageRank(NamedTuple):
    """``scores`` (vertex_id, score), the sweeps made and whether the last one changed less than the tolerance."""

    scores: DataFrame
    iterations: int
    converged: bool


def page_rank(vertices: DataFrame, hyperedges: DataFrame, members: DataFrame, *, damping: float = 0.85, tolerance: float = 1e-6, max_iterations: int = 100) -> PageRank:
    """The walk takes an incident hyperedge by weight, then any distinct member. What vertices without weight hold is
    spread evenly. A sweep sums each hyperedge's inflow and then each vertex's, in blocks of hyperedges that stay where
    they are, so that only vertices' numbers move."""
    ids = vertices.select(F.col("id").alias("vertex_id"))
    n = ids.count()
    if n == 0:
        return PageRank(ids.withColumn("score", F.lit(0.0)), 0, True)
    weighted = members.select("hyperedge_id", "vertex_id").join(hyperedges.select(F.col("id").alias("hyperedge_id"), "weight"), "hyperedge_id")
    weighted = stored(weighted, "flows")
    most = largest_key(weighted, "hyperedge_id")
    if most > PLAIN_ROWS:
        return _page_rank_joins(ids, n, weighted, max(most, largest_key(weighted, "vertex_id")), damping, tolerance, max_iterations)
    blocks = WalkBlocks(ids, weighted, n, weighted.count())
    dropped(weighted)
    state = blocks.first()
    dangling = float(state.agg(F.sum("dangling")).first()[0] or 0)
    for sweep in range(1, max_iterations + 1):
        new = blocks.swept(state, (1 - damping) / n + damping * dangling / n, damping)
        sums = new.agg(F.sum("change").alias("change"), F.sum("dangling").alias("dangling")).first()
        dropped(state)
        state, dangling = new, float(sums["dangling"] or 0)
        if sums["change"] < tolerance:
            break
    blocks.close()
    return PageRank(blocks.scores(state), sweep if max_iterations > 0 else 0, max_iterations > 0 and sums["change"] < tolerance)


def _page_rank_joins(ids: DataFrame, n: int, weighted: DataFrame, most: int, damping: float, tolerance: float, max_iterations: int) -> PageRank:
    """The same by joins, where a hyperedge is too large for a block."""
    degree = weighted.groupBy("vertex_id").agg(F.sum("weight").alias("d"))
    size = weighted.groupBy("hyperedge_id").agg((F.max("weight") / F.count(F.lit(1))).alias("share"))
    flows = stored(spread_join(weighted.select("hyperedge_id", "vertex_id"), size, "hyperedge_id", ["vertex_id"]), "flows")
    degree = stored(ids.join(degree, "vertex_id", "left").withColumn("d", F.coalesce("d", F.lit(0)).cast("double")), "weights")
    scores = stored(degree.withColumn("score", F.lit(1.0 / n)), "page-rank")
    last = scores
    dangling = float(scores.agg(F.sum(F.when(F.col("d") <= 0, F.col("score")))).first()[0] or 0)
    for sweep in range(1, max_iterations + 1):
        out = scores.where("d > 0").select("vertex_id", (F.col("score") / F.col("d")).alias("x"))
        inflow = joined(flows, out, "vertex_id", ["hyperedge_id"], most).groupBy("hyperedge_id").agg((F.sum("x") * F.max("share")).alias("y"))
        got = joined(flows.select("hyperedge_id", "vertex_id"), inflow, "hyperedge_id", ["vertex_id"], most).groupBy("vertex_id").agg(F.sum("y").alias("y"))
        base = (1 - damping) / n + damping * dangling / n
        new = scores.join(got, "vertex_id", "left").select("vertex_id", "d", F.col("score").alias("was"), (F.lit(base) + damping * F.coalesce("y", F.lit(0.0))).alias("score"))
        new = stored(new, "page-rank")
        sums = new.agg(F.sum(F.abs(F.col("score") - F.col("was"))).alias("change"), F.sum(F.when(F.col("d") <= 0, F.col("score"))).alias("dangling")).first()
        dropped(last)
        last, scores, dangling = new, new.drop("was"), float(sums["dangling"] or 0)
        if sums["change"] < tolerance:
            return PageRank(scores.select("vertex_id", "score"), sweep, True)
    return PageRank(scores.select("vertex_id", "score"), max_iterations, False)


def centrality(vertices: DataFrame, pairs: DataFrame, sources: DataFrame | None = None, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(vertex_id, degree, closeness, betweenness) by unweighted directed distances.

    degree: pair ends by 2 (n - 1). closeness: r^2 / ((n - 1) * sum of the distances) over the r vertices reached.
    betweenness: Brandes' sums, parallel pairs multiplying paths, by (n - 1)(n - 2). All sources advance together: a
    frame of (source, vertex) rows, as many as pairs that reach each other. ``sources`` (vertex_id) restricts those.
    """
    ids = stored(vertices.select(F.col("id").alias("vertex_id")), "vertices")
    n = ids.count()
    edges = stored(pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("m")), "edges")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("vertex_id"), "m").groupBy("vertex_id").agg(F.sum("m").alias("ends"))
    begin = (sources if sources is not None else ids).select("vertex_id")
    scale = float((n - 1) * (n - 2)) if n > 2 else 1.0

    def result(closeness: DataFrame, between: DataFrame) -> DataFrame:
        out = ids.join(ends, "vertex_id", "left").join(closeness, "vertex_id", "left").join(between, "vertex_id", "left")
        close = F.when(F.col("r") > 0, F.col("r") * F.col("r") / (F.lit(float(max(n - 1, 1))) * F.col("total"))).otherwise(0.0)
        return out.select("vertex_id", (F.coalesce("ends", F.lit(0.0)) / float(2 * (n - 1) if n > 1 else 1)).alias("degree"), F.coalesce(close, F.lit(0.0)).alias("closeness"), (F.coalesce("b", F.lit(0.0)) / scale).alias("betweenness"))

    if n * edges.count() <= LOCAL_WORK and (here := local.fetched(edges, local_rows)) is not None:
        known = [int(r["vertex_id"]) for r in ids.collect()]
        reach, sums = local.brandes(known, here, known if sources is None else [int(r["vertex_id"]) for r in begin.collect()])
        return result(local.frame(ids, [(v, *x) for v, x in reach.items()], "vertex_id long, r long, total long"), local.frame(ids, list(sums.items()), "vertex_id long, b double"))
    levels = [stored(begin.select(F.col("vertex_id").alias("s"), F.col("vertex_id").alias("v"), F.lit(1.0).alias("sigma")), "level")]
    seen = stored(levels[0].select("s", "v", F.lit(0).alias("dist"), "sigma"), "distances")
    while True:
        step = levels[-1].join(edges, levels[-1]["v"] == edges["src"]).groupBy("s", F.col("dst").alias("v")).agg(F.sum(F.col("sigma") * F.col("m")).alias("sigma"))
        new = stored(step.join(seen.select("s", "v"), ["s", "v"], "left_anti"), "level")
        if new.isEmpty():
            break
        seen = appended(seen, new.select("s", "v", F.lit(len(levels)).alias("dist"), "sigma"))
        levels.append(new)
    closeness = seen.where("dist > 0").groupBy(F.col("s").alias("vertex_id")).agg(F.count(F.lit(1)).alias("r"), F.sum("dist").alias("total"))
    between, below = None, None
    for own in reversed(levels[1:]):
        if below is None:
            delta = own.withColumn("delta", F.lit(0.0))
        else:
            back = edges.select(F.col("src").alias("v"), F.col("dst").alias("w"), "m").join(below.select("s", F.col("v").alias("w"), ((1 + F.col("delta")) / F.col("sigma")).alias("share")), "w")
            sums = back.groupBy("s", "v").agg(F.sum(F.col("m") * F.col("share")).alias("x"))
            delta = own.join(sums, ["s", "v"], "left").select("s", "v", "sigma", (F.col("sigma") * F.coalesce("x", F.lit(0.0))).alias("delta"))
        below = stored(delta, "dependencies")
        between = below if between is None else between.unionByName(below)
    if between is None:
        return result(closeness, ids.withColumn("b", F.lit(0.0)))
    return result(closeness, between.groupBy(F.col("v").alias("vertex_id")).agg(F.sum("delta").alias("b")))
