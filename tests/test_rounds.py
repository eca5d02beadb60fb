"""Plans that run in rounds against their kernels and plain versions, on random graphs."""

from itertools import combinations

import pytest
from graphs import make, random_lists
from pyspark.sql import functions as F

from loomgraph.operators import subsets
from loomgraph.plans import local, ranking, structure, traversal


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.fixture(scope="module")
def pair(spark):
    return make(spark, random_lists(1))[0]


@pytest.fixture(scope="module")
def dag(spark):
    return make(spark, random_lists(2, acyclic=True))[0]


def test_bfs(pair):
    a, b = (traversal.bfs(pair.pairs, 1, n).orderBy("level", "place").collect() for n in (0, 10**6))
    assert [(r["vertex_id"], r["level"]) for r in a] == [(r["vertex_id"], r["level"]) for r in b]


def test_reachable_and_closure(pair, spark):
    start = spark.createDataFrame([(1,)], "vertex_id long")
    assert rows(traversal.reachable(pair.pairs, start, local_rows=0), "vertex_id") == rows(traversal.reachable(pair.pairs, start), "vertex_id")
    edges = {(r["src"], r["dst"]) for r in pair.pairs.collect()}
    while new := {(a, d) for a, b in edges for c, d in edges if b == c} - edges:
        edges |= new
    assert rows(traversal.transitive_closure(pair.pairs), "src", "dst") == sorted(edges)


def test_shortest_paths(spark):
    g, _ = make(spark, random_lists(3), weights=[1, 2, 3, 1, 2, 1, 3, 2, 1])
    weighted = g.weighted_pairs()
    a, b = (traversal.shortest_paths(weighted, 2, local_rows=n) for n in (0, 10**6))
    assert rows(a, "vertex_id") == rows(b, "vertex_id")
    assert rows(traversal.shortest_paths(weighted, 2, 7, local_rows=0).where("vertex_id = 7")) == rows(b.where("vertex_id = 7"))


def test_topological_order(dag, pair):
    (a, done), (b, _) = (structure.topological_levels(dag.vertex_frame, dag.pairs, local_rows=n) for n in (0, 10**6))
    order = lambda df: [(r["vertex_id"], r["level"]) for r in df.orderBy("level", "place").collect()]
    assert done and order(a) == order(b)
    assert structure.topological_levels(pair.vertex_frame, pair.pairs, ordered=False, local_rows=0)[1] == structure.topological_levels(pair.vertex_frame, pair.pairs)[1]


@pytest.mark.parametrize("seed", [4, 5])
def test_cut_vertices(spark, seed):
    lists = random_lists(seed, n=14, m=9, longest=4)
    g, _ = make(spark, lists, n=14)

    def parts(gone=None):
        root = {v: v for v in range(1, 15) if v != gone}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for x in lists:
            x = [v for v in x if v != gone]
            for v in x[1:]:
                root[find(v)] = find(x[0])
        return len({find(v) for v in root})

    alone = {v for v in range(1, 15) if all(v not in x or len(set(x)) == 1 for x in lists)}
    want = [v for v in range(1, 15) if v not in alone and parts(v) > parts()]
    assert [r[0] for r in rows(structure.cut_vertices(g.members), "vertex_id")] == want
    assert [r[0] for r in rows(structure.cut_vertices(g.members, 0), "vertex_id")] == want


def test_components(spark):
    g, _ = make(spark, random_lists(6, n=30, m=9, longest=4), n=30)
    a, b = (rows(structure.connected_components(g.vertex_frame, g.members, n), "vertex_id") for n in (0, 10**6))
    assert a == b and len(a) == 30


def test_centrality(pair):
    a, b = (rows(ranking.centrality(pair.vertex_frame, pair.pairs, local_rows=n), "vertex_id") for n in (0, 10**6))
    assert [r[0] for r in a] == [r[0] for r in b]
    for x, y in zip(a, b):
        assert x[1:] == pytest.approx(y[1:])


def test_inclusions(pair):
    sets = {}
    for h, v in rows(pair.members.select("hyperedge_id", "vertex_id"), "hyperedge_id"):
        sets.setdefault(h, set()).add(v)
    want = sorted(p for a, b in combinations(sets, 2) for p in ((a, b), (b, a)) if sets[p[0]] < sets[p[1]])
    assert rows(subsets.inclusions(pair.members), "subset", "superset") == want


def test_walks_follow_weights(spark):
    g, ids = make(spark, [[1, 2], [1, 3]], weights=[9, 1])
    starts = spark.range(4000).select(F.col("id").alias("walker"), F.lit(1).cast("long").alias("vertex_id"))
    at = {r["vertex_id"]: r["count"] for r in traversal.random_walks(g.members, g.hyperedge_frame, starts, 1, 5).where("step = 1").groupBy("vertex_id").count().collect()}
    assert abs(at[1] / 4000 - 0.5) < 0.03 and abs(at[2] / 4000 - 0.45) < 0.03 and abs(at[3] / 4000 - 0.05) < 0.02


def test_sizes_are_checked(spark):
    frame = spark.range(10)
    assert local.fetched(frame, 9) is None and len(local.fetched(frame, 10)) == 10 and local.fetched(frame, 0) is None
