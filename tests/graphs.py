"""Small hypergraphs that several tests use, and plain versions of operators to hold results against."""

from __future__ import annotations

import random

from loomgraph.graph import Hypergraph


def make(spark, lists, n=None, weights=None):
    """Vertices 1 to n, then a hyperedge for each list; built."""
    n = n or max((v for x in lists for v in x), default=0)
    g = Hypergraph(spark)
    g.create_vertices([{"n": i} for i in range(1, n + 1)])
    ids = g.create_hyperedges([{} for _ in lists], weights)
    rows = [(h, p, v) for h, x in zip(ids, lists) for p, v in enumerate(x)]
    g._edited(spark.createDataFrame(rows, "hyperedge_id long, pos long, vertex_id long"))
    g.build()
    return g, ids


def five(spark):
    """Vertices a to e, 1 to 5; hyperedges 6 abcde, 7 eea, 8 bcceadb: loops, repeats and cycles."""
    return make(spark, [[1, 2, 3, 4, 5], [5, 5, 1], [2, 3, 3, 5, 1, 4, 2]])[0]


def random_lists(seed, n=12, m=9, longest=5, acyclic=False):
    r = random.Random(seed)
    lists = [[r.randint(1, n) for _ in range(r.randint(1, longest))] for _ in range(m)]
    return [sorted(set(x)) for x in lists] if acyclic else lists


def plain_core(lists: list[list[int]], ids: list[int], s: int, t: int) -> tuple[set[int], set[int]]:
    """Vertices and hyperedges with members in the core, peeled one by one."""
    left = {h: set(x) for h, x in zip(ids, lists)}
    while True:
        degree = {}
        for x in left.values():
            for v in x:
                degree[v] = degree.get(v, 0) + 1
        new = {h: {v for v in x if degree[v] >= s} for h, x in left.items() if len(x) >= t}
        if new == left:
            return set().union(*left.values()), {h for h, x in left.items() if x}
        left = new
