"""Plans that thin out, block or number what they move, in many parts, against plain versions."""

import random

import numpy as np
import pandas as pd
import pytest
from graphs import make, random_lists

from loomgraph.functions import frames
from loomgraph.operators import matrices, subsets
from loomgraph.plans import local, ranking, structure, tables, walk_blocks


def plain_cut_vertices(lists):
    rows = sorted({(h, v) for h, x in enumerate(lists) for v in x})
    return local.cut_vertices(pd.DataFrame(rows, columns=["hyperedge_id", "vertex_id"]))


@pytest.mark.parametrize("seed", range(40))
def test_blocks_keep_cut_vertices(seed):
    r = random.Random(seed)
    lists = [sorted({r.randint(1, 16) for _ in range(r.randint(2, 4))}) for _ in range(r.randint(1, 11))]
    rows = [(h, v) for h, x in enumerate(lists) for v in x if len(x) > 1]
    h, v = local.blocks(*(np.array(c, dtype=np.int64) for c in zip(*rows))) if rows else ((), ())
    found = {}
    for a, b in zip(h, v):
        found.setdefault(int(a), set()).add(int(b))
    assert plain_cut_vertices(found.values()) == plain_cut_vertices(lists)
    assert all(len(a & b) < 2 for k, a in found.items() for j, b in found.items() if k != j)


def test_cut_vertices_are_thinned(spark, monkeypatch):
    """Over many ranges, as lines and rings of hyperedges, few rows are left for the rounds."""
    r = random.Random(3)
    lists = [[r.randint(1 + 20 * k, 20 + 20 * k) for _ in range(3)] for k in range(6) for _ in range(40)]
    lists += [[20 * k + 1, 20 * k + 21] for k in range(4)] + [[1, 200, 201, 202], [202, 203], [204, 204]]
    g, _ = make(spark, lists)
    monkeypatch.setattr(tables, "THINNED_ROWS", 50)
    kept = structure._thin(tables.stored(g.members.select("hyperedge_id", "vertex_id"), "test"), 0)
    assert kept.count() < 40
    monkeypatch.setattr(structure, "PLAIN_ROWS", 3)  # some hyperedges pass by the ranges
    assert [x[0] for x in structure.cut_vertices(g.members, 0).orderBy("vertex_id").collect()] == plain_cut_vertices(lists)


def test_page_rank_in_blocks(spark, monkeypatch):
    """Many blocks and ranges give what joins do, with vertices outside, no weight and no hyperedge; incidences don't move."""
    lists = random_lists(21, n=60, m=50, longest=6)
    g, ids = make(spark, lists, n=70, weights=[k % 4 for k in range(50)])
    vertices = g.vertex_frame.where("id not in (1, 2, 30, 60)")
    monkeypatch.setattr(walk_blocks.WalkBlocks.__init__, "__defaults__", (20, 9))
    run = lambda: ranking.page_rank(vertices, g.hyperedge_frame, g.members, tolerance=0.0, max_iterations=5)
    blocks = {r[0]: r[1] for r in run().scores.collect()}
    monkeypatch.setattr(ranking, "PLAIN_ROWS", 1)  # hyperedges too large for blocks
    joins = {r[0]: r[1] for r in run().scores.collect()}
    assert blocks.keys() == joins.keys() and len(blocks) == 66
    assert all(blocks[v] == pytest.approx(joins[v], abs=1e-12) for v in joins)


def test_page_rank_moves_no_incidences(spark, monkeypatch):
    lists = random_lists(22, n=60, m=50, longest=6)
    g, _ = make(spark, lists)
    plans, plain = [], walk_blocks.stored
    monkeypatch.setattr(walk_blocks, "stored", lambda df, what: plans.append((what, df._jdf.queryExecution().executedPlan().toString())) or plain(df, what))
    ranking.page_rank(g.vertex_frame, g.hyperedge_frame, g.members, tolerance=0.0, max_iterations=2)
    sweeps = [p for what, p in plans if what == "page-rank"][1:]
    assert len(sweeps) == 2 and all("InMemoryTableScan" in p and "hyperedge_id" not in p for p in sweeps)


@pytest.mark.parametrize("plain_rows", [10**6, 1])
def test_inclusions_by_words(spark, monkeypatch, plain_rows):
    """Pairs are told apart by words of bits, so few are counted; hot members too."""
    lists = [*random_lists(23, n=90, m=80, longest=6), [1], [1, 2], [1, 2, 3], [3, 2, 1], [1, 2, 3, 4], [5, 5], list(range(1, 91))]
    g, ids = make(spark, lists)
    monkeypatch.setattr(tables, "PLAIN_ROWS", plain_rows)
    kept, plain = {}, subsets.stored
    monkeypatch.setattr(subsets, "stored", lambda df, what: kept.setdefault(what, plain(df, what)))
    sets = {h: set(x) for h, x in zip(ids, lists)}
    want = sorted((a, b) for a in sets for b in sets if sets[a] < sets[b])
    assert sorted(map(tuple, subsets.inclusions(g.members).collect())) == want
    assert kept["candidates"].count() < 1.2 * len(want)


def test_levels_free_pairs_without_storing_the_rest(spark, monkeypatch):
    """Parallel pairs go once, and no round stores pairs anew; a cycle, hot sources and ordered places too."""
    lists = random_lists(24, n=30, m=60, longest=5, acyclic=True)
    g, _ = make(spark, lists, n=32)
    order = lambda local_rows: [(r["vertex_id"], r["level"]) for r in structure.topological_levels(g.vertex_frame, g.pairs, local_rows=local_rows)[0].orderBy("level", "place").collect()]
    names, plain = [], structure.stored
    monkeypatch.setattr(structure, "stored", lambda df, what: names.append(what) or plain(df, what))
    want, got = order(10**6), order(0)
    assert want == got and len(want) == 32 and names.count("pairs") == 2 and not {"pairs-left", "pairs-freed"} & set(names)
    monkeypatch.setattr(structure, "PLAIN_ROWS", 1)
    assert order(0) == want
    cyclic, _ = make(spark, [[1, 2, 3], [3, 2], [4, 1]])
    assert structure.has_cycle(cyclic.vertex_frame, cyclic.pairs, local_rows=0) and not structure.has_cycle(g.vertex_frame, g.pairs, local_rows=0)


def test_pairs_from_arrays(spark):
    df = spark.createDataFrame([(1, [5, 6, 5]), (2, [7]), (3, []), (4, [8, 8])], "id long, members array<long>")
    want = sorted(map(tuple, frames.pairs_of(frames.incidence_from_arrays(df)).collect()))
    assert sorted(map(tuple, frames.pairs_from_arrays(df).collect())) == want
    assert "Exchange" not in frames.pairs_from_arrays(df)._jdf.queryExecution().executedPlan().toString()


def test_components_are_thinned(spark, monkeypatch):
    lists = [[k, k + 1] for k in range(1, 60) if k % 17] + random_lists(25, n=60, m=5, longest=2) + [[61, 62, 63]] * 40
    g, _ = make(spark, lists, n=64)
    monkeypatch.setattr(tables, "THINNED_ROWS", 10)
    a, b = ({r[0]: r[1] for r in structure.connected_components(g.vertex_frame, g.members, n).collect()} for n in (0, 10**6))
    assert a == b and len(a) == 64
    r = random.Random(1)
    x, y = (np.array([r.randint(1, 40) for _ in range(200)]) for _ in range(2))
    assert len(local.forest(x, y)[0]) < 40


def test_laplacian_joins_no_pairs(spark):
    """Pairs are shuffled once, and half of them."""
    g, _ = make(spark, random_lists(26, n=12, m=15), n=14, weights=[k % 3 for k in range(15)])
    for normalized in (True, False):
        got = matrices.laplacian(g.vertex_frame, g.hyperedge_frame, g.members, normalized=normalized)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join" in line and "col_id" in line]
        assert len(joins) == 1 and "<= col_id" in joins[0] and "= col_id" not in joins[0].replace("<= col_id", "")
        cells = {(r["row_id"], r["col_id"]): r["value"] for r in got.collect()}
        assert len(cells) == got.count() and all(abs(cells[b, a] - v) < 1e-12 for (a, b), v in cells.items()) and all((v, v) in cells for v in range(1, 15))
        if not normalized:
            assert all(abs(sum(v for (a, _), v in cells.items() if a == x)) < 1e-9 for x in range(1, 15))


def test_places_follow_the_tables_size(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(tables, "parts_of", lambda df, mb=2.0: asked.append(mb) or 7)
    rows = tables.numbered(spark.range(100).withColumnRenamed("id", "v"), "v").collect()
    assert asked and sorted((r["v"], r["number"]) for r in rows) == [(k, k) for k in range(100)]
