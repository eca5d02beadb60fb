"""What plans move and hold as graphs grow, and results of the plans that keep it small."""

from itertools import combinations

from graphs import make, random_lists

from loomgraph.operators import measures, projections
from loomgraph.plans import tables


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return [line for line in plan_of(df).splitlines() if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line]


def sharing(lists, ids):
    sets = {h: set(x) for h, x in zip(ids, lists)}
    return {(a, b): len(sets[a] & sets[b]) for a, b in combinations(sorted(sets), 2) if sets[a] & sets[b]}


def test_intersections_shuffle_no_pairs(spark):
    lists = random_lists(11, n=15, m=20)
    g, ids = make(spark, lists)
    found = measures.intersections(g.members)
    assert {(r["a"], r["b"]): r["shared"] for r in found.collect()} == sharing(lists, ids)
    assert not any("b#" in x.split("hashpartitioning")[1] for x in exchanges(found))


def test_line_graph_lists(spark):
    """Numbers follow the pairs' order over many ranges and batches, and no row for a pair is shuffled or stored."""
    lists = random_lists(12, n=15, m=20)
    g, ids = make(spark, lists)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        new, pairs = projections.line_pairs(g.frames)
        rows = sorted((r["id"], r["a"], r["b"]) for r in pairs.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    at = {h: k for k, h in enumerate(ids, 1)}
    assert rows == [(len(ids) + k, at[a], at[b]) for k, (a, b) in enumerate(sorted(sharing(lists, ids)), 1)]
    assert all("hashpartitioning(range#" in x for x in exchanges(pairs))  # of the ranges' sums
    lone, none = make(spark, [[1], [2]], n=3)[0], make(spark, [], n=2)[0]
    assert projections.line_pairs(lone.frames)[1].count() == 0 and projections.line_pairs(none.frames)[1].count() == 0


def test_parts_grow_with_the_tables(spark, tmp_path):
    spark.range(2_000_000).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert tables.parts_of(df, mb=0.5) > tables.parts_of(df, mb=10**6) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_binary_file_by_pieces(spark, tmp_path, monkeypatch):
    """Many chunks and pieces give the same file's items, in order, and no row of the graph goes to the driver."""
    from pyspark.sql import DataFrame

    from loomgraph.graph import Hypergraph
    from loomgraph.sources import binary

    lists = random_lists(13, n=40, m=300)
    g, ids = make(spark, lists)
    g.update_vertex(1, {"n": "\n" * 3 + "é" * 700_000})  # longer than a chunk, and with what ends a line

    def rows_to_driver(df, *_):
        raise AssertionError("rows went to the driver")

    with monkeypatch.context() as m:
        m.setattr(DataFrame, "toLocalIterator", rows_to_driver)
        g.save(str(tmp_path / "g.bin"))
    raw = (tmp_path / "g.bin").read_bytes()
    items = list(binary.parse(raw))[1:]
    assert [x[1] for x in items] == [*range(1, 41), *ids] and [x[3] for x in items[40:]] == lists
    assert len(raw) == binary.HEADER.size + sum(8 + len(x[2]) for x in items) + sum(4 + 4 * len(x) for x in lists)
    back = Hypergraph.load(str(tmp_path / "g.bin"), spark)
    assert sorted(map(tuple, back.incidence.collect())) == sorted(map(tuple, g.incidence.collect()))
    assert back.get_vertex(1) == g.get_vertex(1) and back.vertex_frame.count() == 40
    assert sum(x[0] == "hyperedge" for x in binary.pieces(open(tmp_path / "g.bin", "rb"), 100)) > 10


def test_closure_is_kept_in_words(spark):
    """A start, a hundred middles and a hundred ends, all joined: 10 300 pairs lie in words, and plain pairs with cycles too."""
    from loomgraph.plans import tables as t
    from loomgraph.plans import traversal

    pairs = [(0, k) for k in range(1, 101)] + [(k, 1000 + e) for k in range(1, 101) for e in (k, k % 100 + 1)] + [(1000 + k, 2000 + k) for k in range(1, 101)] + [(3000, 3001), (3001, 3000), (3001, 3001)]
    edges = set(pairs)
    while new := {(a, d) for a, b in edges for c, d in edges if b == c} - edges:
        edges |= new
    rows = []
    plain, t_stored = t.appended, traversal.stored
    try:
        traversal.appended = lambda table, more: rows.append(more.count()) or plain(table, more)
        traversal.stored = lambda df, what, *x: (rows.append((kept := t_stored(df, what, *x)).count()) or kept) if what == "closure" else t_stored(df, what, *x)
        found = traversal.transitive_closure(spark.createDataFrame(pairs, "src long, dst long")).collect()
    finally:
        traversal.appended, traversal.stored = plain, t_stored
    assert sorted(map(tuple, found)) == sorted(edges)
    assert sum(rows) < len(edges)
    assert traversal.transitive_closure(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_pairs_are_dealt_by_the_tables_size(spark, monkeypatch):
    """Groups of pairs lie in as many partitions as the tables ask for, and none is held where its rows were made."""
    g, _ = make(spark, random_lists(14, n=15, m=20))
    monkeypatch.setattr(tables, "parts_of", lambda *_: 7)
    for df, keys in ((measures.pair_counts(g.members), 2), (measures.neighborhood_sizes(g.vertex_frame, g.members), 2)):
        assert any(x.split("hashpartitioning(")[1].split(")")[0].count(",") == keys and ", 7)" in x for x in exchanges(df))


def test_core_turns_move_what_fell(spark, monkeypatch):
    """A chain that falls from its end, a place a turn, beside a part that stays: turns store only what falls."""
    from graphs import plain_core

    from loomgraph.plans import structure

    lists = [[k, k + 1] for k in range(1, 9)] + [[20 + a, 20 + b, 20 + c] for a, b, c in combinations(range(6), 3)]
    g, ids = make(spark, lists, n=30)
    rows, t_stored, t_appended = [], structure.stored, structure.appended

    def appended(table, more):
        rows.append(more.count())
        return t_appended(table, more)

    monkeypatch.setattr(structure, "stored", lambda df, what, *x: (rows.append((kept := t_stored(df, what, *x)).count()) or kept))
    monkeypatch.setattr(structure, "appended", appended)
    v, h = structure.core(g.members, g.hyperedge_frame, g.vertex_frame, 2, 2)
    want = plain_core(lists, ids, 2, 2)
    assert ({r[0] for r in v.collect()}, {r[0] for r in h.collect()}) == want and want[0] == set(range(20, 26))
    members = sum(len(set(x)) for x in lists)
    assert sum(rows) < 4 * members  # a round for each place would store them all
    for s, t in ((0, 3), (11, 0), (3, 4), (0, 0), (1, 2)):
        v, h = structure.core(g.members, g.hyperedge_frame, g.vertex_frame, s, t)
        want = plain_core(lists, ids, s, t)
        got = {r[0] for r in v.collect()}, {r[0] for r in h.collect()}
        assert (got[0] if s > 0 else set(), got[1] if t > 0 else set()) == (want[0] if s > 0 else set(), want[1] if t > 0 else set())


def test_shortest_paths_move_and_store_little(spark, monkeypatch):
    """Pairs are stored without being grouped, each path once, and only pairs ahead of a round's paths are joined."""
    from loomgraph.plans import local, traversal

    pairs = [(k, k + 1, 1) for k in range(1, 30)] * 3 + [(k, 100 + k, 5) for k in range(1, 30)] + [(k, k + 1, 1) for k in range(1000, 1900)]
    df = spark.createDataFrame(pairs, "src long, dst long, weight long")
    edges, paths, seen = [], [], []
    t_stored, t_appended, t_screened = traversal.stored, traversal.appended, traversal.screened

    def stored(df, what, *x):
        (edges if what == "edges" else []).extend(exchanges(df))
        table = t_stored(df, what, *x)
        (paths if what == "paths" else []).append(table.count())
        return table

    def appended(table, more):
        paths.append(more.count())
        return t_appended(table, more)

    def screened(rows, key, keys, n, **more):
        kept = t_screened(rows, key, keys, n, **more)
        seen.append(kept.count())
        ahead = rows.join(keys, key, "left_semi")
        assert ahead.exceptAll(kept).isEmpty() and kept.exceptAll(rows).isEmpty()
        return kept

    for name, f in (("stored", stored), ("appended", appended), ("screened", screened)):
        monkeypatch.setattr(traversal, name, f)
    monkeypatch.setattr(traversal, "fits_broadcast", lambda _: False)
    found = sorted(map(tuple, traversal.shortest_paths(df, None, local_rows=0).collect()))
    best, previous = local.shortest(df.selectExpr("src", "dst", "weight as w").toPandas(), 1)
    assert found == sorted((v, *x, local.path_to(v, previous)) for v, x in best.items())
    assert not edges and sum(paths) == len(found) == 59
    assert seen and max(seen) < 10
    assert tables.screened(df, "src", df.select("src"), 1000, words=4) is df  # too many to tell apart
