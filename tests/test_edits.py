"""Edits of relations, their errors, and the lifecycle."""

import pytest
from graphs import five

from loomgraph import errors
from loomgraph.graph import Hypergraph

A, B, C, D, E, HA, HB, HC = range(1, 9)


@pytest.fixture(scope="module")
def base(spark):
    return five(spark)


@pytest.fixture
def g(base):
    x = base.clone()
    x._members, x._pairs = base._members, base._pairs
    return x


def lists(g):
    return [g.get_hyperedge_vertices(h) for h in g.get_all_hyperedge_ids()]


def test_insertions(g):
    g.append_vertices(HB, [C, D])
    g.prepend_vertices(HB, [B, A])
    g.insert_vertex(HB, E, 1)
    assert g.get_hyperedge_vertices(HB) == [B, E, A, E, E, A, C, D]
    g.append_vertices(99, [])
    with pytest.raises(errors.NotEnoughVerticesError):
        g.insert_vertices(HB, [], 0)
    with pytest.raises(errors.IndexOutOfBoundsError):
        g.insert_vertices(HB, [A], 9)
    with pytest.raises(errors.HyperedgeNotFoundError):
        g.append_vertices(99, [A])
    with pytest.raises(errors.VertexNotFoundError):
        g.append_vertices(HB, [99])


def test_removals(g):
    g.delete_vertex_from_hyperedge(HC, C)
    g.delete_vertex_at_index(HB, 1)
    assert lists(g) == [[A, B, C, D, E], [E, A], [B, E, A, D, B]]
    g.delete_vertex(E)
    assert lists(g) == [[A, B, C, D], [A], [B, A, D, B]]
    with pytest.raises(errors.IndexOutOfBoundsError):
        g.delete_vertex_at_index(HB, 1)
    g.delete_hyperedge(HB, drop_vertices=True)
    assert lists(g) == [[B, C, D], [B, D, B]] and g.get_all_vertex_ids() == [B, C, D]


def test_delete_hyperedge_keeps_vertices(g):
    g.delete_hyperedge(HC)
    assert g.get_all_hyperedge_ids() == [HA, HB] and g.count_vertices() == 5
    assert g.get_vertex_hyperedges(A) == [HA, HB]


def test_reverse_merge_split(g):
    g.reverse_hyperedge(HA)
    assert g.get_hyperedge_vertices(HA) == [E, D, C, B, A]
    g.reverse_hyperedge(HA)
    new = g.split_hyperedge(HA, 2, {"x": 1})
    assert (g.get_hyperedge_vertices(HA), g.get_hyperedge_vertices(new)) == ([A, B], [C, D, E])
    g.merge_hyperedges([HA, new])
    g.merge_hyperedges([HA, HC])
    assert g.get_hyperedge_vertices(HA) == [A, B, C, D, E, B, C, C, E, A, D, B]
    for at in (0, 12):
        with pytest.raises(errors.IndexOutOfBoundsError):
            g.split_hyperedge(HA, at)
    with pytest.raises(errors.NotEnoughHyperedgesError):
        g.merge_hyperedges([HA])


def test_contract(g):
    g.contract_hyperedge(HB)
    assert lists(g) == [[A, B, C, D, A], [B, C, C, A, D, B]]


def test_merge_and_split_vertices(g):
    g.merge_vertices([B, C])
    assert lists(g) == [[A, B, D, E], [E, E, A], [B, E, A, D, B]] and g.get_all_vertex_ids() == [A, B, D, E]
    new = g.split_vertex(A, [HB], {})
    assert g.get_hyperedge_vertices(HB) == [E, E, new] and g.get_hyperedge_vertices(HA)[0] == A
    with pytest.raises(errors.NotEnoughVerticesError):
        g.merge_vertices([B])
    with pytest.raises(errors.NotEnoughHyperedgesError):
        g.split_vertex(A, [])


def test_ids_and_payloads(spark):
    g = Hypergraph(spark)
    v, h = g.create_vertex({"name": "héllo", "tags": [1, {"x": 2.5}]}), g.create_hyperedge({"t": None}, weight=4)
    assert (v, h) == (1, 2) and g.get_vertex(v) == {"name": "héllo", "tags": [1, {"x": 2.5}]}
    g.update_vertex(v, {"a": 1})
    g.update_hyperedge(h, {"b": 2})
    assert (g.get_vertex(v), g.get_hyperedge(h)) == ({"a": 1}, {"b": 2})
    g.clear()
    assert g.count_vertices() == 0 and g.create_vertex() == 3


def test_calls_that_need_a_build(spark):
    g = Hypergraph(spark)
    v = g.create_vertex()
    for call in (lambda: g.get_vertex_hyperedges(v), lambda: g.bfs(v), g.has_cycle, g.get_dual, g.clone, g.get_orphan_vertices, g.compute_page_rank, lambda: g.vertices().neighbors()):
        with pytest.raises(errors.NotBuiltError):
            call()
    g.build()
    assert g.bfs(v) == [v] and g.get_orphan_vertices() == [v] and g.is_connected() and g.is_k_uniform(3)
    assert g.find_cut_vertices() == [] and not g.has_cycle() and g.topological_sort() == [v]
    with pytest.raises(errors.VertexNotFoundError):
        g.bfs(99)
    with pytest.raises(errors.NotEnoughHyperedgesError):
        g.get_intersections([1])


def test_empty_graph(spark):
    g = Hypergraph(spark)
    g.build()
    assert g.is_connected() and g.get_connected_components() == [] and g.compute_page_rank() == ({}, 0, True)
    assert g.get_inclusions() == [] and g.compute_centrality() == {} and g.topological_sort() == []


def test_fluent(base):
    q = base.vertices()
    assert q.where(lambda d: d["n"] > 2).limit(2).ids() == [3, 4]
    assert q.where("get_json_object(data, '$.n') > 2").where(lambda d: d["n"] < 5).data() == [{"n": 3}, {"n": 4}]
    assert q.neighbors().ids() == [A, B, C, D, E] and q.limit(0).ids() == []
    assert base.hyperedges().containing(C).ids() == [HA, HC] and base.hyperedges().containing(C).containing(E).limit(1).ids() == [HA]


def test_lists_too_long_for_the_driver(g, monkeypatch):
    """Edits as plans give what edits of opened lists give."""
    from loomgraph import graph

    def edit(x):
        x.append_vertices(HB, [C, D])
        x.prepend_vertex(HB, B)
        x.insert_vertex(HB, E, 1)
        x.delete_vertex_at_index(HB, 0)
        x.reverse_hyperedge(HB)
        x.delete_vertex_from_hyperedge(HB, C)
        return lists(x)

    other = Hypergraph(g.spark, g.frames)
    other._members, other._pairs = g._members, g._pairs
    want = edit(g)
    monkeypatch.setattr(graph, "OPEN_POSITIONS", 0)
    assert edit(other) == want


def test_first_ids_are_not_all_fetched(spark, monkeypatch):
    """The query of point reads finds the first part and order without every id on the driver."""
    from loomgraph.graph import Hypergraph
    from loomgraph.queries import QUERIES

    def all_ids(g):
        raise AssertionError("every id went to the driver")

    monkeypatch.setattr(Hypergraph, "get_all_vertex_ids", all_ids)
    monkeypatch.setattr(Hypergraph, "get_all_hyperedge_ids", all_ids)
    assert QUERIES["point_reads"](spark, "/root/testdata/sf0.001").count() == 1
