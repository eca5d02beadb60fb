"""Results on small graphs whose answers are known."""

import math

import pytest
from graphs import five, make

from loomgraph.errors import CycleDetectedError
from loomgraph.functions import frames
from loomgraph.operators import measures

A, B, C, D, E, HA, HB, HC = range(1, 9)


@pytest.fixture(scope="module")
def g(spark):
    return five(spark)


def test_degrees(g):
    rows = {r["vertex_id"]: (r["indegree"], r["outdegree"]) for r in measures.degrees(g.vertex_frame, g.pairs).collect()}
    assert rows == {A: (2, 2), B: (2, 2), C: (3, 3), D: (2, 2), E: (3, 3)}
    assert g.get_vertex_indegree(C) == 3 and g.get_vertex_outdegree(D) == 2


def test_adjacency_keeps_repeats_and_order(g):
    assert g.get_vertex_adjacency_to(C) == {HA: [B], HC: [B, C]}
    assert g.get_vertex_adjacency_from(E) == {HB: [E, A], HC: [A]}


def test_point_queries(g):
    assert g.get_hyperedge_vertices(HC) == [B, C, C, E, A, D, B]
    assert g.get_vertex_hyperedges(A) == [HA, HB, HC]
    assert g.get_intersections([HA, HB, HC]) == [E, A]
    assert sorted(g.get_intersections([HB, HB])) == [A, E]
    assert [g.get_hyperedges_connecting(*x) for x in ((A, B), (B, B), (E, E))] == [[HA, HC], [HC], [HB]]
    assert g.get_endpoints() == ([(HA, A), (HB, E), (HC, B)], [(HA, E), (HB, A), (HC, B)])
    assert g.get_vertex_neighborhood(E) == [A, B, C, D]
    assert g.get_orphan_vertices() == [] and g.get_orphan_hyperedges() == []
    assert not g.is_k_uniform(3)


def test_traversal(g):
    assert [g.find_shortest_path(*x) for x in ((A, E), (B, E), (D, A), (C, B), (D, B))] == [[A, D, E], [B, C, E], [D, E, A], [C, D, B], [D, B]]
    assert g.bfs(A) == [A, B, D, C, E] and g.bfs(E) == [E, A, B, D, C]
    assert g.dfs(A) == [A, B, C, D, E] and g.dfs(C) == [C, D, E, A, B]
    assert g.find_all_paths(A, E) == [[A, D, B, C, E], [A, D, E], [A, B, C, E], [A, B, C, D, E]]
    assert g.find_all_paths(E, B) == [[E, A, D, B], [E, A, B]]
    assert g.find_all_paths(A, A) == [[A]] and g.find_shortest_path(A, A) == [A]
    assert g.is_reachable(A, A) and g.is_reachable(D, C)
    assert g.get_transitive_closure().count_hyperedges() == 25
    walk = g.random_walk(A, 6, seed=3)
    assert walk == g.random_walk(A, 6, seed=3) and len(walk) == 7 and walk[0] == A


def test_structure(g):
    assert g.is_connected() and g.get_connected_components() == [[A, B, C, D, E]]
    assert g.has_cycle() and g.find_cut_vertices() == []
    with pytest.raises(CycleDetectedError):
        g.topological_sort()


def test_projections(g):
    pairs = g.expand_to_graph()
    assert pairs.get_all_hyperedge_ids() == list(range(6, 18))
    assert [pairs.get_hyperedge_vertices(i) for i in (6, 9, 10)] == [[A, B], [D, E], [E, E]]
    star = g.expand_to_star()
    assert (star.count_vertices(), star.count_hyperedges()) == (8, 12)
    assert star.get_all_vertex_ids() == [1, 2, 3, 4, 5, 9, 15, 18]
    line = g.get_line_graph()
    assert (line.count_vertices(), line.count_hyperedges()) == (3, 3)
    dual = g.get_dual()
    assert dual.get_all_vertex_ids() == [1, 2, 3] and dual.get_all_hyperedge_ids() == [4, 5, 6, 7, 8]
    assert [dual.get_hyperedge_vertices(i) for i in (4, 5, 8)] == [[1, 2, 3], [1, 3], [1, 2, 3]]
    assert [g.get_k_skeleton(k).count_hyperedges() for k in (2, 3, 5, 7)] == [0, 1, 2, 3]
    assert g.get_vertex_induced_subhypergraph([E, A]).get_all_hyperedge_ids() == [HB]
    assert g.get_edge_induced_subhypergraph([HB]).get_all_vertex_ids() == [A, E]


def test_centrality(g):
    got = g.compute_centrality()
    assert [got[v]["degree"] for v in (A, B, C, D, E)] == pytest.approx([0.5, 0.5, 0.75, 0.5, 0.75])
    assert [got[v]["closeness"] for v in (A, B, C, D, E)] == pytest.approx([2 / 3, 0.5, 2 / 3, 2 / 3, 0.5])
    assert [got[v]["betweenness"] for v in (A, B, C, D, E)] == pytest.approx([0.25, 0.25, 0.25, 1 / 6, 0.25])


def test_page_rank(g):
    scores, sweeps, converged = g.compute_page_rank()
    assert [round(scores[v], 6) for v in (A, B, C, D, E)] == [0.240964, 0.172691, 0.172691, 0.172691, 0.240964]
    assert (sweeps, converged) == (8, True) and math.isclose(sum(scores.values()), 1)


def test_matrices(g):
    coo = g.to_incidence_matrix_coo()
    assert len(coo["rows"]) == 12 and sum(map(sum, g.to_incidence_matrix()["data"])) == 12
    plain, zhou = g.to_laplacian(normalized=False)["data"], g.to_laplacian()["data"]
    assert [plain[i][i] for i in range(5)] == pytest.approx([2.1, 1.6, 1.6, 1.6, 2.1]) and plain[0][4] == pytest.approx(-0.9) and plain[1][2] == pytest.approx(-0.4)
    assert all(sum(r) == pytest.approx(0) for r in plain)
    assert [zhou[i][i] for i in range(5)] == pytest.approx([0.7, 0.8, 0.8, 0.8, 0.7]) and zhou[0][4] == pytest.approx(-0.3) and zhou[1][3] == pytest.approx(-0.2)


def test_inclusions(g, spark):
    assert g.get_inclusions() == [(HB, HA), (HB, HC)]
    nested, ids = make(spark, [[1, 2], [1, 2, 3], [1, 2, 3, 4]])
    assert len(nested.get_inclusions()) == 3
    assert [(r["size"], r["included"], r["total"]) for r in nested.get_nestedness_profile()] == [(2, 1, 1), (3, 1, 1), (4, 0, 1)]


def test_core_and_cut_vertices(spark):
    path, _ = make(spark, [[1, 2], [2, 3], [3, 4]])
    assert path.get_core(2, 2).count_vertices() == 0
    triangle, _ = make(spark, [[1, 2], [2, 3], [1, 3]])
    assert triangle.get_core(2, 2).count_hyperedges() == 3 and triangle.get_core(3, 2).count_hyperedges() == 0
    tail, _ = make(spark, [[1, 2, 3], [3, 4], [4, 5]])
    assert tail.find_cut_vertices() == [3, 4] and tail.topological_sort() == [1, 2, 3, 4, 5]
    chain, _ = make(spark, [[i, i + 1] for i in range(1, 1000)])
    assert chain.find_shortest_path(1, 1000) == list(range(1, 1001)) and len(chain.find_cut_vertices()) == 998


def test_weights(spark):
    g, _ = make(spark, [[1, 2, 4], [1, 3, 4]], weights=[5, 1])
    assert g.find_shortest_path(1, 4) == [1, 3, 4]
    light, _ = make(spark, [[1, 2]], weights=[3])
    assert light.to_laplacian(normalized=False)["data"] == [[1.5, -1.5], [-1.5, 1.5]]


def test_long_hyperedges_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(frames, "BLOCK", 3)
    rows = spark.createDataFrame([(h, p, p * 7 % 10) for h in (1, 2) for p in range(3 * h + 1)], "hyperedge_id long, pos long, vertex_id long")
    got = sorted((r["hyperedge_id"], r["pos"], r["src"], r["dst"]) for r in frames.pairs_of(rows).collect())
    assert got == [(h, p, p * 7 % 10, (p + 1) * 7 % 10) for h in (1, 2) for p in range(3 * h)]
