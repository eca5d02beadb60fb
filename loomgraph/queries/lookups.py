"""Queries of degrees, adjacency, neighbourhoods, endpoints, orphans and fluent filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import frames
from loomgraph.graph import Hypergraph
from loomgraph.operators import measures

from .inputs import orders, with_sql


def degrees(spark, sf_dir):
    g = orders(spark, sf_dir)
    return measures.degrees(g.vertices, frames.pairs_of(g.incidence))


def adjacency_to(spark, sf_dir):
    adjacent = measures.adjacency(frames.pairs_of(orders(spark, sf_dir).incidence), to=True)
    return adjacent.select("vertex_id", "hyperedge_id", F.array_join(F.transform("adjacent", lambda x: x.cast("string")), ",").alias("adjacent"))


def adjacency_from(spark, sf_dir):
    adjacent = measures.adjacency(frames.pairs_of(orders(spark, sf_dir).incidence), to=False)
    return adjacent.select("vertex_id", "hyperedge_id", F.array_join(F.transform("adjacent", lambda x: x.cast("string")), ",").alias("adjacent"))


def neighborhood_size(spark, sf_dir):
    g = orders(spark, sf_dir)
    return measures.neighborhood_sizes(g.vertices, frames.members_of(g.incidence))


def vertex_hyperedges(spark, sf_dir):
    g = orders(spark, sf_dir)
    return measures.vertex_hyperedge_counts(g.vertices, frames.members_of(g.incidence))


def endpoints(spark, sf_dir):
    return measures.endpoints(orders(spark, sf_dir).incidence)


def orphan_hyperedges(spark, sf_dir):
    g = orders(spark, sf_dir)
    return measures.orphan_hyperedges(g.hyperedges, g.incidence)


def orphan_vertices(spark, sf_dir):
    g = orders(spark, sf_dir)
    return measures.orphan_vertices(g.vertices, g.incidence)


def intersections(spark, sf_dir):
    """Vertices that are in both of two orders, for all pairs of orders that share one."""
    return measures.intersections(frames.members_of(orders(spark, sf_dir).incidence))


def connecting(spark, sf_dir):
    return measures.pair_counts(frames.members_of(orders(spark, sf_dir).incidence))


def uniformity(spark, sf_dir):
    g = orders(spark, sf_dir)
    return measures.size_counts(g.hyperedges, frames.sizes_of(g.incidence))


def fluent_where(spark, sf_dir):
    """Parts of a size above 25, and how many orders each is in."""
    g = Hypergraph(spark, orders(spark, sf_dir), last_id=0)
    chosen = g.vertices().where(F.col("data.p_size") > 25).where("data.p_brand <> 'Brand#11'").frame()
    return measures.vertex_hyperedge_counts(chosen, g.members)


def fluent_neighbors(spark, sf_dir):
    """Parts of size 1 that share an order with another part."""
    g = Hypergraph(spark, orders(spark, sf_dir), last_id=0)
    g.build()
    return g.vertices().neighbors().where("data.p_size = 1").frame().select("id")


def fluent_containing(spark, sf_dir):
    """Orders that hold the part of the smallest key, with their total price's rounding."""
    g = Hypergraph(spark, orders(spark, sf_dir), last_id=0)
    g.build()
    first = g.vertex_frame.agg(F.min("id")).first()[0]
    return g.hyperedges().containing(first).frame().select("id", F.col("data.o_orderstatus").alias("status"))


def fluent_limit(spark, sf_dir):
    """The ten smallest keys of finished orders."""
    g = Hypergraph(spark, orders(spark, sf_dir), last_id=0)
    return g.hyperedges().where(F.col("data.o_orderstatus") == "F").limit(10).frame().select("id", "weight")


def _built(spark, sf_dir):
    g = Hypergraph(spark, orders(spark, sf_dir), last_id=0)
    g.build()
    return g


def neighborhood_order(spark, sf_dir):
    """The neighbours of the smallest part in the order they are met."""
    g = _built(spark, sf_dir)
    found = g.get_vertex_neighborhood(int(g.members.agg(F.min("vertex_id")).first()[0]))
    return spark.createDataFrame(list(enumerate(found)), "number long, vertex_id long")


def intersection_of(spark, sf_dir):
    """What all orders of the smallest part share, in the order of the last of them."""
    g = _built(spark, sf_dir)
    found = g.get_intersections(g.get_vertex_hyperedges(int(g.members.agg(F.min("vertex_id")).first()[0])))
    return spark.createDataFrame(list(enumerate(found)), "number long, vertex_id long")


def connecting_pair(spark, sf_dir):
    """The orders that hold both the first and the last part of the first order with two parts."""
    g = _built(spark, sf_dir)
    places = g.get_hyperedge_vertices(int(g.incidence.where("pos = 1").agg(F.min("hyperedge_id")).first()[0]))
    return spark.createDataFrame([(h,) for h in g.get_hyperedges_connecting(places[0], places[-1])], "hyperedge_id long")


def point_reads(spark, sf_dir):
    """Counts, payloads and lists of the first part and the first order, by the graph's own calls."""
    g = _built(spark, sf_dir)
    v, h = g.vertices().limit(1).ids()[0], g.hyperedges().limit(1).ids()[0]
    row = (g.count_vertices(), g.count_hyperedges(), g.get_vertex(v)["p_brand"], g.get_hyperedge(h)["o_orderstatus"], ",".join(map(str, g.get_hyperedge_vertices(h))), ",".join(map(str, g.get_vertex_hyperedges(v))), g.get_vertex_indegree(v), g.get_vertex_outdegree(v))
    return spark.createDataFrame([row], "vertices long, hyperedges long, brand string, status string, places string, orders string, indegree long, outdegree long")


QUERIES = {f.__name__: f for f in (degrees, adjacency_to, adjacency_from, neighborhood_size, vertex_hyperedges, endpoints, orphan_hyperedges, orphan_vertices, intersections, connecting, uniformity, fluent_where, fluent_neighbors, fluent_containing, fluent_limit, neighborhood_order, intersection_of, connecting_pair, point_reads)}
ORACLE_SQL = {
    "degrees": with_sql("orders", """
SELECT v AS vertex_id, coalesce(i, 0)::BIGINT AS indegree, coalesce(o, 0)::BIGINT AS outdegree FROM verts
LEFT JOIN (SELECT dst AS v, count(*) AS i FROM prs GROUP BY dst) USING (v) LEFT JOIN (SELECT src AS v, count(*) AS o FROM prs GROUP BY src) USING (v)
"""),
    "adjacency_to": with_sql("orders", "SELECT dst AS vertex_id, h AS hyperedge_id, string_agg(src::VARCHAR, ',' ORDER BY pos) AS adjacent FROM prs GROUP BY dst, h"),
    "adjacency_from": with_sql("orders", "SELECT src AS vertex_id, h AS hyperedge_id, string_agg(dst::VARCHAR, ',' ORDER BY pos) AS adjacent FROM prs GROUP BY src, h"),
    "neighborhood_size": with_sql("orders", "SELECT v AS vertex_id, coalesce(n, 0)::BIGINT AS neighbors FROM verts LEFT JOIN (SELECT a.v, count(DISTINCT b.v) AS n FROM mem a JOIN mem b ON a.h = b.h AND a.v <> b.v GROUP BY a.v) USING (v)"),
    "vertex_hyperedges": with_sql("orders", "SELECT v AS vertex_id, coalesce(n, 0)::BIGINT AS hyperedges FROM verts LEFT JOIN (SELECT v, count(*) AS n FROM mem GROUP BY v) USING (v)"),
    "endpoints": with_sql("orders", "SELECT h AS hyperedge_id, arg_min(v, pos) AS initial, arg_max(v, pos) AS terminal FROM inc GROUP BY h"),
    "orphan_hyperedges": with_sql("orders", "SELECT h AS hyperedge_id FROM edges WHERE h NOT IN (SELECT h FROM inc)"),
    "orphan_vertices": with_sql("orders", "SELECT v AS vertex_id FROM verts WHERE v NOT IN (SELECT v FROM inc)"),
    "intersections": with_sql("orders", "SELECT a.h AS a, b.h AS b, count(*) AS shared FROM mem a JOIN mem b ON a.v = b.v AND a.h < b.h GROUP BY ALL"),
    "connecting": with_sql("orders", "SELECT a.v AS a, b.v AS b, count(*) AS hyperedges FROM mem a JOIN mem b ON a.h = b.h AND a.v < b.v GROUP BY ALL"),
    "uniformity": with_sql("orders", "SELECT coalesce(n, 0)::BIGINT AS length, count(*) AS hyperedges FROM edges LEFT JOIN (SELECT h, count(*) AS n FROM inc GROUP BY h) USING (h) GROUP BY ALL"),
    "fluent_where": with_sql("orders", "SELECT p_partkey AS vertex_id, count(mem.h) AS hyperedges FROM part LEFT JOIN mem ON v = p_partkey WHERE p_size > 25 AND p_brand <> 'Brand#11' GROUP BY ALL"),
    "fluent_neighbors": with_sql("orders", "SELECT p_partkey AS id FROM part WHERE p_size = 1 AND p_partkey IN (SELECT a.v FROM mem a JOIN mem b ON a.h = b.h AND a.v <> b.v)"),
    "fluent_containing": with_sql("orders", "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey IN (SELECT h FROM mem WHERE v = (SELECT min(v) FROM verts))"),
    "neighborhood_order": with_sql("orders", """
s AS (SELECT min(v) AS v FROM mem), n AS (SELECT b.v, min((b.h, b.first_pos)) AS k FROM mem a JOIN s ON a.v = s.v JOIN mem b ON b.h = a.h AND b.v <> a.v GROUP BY b.v)
SELECT row_number() OVER (ORDER BY k) - 1 AS number, v AS vertex_id FROM n"""),
    "intersection_of": with_sql("orders", """
s AS (SELECT min(v) AS v FROM mem), hs AS (SELECT h FROM mem JOIN s USING (v)), n AS (SELECT v, arg_max(first_pos, h) AS p FROM mem JOIN hs USING (h) GROUP BY v HAVING count(*) = (SELECT count(*) FROM hs))
SELECT row_number() OVER (ORDER BY p) - 1 AS number, v AS vertex_id FROM n"""),
    "connecting_pair": with_sql("orders", """
f AS (SELECT min(h) AS h FROM inc WHERE pos = 1), e AS (SELECT arg_min(v, pos) AS a, arg_max(v, pos) AS b FROM inc JOIN f USING (h))
SELECT mem.h AS hyperedge_id FROM mem, e WHERE v IN (a, b) GROUP BY mem.h HAVING count(*) = 2 OR (max(times) > 1 AND any_value(a) = any_value(b))"""),
    "point_reads": with_sql("orders", """
a AS (SELECT min(v) AS v FROM verts), b AS (SELECT min(h) AS h FROM edges)
SELECT (SELECT count(*) FROM part) AS vertices, (SELECT count(*) FROM orders) AS hyperedges, (SELECT p_brand FROM part JOIN a ON p_partkey = v) AS brand, (SELECT o_orderstatus FROM orders JOIN b ON o_orderkey = h) AS status,
  coalesce((SELECT string_agg(v::VARCHAR, ',' ORDER BY pos) FROM inc JOIN b USING (h)), '') AS places, coalesce((SELECT string_agg(h::VARCHAR, ',' ORDER BY h) FROM mem JOIN a USING (v)), '') AS orders,
  (SELECT count(*) FROM prs WHERE dst = (SELECT v FROM a)) AS indegree, (SELECT count(*) FROM prs WHERE src = (SELECT v FROM a)) AS outdegree"""),
    "fluent_limit": "SELECT o_orderkey AS id, substr(o_orderpriority, 1, 1)::BIGINT AS weight FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 10",
}
