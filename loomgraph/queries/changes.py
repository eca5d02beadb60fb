"""Queries of edits: one edit of the whole order hypergraph, and what its incidences are then."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.graph import Hypergraph
from loomgraph.operators import edits

from .inputs import orders, with_sql


def _graph(spark, sf_dir) -> tuple[Hypergraph, int, int, int]:
    """The graph built, its first order with a line, and that order's first and last part."""
    g = Hypergraph(spark, orders(spark, sf_dir), last_id=0)
    g.build()
    h = int(g.incidence.agg(F.min("hyperedge_id")).first()[0])
    places = g.get_hyperedge_vertices(h)
    return g, h, places[0], places[-1]


def _new_id(g: Hypergraph) -> int:
    g._last_id = g._largest_id()
    return g._last_id + 1


def edit_append(spark, sf_dir):
    g, h, a, b = _graph(spark, sf_dir)
    g.append_vertices(h, [a, b, a])
    return g.incidence


def edit_prepend(spark, sf_dir):
    g, h, a, b = _graph(spark, sf_dir)
    g.prepend_vertices(h, [b, a])
    return g.incidence


def edit_insert(spark, sf_dir):
    g, h, a, b = _graph(spark, sf_dir)
    g.insert_vertices(h, [b, b], 1)
    return g.incidence


def edit_delete_vertex(spark, sf_dir):
    g, _, a, _ = _graph(spark, sf_dir)
    g.delete_vertex(a)
    return g.incidence


def edit_delete_at_index(spark, sf_dir):
    g, h, _, _ = _graph(spark, sf_dir)
    g.delete_vertex_at_index(h, 0)
    return g.incidence


def edit_delete_hyperedge(spark, sf_dir):
    """With all its members, which go from every other order."""
    g, h, _, _ = _graph(spark, sf_dir)
    g.delete_hyperedge(h, drop_vertices=True)
    return g.incidence


def edit_reverse(spark, sf_dir):
    return edits.reverse_all(orders(spark, sf_dir).incidence)


def edit_reverse_one(spark, sf_dir):
    g, h, _, _ = _graph(spark, sf_dir)
    g.reverse_hyperedge(h)
    return g.incidence


def edit_delete_from_hyperedge(spark, sf_dir):
    g, h, a, _ = _graph(spark, sf_dir)
    g.delete_vertex_from_hyperedge(h, a)
    return g.incidence


def edit_in_turn(spark, sf_dir):
    """A hundred appends, a prepend, an insertion, a deletion and a reversal of the first order, and a new one."""
    g, h, a, b = _graph(spark, sf_dir)
    _new_id(g)
    for _ in range(100):
        g.append_vertex(h, b)
    g.prepend_vertex(h, a)
    g.insert_vertex(h, b, 1)
    g.delete_vertex_at_index(h, 0)
    g.reverse_hyperedge(h)
    g.append_vertices(g.create_hyperedge(), [b, a])
    return g.incidence


def edit_payloads(spark, sf_dir):
    """Orders after the first got a new payload and weight, and another's tail went to a new order with its own."""
    g, h, _, _ = _graph(spark, sf_dir)
    _new_id(g)
    g.update_hyperedge(h, {"o_orderstatus": "U", "o_totalprice": 2.5}, weight=9)
    g.split_hyperedge(int(g.incidence.where("pos = 1").agg(F.min("hyperedge_id")).first()[0]), 1, {"o_orderstatus": "N", "o_totalprice": 1.5})
    return g.hyperedge_frame.select("id", "weight", F.col("data.o_orderstatus").alias("status"), F.col("data.o_totalprice").cast("double").alias("price"))


def edit_vertex_payloads(spark, sf_dir):
    """Parts after the first order's first one got a new payload and was split, and one more was created."""
    g, h, a, _ = _graph(spark, sf_dir)
    _new_id(g)
    g.update_vertex(a, {"p_brand": "new", "p_size": 7})
    g.split_vertex(a, [h], {"p_brand": "split", "p_size": 8})
    g.create_vertex()
    return g.vertex_frame.select("id", F.col("data.p_brand").alias("brand"), F.col("data.p_size").cast("long").alias("size"))


def edit_merge_hyperedges(spark, sf_dir):
    """The first order and the next two with lines, as one."""
    g, h, _, _ = _graph(spark, sf_dir)
    ids = [r[0] for r in g.incidence.select("hyperedge_id").distinct().orderBy("hyperedge_id").limit(3).collect()]
    g.merge_hyperedges(ids)
    return g.incidence


def edit_split_hyperedge(spark, sf_dir):
    """The first order of two lines or more, from its second line on, as a new one."""
    g, _, _, _ = _graph(spark, sf_dir)
    _new_id(g)
    g.split_hyperedge(int(g.incidence.where("pos = 1").agg(F.min("hyperedge_id")).first()[0]), 1)
    return g.incidence


def edit_split_vertex(spark, sf_dir):
    g, h, a, _ = _graph(spark, sf_dir)
    _new_id(g)
    g.split_vertex(a, [h])
    return g.incidence


def edit_merge_vertices(spark, sf_dir):
    """The three smallest parts as one."""
    g, _, _, _ = _graph(spark, sf_dir)
    g.merge_vertices([r[0] for r in g.vertex_frame.select("id").orderBy("id").limit(3).collect()])
    return g.incidence


def edit_contract(spark, sf_dir):
    g, h, _, _ = _graph(spark, sf_dir)
    g.contract_hyperedge(h)
    return g.incidence


def save_load(spark, sf_dir):
    """Written as Parquet to the shared folder and read again."""
    from uuid import uuid4

    from loomgraph.plans.tables import shared_dir

    g = Hypergraph(spark, orders(spark, sf_dir), last_id=0)
    path = f"{shared_dir(spark)}/saved-{uuid4().hex}"
    g.write_parquet(path)
    return Hypergraph.read_parquet(path, spark).incidence


def binary_round_trip(spark, sf_dir):
    """Written as one binary file to the shared folder and read again."""
    from uuid import uuid4

    from loomgraph.plans.tables import shared_dir

    g = Hypergraph(spark, orders(spark, sf_dir), last_id=0)
    path = f"{shared_dir(spark)}/saved-{uuid4().hex}.bin"
    g.save(path)
    return Hypergraph.load(path, spark).incidence


QUERIES = {f.__name__: f for f in (edit_append, edit_prepend, edit_insert, edit_delete_vertex, edit_delete_at_index, edit_delete_hyperedge, edit_reverse, edit_reverse_one, edit_delete_from_hyperedge, edit_in_turn, edit_payloads, edit_vertex_payloads, edit_merge_hyperedges, edit_split_hyperedge, edit_split_vertex, edit_merge_vertices, edit_contract, save_load, binary_round_trip)}

_FIRST = """
f AS (SELECT min(h) AS h FROM inc), fp AS (SELECT inc.h, arg_min(v, pos) AS a, arg_max(v, pos) AS b, count(*) AS n FROM inc JOIN f USING (h) GROUP BY inc.h)"""
_RANKED = "SELECT h AS hyperedge_id, row_number() OVER (PARTITION BY h ORDER BY pos) - 1 AS pos, v AS vertex_id FROM "
_PLAIN = "SELECT h AS hyperedge_id, pos, v AS vertex_id FROM "


def _runs(rows: str, vertex: str) -> str:
    """Runs of one vertex as one place, in the orders that ``touched`` lists."""
    return f"""{rows},
lagged AS (SELECT *, lag(v) OVER (PARTITION BY h ORDER BY pos) AS before FROM new),
left_over AS (SELECT h, pos, v FROM lagged WHERE NOT (h IN (SELECT h FROM touched) AND v = {vertex} AND before IS NOT DISTINCT FROM {vertex}))
{_RANKED} left_over"""


ORACLE_SQL = {
    "edit_append": with_sql("orders", f"{_FIRST} {_PLAIN} (SELECT h, pos, v FROM inc UNION ALL SELECT h, n + k, [a, b, a][k + 1] FROM fp, (SELECT unnest([0, 1, 2]) AS k))"),
    "edit_prepend": with_sql("orders", f"{_FIRST} {_PLAIN} (SELECT inc.h, pos + CASE WHEN inc.h = f.h THEN 2 ELSE 0 END AS pos, v FROM inc, f UNION ALL SELECT h, k, [b, a][k + 1] FROM fp, (SELECT unnest([0, 1]) AS k))"),
    "edit_insert": with_sql("orders", f"{_FIRST} {_PLAIN} (SELECT inc.h, pos + CASE WHEN inc.h = f.h AND pos >= 1 THEN 2 ELSE 0 END AS pos, v FROM inc, f UNION ALL SELECT h, k, b FROM fp, (SELECT unnest([1, 2]) AS k))"),
    "edit_delete_vertex": with_sql("orders", f"{_FIRST} {_RANKED} inc WHERE v <> (SELECT a FROM fp)"),
    "edit_delete_at_index": with_sql("orders", f"{_FIRST} {_RANKED} inc WHERE NOT (h = (SELECT h FROM f) AND pos = 0)"),
    "edit_delete_hyperedge": with_sql("orders", f"{_FIRST} {_RANKED} inc WHERE h <> (SELECT h FROM f) AND v NOT IN (SELECT v FROM inc JOIN f USING (h))"),
    "edit_reverse": with_sql("orders", "SELECT h AS hyperedge_id, row_number() OVER (PARTITION BY h ORDER BY pos DESC) - 1 AS pos, v AS vertex_id FROM inc"),
    "edit_reverse_one": with_sql("orders", f"{_FIRST} {_PLAIN} (SELECT inc.h, CASE WHEN inc.h = fp.h THEN n - 1 - pos ELSE pos END AS pos, v FROM inc, fp)"),
    "edit_delete_from_hyperedge": with_sql("orders", f"{_FIRST} {_RANKED} inc WHERE NOT (h = (SELECT h FROM f) AND v = (SELECT a FROM fp))"),
    "edit_in_turn": with_sql("orders", f"""{_FIRST},
x AS (SELECT h, -2 AS pos, b AS v FROM fp UNION ALL SELECT inc.h, pos, v FROM inc JOIN f USING (h) UNION ALL SELECT h, n + k, b FROM fp, (SELECT unnest(range(100)) AS k))
SELECT h AS hyperedge_id, row_number() OVER (ORDER BY pos DESC) - 1 AS pos, v AS vertex_id FROM x UNION ALL SELECT h, pos, v FROM inc WHERE h <> (SELECT h FROM f)
UNION ALL SELECT greatest((SELECT max(v) FROM verts), (SELECT max(h) FROM edges)) + 1, k, [b, a][k + 1] FROM fp, (SELECT unnest([0, 1]) AS k)"""),
    "edit_payloads": with_sql("orders", f"""{_FIRST}
SELECT o_orderkey AS id, CASE WHEN o_orderkey = f.h THEN 9 ELSE substr(o_orderpriority, 1, 1)::BIGINT END AS weight, CASE WHEN o_orderkey = f.h THEN 'U' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey = f.h THEN 2.5 ELSE o_totalprice::DOUBLE END AS price FROM orders, f
UNION ALL SELECT greatest((SELECT max(v) FROM verts), (SELECT max(h) FROM edges)) + 1, 1, 'N', 1.5"""),
    "edit_vertex_payloads": with_sql("orders", f"""{_FIRST},
m AS (SELECT greatest((SELECT max(v) FROM verts), (SELECT max(h) FROM edges)) AS m)
SELECT p_partkey AS id, CASE WHEN p_partkey = a THEN 'new' ELSE p_brand END AS brand, CASE WHEN p_partkey = a THEN 7 ELSE p_size::BIGINT END AS size FROM part, fp
UNION ALL SELECT m + 1, 'split', 8 FROM m UNION ALL SELECT m + 2, NULL, NULL FROM m"""),
    "edit_merge_hyperedges": with_sql("orders", """t AS (SELECT DISTINCT h FROM inc ORDER BY h LIMIT 3)
SELECT g AS hyperedge_id, row_number() OVER (PARTITION BY g ORDER BY h, pos) - 1 AS pos, v AS vertex_id FROM (SELECT *, CASE WHEN h IN (SELECT h FROM t) THEN (SELECT min(h) FROM t) ELSE h END AS g FROM inc)"""),
    "edit_split_hyperedge": with_sql("orders", f"""t AS (SELECT min(h) AS t FROM inc WHERE pos = 1)
{_PLAIN} (SELECT CASE WHEN h = t AND pos >= 1 THEN greatest((SELECT max(v) FROM verts), (SELECT max(h) FROM edges)) + 1 ELSE h END AS h, CASE WHEN h = t AND pos >= 1 THEN pos - 1 ELSE pos END AS pos, v FROM inc, t)"""),
    "edit_split_vertex": with_sql("orders", f"{_FIRST} {_PLAIN} (SELECT inc.h, pos, CASE WHEN inc.h = fp.h AND v = a THEN greatest((SELECT max(v) FROM verts), (SELECT max(h) FROM edges)) + 1 ELSE v END AS v FROM inc, fp)"),
    "edit_merge_vertices": with_sql("orders", _runs("""t AS (SELECT v FROM verts ORDER BY v LIMIT 3), p AS (SELECT min(v) AS p FROM t),
touched AS (SELECT DISTINCT h FROM inc WHERE v IN (SELECT v FROM t) AND v <> (SELECT p FROM p)),
new AS (SELECT h, pos, CASE WHEN v IN (SELECT v FROM t) THEN (SELECT p FROM p) ELSE v END AS v FROM inc)""", "(SELECT p FROM p)")),
    "edit_contract": with_sql("orders", _runs(f"""{_FIRST},
hit AS (SELECT DISTINCT h, dst AS v FROM prs WHERE h <> (SELECT h FROM f) AND dst IN (SELECT v FROM inc JOIN f USING (h))),
touched AS (SELECT DISTINCT h FROM hit),
new AS (SELECT inc.h, pos, CASE WHEN hit.v IS NULL THEN inc.v ELSE (SELECT b FROM fp) END AS v FROM inc LEFT JOIN hit ON hit.h = inc.h AND hit.v = inc.v WHERE inc.h <> (SELECT h FROM f))""", "(SELECT b FROM fp)")),
    "save_load": with_sql("orders", f"{_PLAIN} inc"),
    "binary_round_trip": with_sql("orders", f"{_PLAIN} inc"),
}
