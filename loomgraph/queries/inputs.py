"""Hypergraphs over the provided tables, and the same as SQL common table expressions.

orders: an order is a hyperedge, its parts are the vertices, by line; all parts and orders, weight by priority.
sizes: a brand is a hyperedge, the distinct sizes of its parts its vertices, rising, so there is no cycle.
customers: see the function.
chains: a hyperedge for each line, from nation to supplier; grows with the tables and has no cycle.
nations: a region's nations are a hyperedge, and so are those of each five successive keys; weight 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.frames import incidence_from_table, pairs_from_arrays
from loomgraph.operators.projections import Frames

ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> Frames:
    vertices = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.struct("p_brand", "p_size").alias("data"))
    weight = F.substring("o_orderpriority", 1, 1).cast("long").alias("weight")
    hyperedges = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), weight, F.struct("o_orderstatus", "o_totalprice").alias("data"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *ORDER)
    return Frames(vertices, hyperedges, incidence_from_table(lines, "l_orderkey", "l_partkey", ORDER))


def sizes(spark: SparkSession, sf_dir: str) -> Frames:
    brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("long").alias("h")
    rows = table(spark, sf_dir, "part").select(brand, F.col("p_size").cast("long").alias("v")).distinct()
    return _unweighted(rows)


def chains(spark: SparkSession, sf_dir: str) -> Frames:
    """A hyperedge for each line number of an order: the customer's nation, the customer, the order, the least part and
    the least supplier. Ids are keys times eight and the kind, so pairs lead from kind to kind and there is no cycle."""
    whole = _chain_lists(spark, sf_dir)
    rows = whole.select("h", F.posexplode("members").alias("pos", "v"))
    none = F.lit(None).cast("string").alias("data")
    hyperedges = rows.select(F.col("h").alias("id")).distinct().select("id", F.lit(1).cast("long").alias("weight"), none)
    return Frames(rows.select(F.col("v").alias("id")).distinct().select("id", none), hyperedges, incidence_from_table(rows, "h", "v", [], pos="pos"))


def chain_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consecutive pairs of :func:`chains`, from its lists."""
    return pairs_from_arrays(_chain_lists(spark, sf_dir), "h", "members")


def _chain_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(h, members). Lines are dealt by order, and not again as they meet orders and customers."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").repartition("l_orderkey")
    line = line.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    order = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    owned = order.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    kinds = ("c_nationkey", "c_custkey", "l_orderkey", "l_partkey", "l_suppkey")
    members = F.array(*(F.col(c).cast("long") * 8 + k for k, c in enumerate(kinds)))
    return line.join(owned, "l_orderkey").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("h"), members.alias("members"))


def nations(spark: SparkSession, sf_dir: str) -> Frames:
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("v"), F.explode(F.array((F.col("n_regionkey") + 1).cast("long"), F.expr("100 + n_nationkey div 5"))).alias("h"))
    return _unweighted(rows)


def customers(spark: SparkSession, sf_dir: str) -> Frames:
    """A nation's customers are a hyperedge, and so are the first ones of a region's nations."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("v"), F.col("c_nationkey").alias("n"))
    region = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("r"))
    first = rows.groupBy("n").agg(F.min("v").alias("v")).join(region, "n").select("v", (F.col("r") + 1000).cast("long").alias("h"))
    return _unweighted(rows.select("v", (F.col("n") + 1).cast("long").alias("h")).unionByName(first))


def _unweighted(rows: DataFrame) -> Frames:
    none = F.lit(None).cast("string").alias("data")
    hyperedges = rows.select(F.col("h").alias("id")).distinct().select("id", F.lit(1).cast("long").alias("weight"), none)
    return Frames(rows.select(F.col("v").alias("id")).distinct().select("id", none), hyperedges, incidence_from_table(rows, "h", "v", ["v"]))


ORDERS_SQL = """
inc AS MATERIALIZED (SELECT l_orderkey AS h, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos, l_partkey AS v FROM lineitem),
verts AS (SELECT p_partkey AS v FROM part),
edges AS (SELECT o_orderkey AS h, substr(o_orderpriority, 1, 1)::BIGINT AS w FROM orders)"""
SIZES_SQL = """
inc AS MATERIALIZED (SELECT h, row_number() OVER (PARTITION BY h ORDER BY v) - 1 AS pos, v FROM (SELECT DISTINCT regexp_extract(p_brand, '(\\d+)', 1)::BIGINT AS h, p_size::BIGINT AS v FROM part)),
verts AS (SELECT DISTINCT v FROM inc),
edges AS (SELECT DISTINCT h, 1::BIGINT AS w FROM inc)"""
NATIONS_SQL = """
inc AS MATERIALIZED (SELECT h, row_number() OVER (PARTITION BY h ORDER BY v) - 1 AS pos, v FROM (SELECT n_nationkey::BIGINT AS v, unnest([n_regionkey + 1, 100 + n_nationkey // 5])::BIGINT AS h FROM nation)),
verts AS (SELECT DISTINCT v FROM inc),
edges AS (SELECT DISTINCT h, 1::BIGINT AS w FROM inc)"""
CUSTOMERS_SQL = """
inc AS MATERIALIZED (SELECT h, row_number() OVER (PARTITION BY h ORDER BY v) - 1 AS pos, v FROM (SELECT c_custkey AS v, c_nationkey::BIGINT + 1 AS h FROM customer UNION ALL
  SELECT min(c_custkey), any_value(n_regionkey)::BIGINT + 1000 FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY c_nationkey)),
verts AS (SELECT DISTINCT v FROM inc),
edges AS (SELECT DISTINCT h, 1::BIGINT AS w FROM inc)"""
CHAINS_SQL = """
inc AS MATERIALIZED (SELECT l_orderkey * 8 + l_linenumber AS h, unnest([0, 1, 2, 3, 4]) AS pos, unnest([c_nationkey::BIGINT * 8, c_custkey * 8 + 1, l_orderkey * 8 + 2, l_partkey * 8 + 3, l_suppkey * 8 + 4]) AS v
  FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL) JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey),
verts AS (SELECT DISTINCT v FROM inc),
edges AS (SELECT DISTINCT h, 1::BIGINT AS w FROM inc)"""
DERIVED_SQL = """,
mem AS MATERIALIZED (SELECT h, v, min(pos) AS first_pos, count(*) AS times FROM inc GROUP BY h, v),
prs AS MATERIALIZED (SELECT * FROM (SELECT h, pos, v AS src, lead(v) OVER (PARTITION BY h ORDER BY pos) AS dst FROM inc) WHERE dst IS NOT NULL)"""


def with_sql(graph: str, body: str, *, recursive: bool = False) -> str:
    """A statement over inc, verts, edges, mem and prs of a graph; ``body`` may begin with further expressions."""
    base = {"orders": ORDERS_SQL, "sizes": SIZES_SQL, "nations": NATIONS_SQL, "customers": CUSTOMERS_SQL, "chains": CHAINS_SQL}[graph]
    body = body.strip()
    more = "" if body.upper().startswith("SELECT") else ","
    return f"WITH {'RECURSIVE' if recursive else ''} {base}{DERIVED_SQL}{more}\n{body}"
