"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each query runs once to warm up and is then timed over its full result. Queries of the baseline's shapes (bulk insertion
and build of 1 000 x 1 000 positions, a chain of 1 000 vertices) run on graphs of those sizes, whatever the folder.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

HEADLINE = ("degrees", "adjacency_from", "neighborhood_size", "endpoints", "connecting", "expand_graph", "expand_star", "incidence_coo", "laplacian_zhou", "inclusions", "nestedness", "components", "core", "pagerank_k", "bfs_level", "shortest_cost", "edit_merge_vertices")


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(run) -> float:
    began = time.perf_counter()
    run()
    return round(time.perf_counter() - began, 3)


def full(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def shapes(spark: SparkSession) -> dict:
    """The baseline's own benchmarks, by name."""
    from loomgraph.graph import Hypergraph

    grid = spark.range(1_000_000).select((F.col("id") / 1000).cast("long").alias("e"), F.col("id").alias("v"), (F.col("id") % 1000).alias("p"))
    chain = Hypergraph.from_table(spark.range(999).select(F.col("id").alias("e"), F.explode(F.array(F.col("id") + 1, F.col("id") + 2)).alias("v")), "e", "v", ["v"])
    chain.build()
    shared = Hypergraph.from_table(spark.range(100_000).select((F.col("id") / 100).cast("long").alias("e"), (F.col("id") % 100).alias("v"), (F.col("id") % 100).alias("p")), "e", "v", [], pos="p")
    shared.build()
    from loomgraph.operators import measures

    def filled(each) -> Hypergraph:
        g = Hypergraph(spark)
        vertices = g.create_vertices([None] * 1000)
        for _ in range(1000):
            each(g, g.create_hyperedge(), vertices)
        return g

    def one_by_one(g, h, vertices):
        for v in vertices:
            g.append_vertex(h, v)

    return {
        "insert_per_vertex_1m": lambda: filled(one_by_one).incidence,
        "insert_batch_append_1m": lambda: filled(lambda g, h, vertices: g.append_vertices(h, vertices)).incidence,
        "build_reverse_index_1m": (lambda g: lambda: g.build())(Hypergraph.from_table(grid, "e", "v", [], pos="p")),
        "insert_build_1m": lambda: Hypergraph.from_table(grid, "e", "v", [], pos="p").build(),
        "degrees_100x1000": lambda: full(measures.degrees(shared.vertex_frame, shared.pairs)),
        "shortest_path_chain_1000": lambda: chain.find_shortest_path(1, 1000),
        "cut_vertices_chain_1000": chain.find_cut_vertices,
    }


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(cpus)
    from loomgraph.queries import QUERIES

    runs = {name: (lambda f=QUERIES[name]: full(f(spark, sf_dir))) for name in HEADLINE} | shapes(spark)
    times = {}
    for name, run in runs.items():
        run()
        times[name] = timed(run)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
