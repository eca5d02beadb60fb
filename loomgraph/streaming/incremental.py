"""Structured Streaming over incidences (hyperedge_id, pos, vertex_id) that arrive in any order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def running_counts(stream: DataFrame) -> DataFrame:
    """(vertex_id, occurrences, hyperedges): a running count of each vertex; hyperedges approximately."""
    return stream.groupBy("vertex_id").agg(F.count(F.lit(1)).alias("occurrences"), F.approx_count_distinct("hyperedge_id").alias("hyperedges"))


def running_endpoints(stream: DataFrame) -> DataFrame:
    """(hyperedge_id, initial, terminal, length) of what has arrived of each hyperedge."""
    return stream.groupBy("hyperedge_id").agg(F.min_by("vertex_id", "pos").alias("initial"), F.max_by("vertex_id", "pos").alias("terminal"), F.count(F.lit(1)).alias("length"))


def windowed_activity(stream: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """(window, vertex_id, occurrences) by event time; rows later than ``late`` behind the newest are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), "vertex_id").agg(F.count(F.lit(1)).alias("occurrences"))


def distinct_members(stream: DataFrame, time: str, late: str) -> DataFrame:
    """(hyperedge_id, vertex_id, time) as they are first seen; state older than ``late`` is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(["hyperedge_id", "vertex_id"])


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch to an incidence table. A batch that is run again replaces its own part, so none counts twice."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`append_to` has written: (hyperedge_id, pos, vertex_id)."""
    return spark.read.parquet(path).select("hyperedge_id", "pos", "vertex_id")
