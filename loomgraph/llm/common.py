"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.tables import spread_join, stored

__all__ = ["hex60", "load", "slices", "spread_join", "stored", "unused"]
#: Rows whose texts are Python objects at a time.
ROWS = 512


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of ``ROWS`` rows, so that a worker holds few texts as objects at once."""
    for b in batches:
        for k in range(0, b.num_rows, ROWS):
            yield b.slice(k, ROWS)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def hex60(digest: Column, part: int) -> Column:
    """Sixty bits of a hex digest as a long: its 15 digits from ``15 * part``."""
    return F.conv(F.substring(digest, 15 * part + 1, 15), 16, 10).cast("long")


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores behind it as long as a column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
