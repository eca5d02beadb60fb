"""Exact de-duplication by two-pass Bloom filtering.

Pass one builds a Bloom filter over the content hashes in which every bit is counted up to two. Pass two asks it of
every row: a row whose bits were all set at least twice may be repeated. Only those rows are shuffled by their full
SHA-256, which settles the matter; all others pass straight through as unique. A false positive costs a shuffled
row and never changes a result.

The filter grows with the rows. Beyond a size that every executor can hold it is cut by ranges of the hash, and both
passes go range by range over rows that lie in a folder for each range, written without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .common import spread_join, stored
from .shingles import mixed

#: Bits of the filter in one row of its table, and positions that a task gathers before it passes them on.
CHUNK_BITS, POSITIONS_AT_ONCE = 1 << 22, 4_000_000


def _positions(h: np.ndarray, bits: int) -> np.ndarray:
    """Two different bit positions of each 64-bit hash, in two rows."""
    h = h.astype(np.int64).view(np.uint64)
    first, second = h & np.uint64(bits - 1), mixed(h) & np.uint64(bits - 1)
    return np.stack([first, np.where(second == first, first ^ np.uint64(1), second)]).astype(np.int64)


def repeat_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """The bits that two or more rows of ``hashes`` (column ``h``) set, packed. ``bits``: a power of two.

    Tasks send the positions that their rows set, eight bytes a row at most, and a chunk of bits is counted in one
    place; the driver holds the filter, ``bits`` / 8 bytes.
    """
    width = min(CHUNK_BITS, bits)

    def gathered(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        at, times = np.unique(np.concatenate(held), return_counts=True)
        bounds = np.searchsorted(at, np.arange(0, bits + 1, width))
        for k in np.flatnonzero(np.diff(bounds)):
            inside, often = (at[bounds[k] : bounds[k + 1]] - k * width).astype(np.uint32), times[bounds[k] : bounds[k + 1]] > 1
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([int(k)], pa.int64()), "set": [inside.tobytes()], "again": [inside[often].tobytes()]})

    def build(batches):
        held, n = [], 0
        for b in batches:
            held.append(_positions(b.column(0).to_numpy(), bits).ravel())
            n += 2 * b.num_rows
            if n >= POSITIONS_AT_ONCE:
                yield from gathered(held)
                held, n = [], 0
        if n:
            yield from gathered(held)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        once, twice = np.zeros(width, bool), np.zeros(width, bool)
        for some, again in zip(pdf["set"], pdf["again"]):
            at = np.frombuffer(some, np.uint32)
            twice[at[once[at]]] = True
            once[at] = True
            twice[np.frombuffer(again, np.uint32)] = True
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "bits": [np.packbits(twice).tobytes()]})

    parts = hashes.select("h").mapInArrow(build, "chunk long, set binary, again binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in parts.groupBy("chunk").applyInPandas(merge, "chunk long, bits binary").toLocalIterator():
        out[row.chunk * width // 8 :][: len(row.bits)] = np.frombuffer(row.bits, np.uint8)
    return out


def marked(rows: DataFrame, *, bits_per_row: int, filter_bytes: int) -> DataFrame:
    """``rows`` (h long, and others) stored with ``suspect``: false where no other row has that hash."""
    bits = 1 << max(16, (bits_per_row * max(rows.count(), 1) - 1).bit_length())
    ranges = 1 << max(0, (bits // 8 // filter_bytes).bit_length() - 1)
    bits, spark, out = bits // ranges, rows.sparkSession, []
    schema = StructType([*rows.schema.fields, StructField("suspect", BooleanType())])
    if ranges > 1:
        dealt = stored(rows.withColumn("hash_range", F.shiftrightunsigned("h", 65 - ranges.bit_length()).cast("int")), "hash-ranges", by="hash_range")
    for k in range(ranges):
        own = rows if ranges == 1 else dealt.where(F.col("hash_range") == k).drop("hash_range")
        seen = spark.sparkContext.broadcast(repeat_filter(own, bits))  # filter_bytes at most

        def ask(batches, seen=seen):
            for b in batches:
                at = _positions(b.column("h").to_numpy(), bits)
                hit = (seen.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
                yield b.append_column("suspect", pa.array(hit.all(axis=0)))

        out.append(stored(own.mapInArrow(ask, schema), "asked"))
        seen.destroy()
    return reduce(DataFrame.unionByName, out)


def _hashes(text: Column) -> tuple[Column, Column]:
    return F.unhex(F.sha2(text, 256)).alias("sha"), F.xxhash64(text).alias("h")


def copies(docs: DataFrame, *, bits_per_row: int = 12, filter_bytes: int = 64 << 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_sha256, keep_id, group_size, kept, suspect.

    Rows with equal texts (null counts as empty) form a group; the row with the largest doc_id is kept, a null doc_id
    comes after all others, and of rows that share doc_id and text exactly one is kept. An empty table gives no rows.
    ``docs`` may have more columns of any names; only doc_id, an integer of any width, and text are read.

    The filter takes ``bits_per_row`` bits a row or up to twice that; at most ``filter_bytes`` of it are with an executor
    at a time.
    """
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    hashed = docs.select(doc_id, *_hashes(F.coalesce(F.col("text"), F.lit(""))))
    rows = stored(hashed.withColumn("row_no", F.monotonically_increasing_id()), "content-hashes")
    asked = marked(rows, bits_per_row=bits_per_row, filter_bytes=filter_bytes)
    hexed = F.lower(F.hex("sha")).alias("text_sha256")
    alone = asked.where(~F.col("suspect")).select("doc_id", hexed, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "suspect")
    suspects = asked.where("suspect").drop("h")
    groups = suspects.groupBy("sha").agg(F.max(F.struct("doc_id", "row_no")).alias("last"), F.count(F.lit(1)).alias("group_size"))
    settled = spread_join(suspects, groups, "sha", ["row_no"]).select("doc_id", hexed, F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("last.row_no") == F.col("row_no")).alias("kept"), "suspect")
    return alone.unionByName(settled)


def deduplicated(docs: DataFrame, *, bits_per_row: int = 12, filter_bytes: int = 64 << 20) -> DataFrame:
    """The rows of ``docs`` that :func:`copies` keeps, with all their columns, whatever their names.

    Nulls, ties and repeated rows as there; of rows that share doc_id and text any one stays. Rows whose texts are
    unique by the filter aren't shuffled. An empty table gives no rows.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *_hashes(F.coalesce(F.col("text"), F.lit(""))))
    asked = marked(rows, bits_per_row=bits_per_row, filter_bytes=filter_bytes)
    suspects = asked.where("suspect").select("row", "sha", F.col("row.doc_id").alias("own"))
    groups = suspects.groupBy("sha").agg(F.max(F.struct(F.col("own").alias("last"))).alias("m")).select("sha", "m.last")
    kept = spread_join(suspects, groups, "sha", ["own"]).where(F.col("own").eqNullSafe(F.col("last"))).dropDuplicates(["sha"])
    return asked.where(~F.col("suspect")).select("row.*").unionByName(kept.select("row.*"))
