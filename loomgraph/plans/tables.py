"""Tables in the shared folder, and joins and orders that no hot key or single task slows down."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Only a local master may lack that setting; it then gets a folder of its own. On a cluster without it this raises,
    since a machine-local folder would not be seen by the other executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.getCheckpointDir() is None:
        folder = tempfile.mkdtemp(prefix="loomgraph-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, what: str, by: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts lineage, survives lost executors. Rows lie in
    a folder for each value of ``by``, which each task writes for itself, without a shuffle."""
    spark = df.sparkSession
    path = f"{folder_of(spark)}/{what}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.loomgraph_path = path
    return table


def folder_of(spark: SparkSession) -> str:
    """The folder of this application's tables. It goes when the driver's Python ends."""
    folder = f"{shared_dir(spark)}/loomgraph-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        if "://" not in folder:
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


_FOLDERS: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def appended(table: DataFrame, rows: DataFrame) -> DataFrame:
    """A stored table with more rows, which go to its folder; frames that refer to ``table`` keep what they had."""
    path, spark = table.loomgraph_path, table.sparkSession
    rows.select(*table.columns).write.mode("append").parquet(path)
    more = spark.read.schema(table.schema).parquet(path)
    more.loomgraph_path = path
    return more


def dropped(table: DataFrame) -> None:
    """Deletes a stored table that no frame refers to any more, such as that of the round before."""
    if path := getattr(table, "loomgraph_path", None):
        _delete(table.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application has stored. Frames that refer to them can't be read any more."""
    _delete(spark, folder_of(spark))


def stored_all(named: dict[str, DataFrame]) -> list[DataFrame]:
    """Several frames stored at once, each by a job of its own, as tasks come free."""
    with ThreadPoolExecutor(len(named)) as pool:
        return list(pool.map(lambda x: stored(x[1], x[0]), named.items()))


def fits_broadcast(df: DataFrame) -> bool:
    """Whether the optimiser's size of ``df``, which for aggregates and joins is an upper one, is within
    spark.sql.autoBroadcastJoinThreshold."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= limit


def parts_of(df: DataFrame, mb: float = 2.0) -> int:
    """Partitions for what is made of ``df``: those of the session, or more where the tables it reads are larger than
    ``mb`` for each, so that tasks don't grow with the input."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator()
    size = 0
    while leaves.hasNext():
        known = int(leaves.next().stats().sizeInBytes())
        size += known if known < 1 << 50 else 0  # Spark takes the largest number for what it doesn't know
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(int(size / (mb * 1e6)), 20_000))


def dealt(df: DataFrame, source: DataFrame, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in partitions that follow the size of ``source``, for grouping rows that are mostly distinct:
    no task holds groups of all rows that it made, nor more as the tables grow."""
    return df.repartition(parts_of(source), *keys)


def spread_join(rows: DataFrame, per_key: DataFrame, key: str, spread_by: list[str], how: str = "inner", buckets: int = 256) -> DataFrame:
    """``rows`` joined (inner or left) with ``per_key``, which has one row per key, so that a hot key meets no single task.

    A side of a checked small size is broadcast. Else the rows of a key are dealt to ``buckets`` buckets by a hash of
    ``spread_by``; the (key, bucket) pairs that occur first take up their key's values, at most ``buckets`` rows a key,
    and then meet the rows on both columns.
    """
    if fits_broadcast(per_key):
        return rows.join(F.broadcast(per_key), key, how)
    taken = {c.lower() for c in (*rows.columns, *per_key.columns)}
    bucket = next(f"_bucket{k}" for k in range(len(taken) + 1) if f"_bucket{k}" not in taken)
    dealt = rows.withColumn(bucket, F.pmod(F.xxhash64(*spread_by), F.lit(buckets)).cast("int"))
    pairs = dealt.select(key, bucket).distinct()
    return dealt.join(pairs.join(per_key, key), [key, bucket], how).drop(bucket)


#: Words of 64 bits that a screen has at most.
SCREEN_WORDS = 1 << 19


def screened(rows: DataFrame, key: str, keys: DataFrame, n: int, words: int = SCREEN_WORDS) -> DataFrame:
    """``rows`` without most of those whose ``key`` isn't in the one column of ``keys``, of which there are ``n``: a bit
    for each key's hash, in a table of bounded size that is broadcast, tells them apart before any of them moves. No row
    with such a key goes. All rows are left where the keys are too many to tell apart."""
    if n > words * 32:
        return rows
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(64 * words))
    bits = keys.select(at(keys.columns[0]).alias("_at")).groupBy(F.expr("_at div 64").alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_at % 64 as int))")).alias("_bits"))
    found = rows.withColumn("_at", at(key)).withColumn("_word", F.expr("_at div 64")).join(F.broadcast(bits), "_word")
    return found.where("(shiftright(_bits, cast(_at % 64 as int)) & 1L) = 1").select(*rows.columns)


#: Rows that a task takes at once where it thins out a part of a graph.
THINNED_ROWS = 250_000


def thinned(rows: DataFrame, n: int, kernel: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], *by: str) -> DataFrame:
    """What ``kernel`` makes of the two columns of ``rows``, long, in each of as many ranges of ``by`` as its ``n`` rows
    ask for, so that no task grows with the table. Rows of a value of ``by`` meet in one task."""
    names = rows.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [b for b in batches if b.num_rows]
        if table:
            columns = kernel(*(np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in table]) for c in names))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return rows.repartitionByRange(-(-n // THINNED_ROWS) or 1, *by).mapInArrow(each, ", ".join(f"{c} long" for c in names))


#: Rows of one key that a plain join may bring into one task.
PLAIN_ROWS = 1_000_000


def largest_key(rows: DataFrame, *keys: str) -> int:
    """The most rows that any value of any of the columns has."""
    return max(int(rows.groupBy(k).count().agg(F.max("count")).first()[0] or 0) for k in keys)


def joined(rows: DataFrame, per_key: DataFrame, key: str, spread_by: list[str], most: int, how: str = "inner") -> DataFrame:
    """:func:`spread_join`, or a plain join where no key has more than PLAIN_ROWS rows, by a count of ``most``."""
    return rows.join(per_key, key, how) if most <= PLAIN_ROWS else spread_join(rows, per_key, key, spread_by, how)


def placed(df: DataFrame, *order, name: str = "place") -> DataFrame:
    """``df`` with an order-preserving number of each row, not dense: sorted by ranges, never in one task. Stored."""
    parts = parts_of(df, 8.0)
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return stored(ranged.withColumn(name, F.monotonically_increasing_id()), "placed")


def numbered(df: DataFrame, *order, name: str = "number", first: int = 0) -> DataFrame:
    """``df`` with dense numbers from ``first`` in the given order: a range sort, then an offset a partition."""
    rows = placed(df, *order, name="_at")
    sums = rows.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = sums.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    both = rows.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(offsets), "_part")
    return both.withColumn(name, F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_base") + first).drop("_at", "_part", "_base")
