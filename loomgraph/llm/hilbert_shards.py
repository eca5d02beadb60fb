"""Sharding along a Hilbert curve.

Metadata dimensions are quantised to a few bits each and mapped to their index on a Hilbert curve; rows sorted by that
index are cut into runs, so that each shard covers a compact region in every dimension and a filter on any of them
prunes shards. The runs' row counts differ by one at most.

Rows with equal texts form a group. A group takes the metadata of its smallest (lang, source), so that it stands in one
place on the curve, and a cut that would fall inside a group is moved out of it where the neighbouring runs have enough
single rows to trade.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spread_join, stored

DIMENSIONS = 3


@cache
def curve(n: int = DIMENSIONS) -> tuple[list[int], list[int]]:
    """Transitions of the n-dimensional Hilbert curve: digit and next state for each (state, corner).

    A state is an entry corner and a direction, n * 2**n in all. At each level the corner is reflected by the entry and
    rotated by the direction; its rank in the Gray code is the digit of the index.
    """
    full, digits, following = (1 << n) - 1, [], []

    def turn(x: int, by: int) -> int:
        by %= n
        return ((x << by) | (x >> (n - by))) & full

    def entry(i: int) -> int:
        return 0 if i == 0 else (even := 2 * ((i - 1) // 2)) ^ (even >> 1)

    def direction(i: int) -> int:
        if i == 0:
            return 0
        j = i - 1 if i % 2 == 0 else i
        return ((j ^ (j + 1)).bit_length() - 1) % n

    rank = {i ^ (i >> 1): i for i in range(full + 1)}
    for state in range(n << n):
        corner0, axis = state >> 0 & full, state >> n
        for corner in range(full + 1):
            digit = rank[turn(corner ^ corner0, n - axis - 1)]
            digits.append(digit)
            following.append((corner0 ^ turn(entry(digit), axis + 1)) | ((axis + direction(digit) + 1) % n) << n)
    return digits, following


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """Index on the curve of integer columns below ``2**bits``."""
    n = len(dims)
    digits, following = curve(n)
    digit_of, next_of = F.array(*map(F.lit, digits)), F.array(*map(F.lit, following))
    corners = []
    for level in reversed(range(bits)):
        corner = F.lit(0)
        for d in dims:
            corner = corner * 2 + F.shiftright(d.cast("int"), level).bitwiseAND(F.lit(1))
        corners.append(corner)

    def step(acc: Column, corner: Column) -> Column:
        at = (acc["state"] * (1 << n) + corner + 1).cast("int")
        return F.struct(F.element_at(next_of, at).alias("state"), (acc["h"] * (1 << n) + F.element_at(digit_of, at)).alias("h"))

    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("h"))
    return F.aggregate(F.array(*corners), start, step, lambda acc: acc["h"])


def shards(docs: DataFrame, n_shards: int = 24, bits: int = 6) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert, group_size.

    The dimensions are lang, source (both by hash) and the logarithm of the text's length. size: UTF-8 bytes of the
    text (none if null) plus 8. law is ``rows``: counts at most one apart. Null metadata count as empty. Ties on the
    curve are ordered by text, then doc_id, so repeated rows stand together. Fewer rows than shards leave some shards
    empty; an empty table gives no rows. Other columns aren't read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id", F.sha2(text, 256).alias("sha"), F.octet_length(text).cast("long").alias("bytes"), F.length(text).alias("chars"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.struct(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).alias("meta"),
    )
    rows = stored(narrow.withColumn("row_no", F.monotonically_increasing_id()), "shard-rows")
    groups = rows.groupBy("sha").agg(F.min("meta").alias("of_group"), F.count(F.lit(1)).alias("group_size"))
    joined = spread_join(rows, groups, "sha", ["row_no"])
    code = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    length = F.least(F.floor(F.log2(F.col("chars") + 1.0) * 3), F.lit((1 << bits) - 1))
    placed = joined.withColumn("hilbert", hilbert_index([code(F.col("of_group.lang")), length, code(F.col("of_group.source"))], bits))
    keys = ["hilbert", "sha", "doc_id", "row_no"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    single = (F.col("group_size") == 1).cast("long")
    ordered = placed.select(*keys, "bytes", "text_crc32", "group_size").repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ordered = stored(ordered.withColumn("at", F.monotonically_increasing_id()), "shard-order")
    part = F.shiftright("at", 33)
    sums = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum(single).alias("ones"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("ones").over(before), F.lit(0)).alias("ones0"))
    inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ordered.withColumn("part", part).withColumn("ones", F.sum(single).over(inside)).join(F.broadcast(offsets), "part")
    ranked = ranked.select("doc_id", "sha", "bytes", "text_crc32", "group_size", "hilbert", (F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("n0")).alias("p"), (F.col("ones") + F.col("ones0")).alias("one_no"), (single == 1).alias("single"))
    ranked = stored(ranked, "shard-ranks")
    total = ranked.count()
    shard = F.expr(f"cast(p * {n_shards} div {max(total, 1)} as int)")
    for sha, low, high, first_one, last_one in _trades(ranked, total, n_shards):
        shard = F.when((F.col("sha") == sha) & ~F.col("single"), F.lit(high)).when(F.col("single") & F.col("one_no").between(first_one, last_one), F.lit(low)).otherwise(shard)
    cut = ranked.withColumn("shard", shard.cast("int"))
    return _slots(cut, max(1, total // (4 * parts))).select(
        "doc_id", (F.col("bytes") + 8).alias("size"), "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert", "group_size",
    )


def _trades(ranked: DataFrame, total: int, n_shards: int) -> list[tuple[str, int, int, int, int]]:
    """For each cut inside a group, at most n_shards - 1: (sha, shard that gives, shard that gets the group, first and
    last number of the single rows that go the other way). Groups that a run can't hold stay cut."""
    bounds = [-(-k * total // n_shards) for k in range(n_shards + 1)]
    cuts = [b for b in sorted(set(bounds[1:-1])) if 0 < b < total]
    if not cuts:
        return []
    beside = ranked.where(F.col("p").isin([*cuts, *(b - 1 for b in cuts)])).where(~F.col("single")).select("p", "sha").collect()
    at = {r["p"]: r["sha"] for r in beside}
    split = {b: at[b] for b in cuts if b in at and at.get(b - 1) == at[b]}
    if not split:
        return []
    ends = {r["sha"]: r for r in ranked.where(F.col("sha").isin(list(set(split.values())))).groupBy("sha").agg(F.min("p").alias("s"), (F.max("p") + 1).alias("e"), F.max("one_no").alias("ones")).collect()}
    ones_at = {r["p"]: r["one_no"] for r in ranked.where(F.col("p").isin([b - 1 for b in bounds if b > 0])).select("p", "one_no").collect()}
    out, used = [], {}
    for b, sha in split.items():
        k, g = bounds.index(b), ends[sha]
        low, high = bounds[k - 1], bounds[k + 1]
        if list(split.values()).count(sha) > 1 or g["s"] < low or g["e"] > high:
            continue
        head, tail, ones = b - g["s"], g["e"] - b, g["ones"]
        after = ones_at[high - 1] - ones - used.get(k, 0)
        ahead = ones - (ones_at[low - 1] if low else 0) - used.get(k - 1, 0)
        if head <= tail and head <= after // 2:
            out.append((sha, k - 1, k, ones + 1, ones + head))
            used[k] = used.get(k, 0) + head
        elif tail <= ahead // 2:
            out.append((sha, k, k - 1, ones - tail + 1, ones))
            used[k - 1] = used.get(k - 1, 0) + tail
        elif head <= after // 2:
            out.append((sha, k - 1, k, ones + 1, ones + head))
            used[k] = used.get(k, 0) + head
    return out


def _slots(cut: DataFrame, block_rows: int) -> DataFrame:
    """``slot``: the row's place in its shard, in the order of ``p``, found by blocks of rows rather than by shard."""
    blocks = cut.withColumn("block", F.expr(f"p div {block_rows}"))
    sums = blocks.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(sums.withColumn("n0", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "shard-blocks")
    place = F.row_number().over(Window.partitionBy("shard", "block").orderBy("p")).cast("long") - 1
    return blocks.withColumn("place", place).join(offsets, ["shard", "block"]).withColumn("slot", F.col("place") + F.col("n0"))
