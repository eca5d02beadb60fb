"""Near-duplicate classes by n-gram Jaccard similarity, as a blocked sparse matrix product.

The matrix has a row for each document and a column for each n-gram. Two documents link when their overlap reaches
``percent`` hundredths of their union, and then each shares at least that part of its own columns. So:

1. The matrix goes through column blocks once, as runs of 32-bit column numbers by row block. Columns with one row
   give no overlap; a row whose other columns are fewer than its size's bound is discarded. A column that a row block
   meets twice is shipped once, so frequent n-grams weigh no more than rare ones.
2. Of the rows left, one of each class of equal texts and equal sets stays. Ordered by rising column frequency, linked
   rows share one of the first columns of both, as many as the bound allows to miss. Rows that meet in such a column
   form a candidate group; no other pairs can link.
3. In each group the product of the row block with its transpose accumulates overlap counts over column blocks, and
   pairs that can no longer reach their bound are dropped. Large groups are multiplied block by block: each against the
   first block, then those rows that have not joined the largest class against all blocks.

Every pair of different sets that links is found or lies within a class that other links join. Where links are counted,
every pair of blocks of a group is multiplied once instead, so that no link is left out; that work grows with the square
of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.plans.components import components

from .common import slices, spread_join, stored, unused
from .shingles import set_key, shingle_set

#: Column entries of one row block; a longer document makes a block of its own.
BLOCK_ENTRIES = 1_000_000
#: Rows of a group, or of a block of a large group, that one task multiplies.
GROUP_ROWS = 128
COLUMNS_AT_ONCE = 8192
#: Rows of a pair of blocks, and entries of a block, where all links of a group are counted.
LINK_ROWS, LINK_ENTRIES = 1024, 1_000_000
#: Stands for a null doc_id on the way to Python and back.
NO_ID = -(1 << 63)
#: Numbers of texts without a doc_id of their own begin here.
NAMELESS = 1 << 62


def least_overlap(n, percent: int):
    """The fewest shared columns that a set of ``n`` has with any set it links with."""
    return (percent * n + 99) // 100


def _matrix_blocks(size: int, bits: int):
    """A function for mapInArrow: rows of documents to blocks of the matrix, by row block and column block."""

    def flush(block: int, ids: list, shas: list, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        lengths = np.array([len(s) for s in sets], np.int64)
        entries, row = np.concatenate(sets) if sets else np.empty(0, np.uint64), np.repeat(np.arange(len(sets)), lengths)
        columns, at, times = np.unique(entries, return_inverse=True, return_counts=True)
        again = times[at] > 1
        shared = np.bincount(row[again], minlength=len(sets)).astype(np.int64)
        yield pa.RecordBatch.from_pydict(_block_rows([-1 - block], block, ids=[ids], shas=[shas], n=[lengths.tolist()], shared=[shared.tolist()]), BLOCK_SCHEMA)
        once, once_row, twice = entries[~again], row[~again], columns[times > 1]
        order = np.argsort((once >> np.uint64(64 - bits)).astype(np.uint32), kind="stable")
        once, once_row = once[order], once_row[order]
        starts = np.searchsorted(once >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        twice_starts = np.searchsorted(twice >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        short = lambda h: (h >> np.uint64(32 - bits)).astype(np.uint32)
        for k in range(1 << bits):
            a, b, c, d = starts[k], starts[k + 1], twice_starts[k], twice_starts[k + 1]
            if a < b or c < d:
                rows, counts = np.unique(once_row[a:b], return_counts=True)
                yield pa.RecordBatch.from_pydict(_block_rows([k], block, once=[short(once[a:b]).tobytes()], twice=[short(twice[c:d]).tobytes()], rows=[rows.astype(np.uint32).tobytes()], counts=[counts.astype(np.uint32).tobytes()]), BLOCK_SCHEMA)

    def to_blocks(batches):
        block, ids, shas, sets, entries = TaskContext.get().partitionId() << 32, [], [], [], 0
        for batch in slices(batches):
            for did, sha, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ids.append(did)
                shas.append(sha)
                sets.append(shingle_set(text, size))
                entries += len(sets[-1]) + 64
                if entries >= BLOCK_ENTRIES:
                    yield from flush(block, ids, shas, sets)
                    block, ids, shas, sets, entries = block + 1, [], [], [], 0
        if ids:
            yield from flush(block, ids, shas, sets)

    return to_blocks


BLOCK_SCHEMA = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("once", pa.binary()), ("twice", pa.binary()), ("rows", pa.binary()), ("counts", pa.binary()), ("ids", pa.list_(pa.int64())), ("shas", pa.list_(pa.binary())), ("n", pa.list_(pa.int64())), ("shared", pa.list_(pa.int64()))])
BLOCK_DDL = "key long, block long, once binary, twice binary, rows binary, counts binary, ids array<long>, shas array<binary>, n array<long>, shared array<long>"


def _block_rows(keys: list[int], block: int, **given) -> dict:
    return {"key": keys, "block": [block] * len(keys)} | {name: given.get(name, [None] * len(keys)) for name in BLOCK_SCHEMA.names[2:]}


def _shared_columns(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one column block: for each row block, the rows and their numbers of columns that another row has too."""
    if pdf["key"].iloc[0] < 0:
        return pdf
    once = [np.frombuffer(x, np.uint32) for x in pdf["once"]]
    twice = [np.frombuffer(x, np.uint32) for x in pdf["twice"]]
    columns, at, times = np.unique(np.concatenate([*once, *twice, *twice]), return_inverse=True, return_counts=True)
    out, begin = [], 0
    for block, own, rows, counts in zip(pdf["block"], once, pdf["rows"], pdf["counts"]):
        hit = np.concatenate([[0], np.cumsum(times[at[begin : begin + len(own)]] > 1)])
        begin += len(own)
        ends = np.cumsum(np.frombuffer(counts, np.uint32).astype(np.int64))
        found = np.diff(hit[np.concatenate([[0], ends]).astype(np.int64)])
        some = found > 0
        if some.any():
            out.append((block, np.frombuffer(rows, np.uint32)[some].tobytes(), found[some].astype(np.uint32).tobytes()))
    got = pd.DataFrame(out, columns=["block", "rows", "counts"])
    return got.assign(key=pdf["key"].iloc[0], once=None, twice=None, ids=None, shas=None, n=None, shared=None)[list(pdf.columns)]


def _row_totals(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one row block: every row with its size and its number of shared columns."""
    head = pdf[pdf["key"] < 0].iloc[0]
    shared = np.array(head["shared"], np.int64)
    for rows, counts in zip(pdf["rows"], pdf["counts"]):
        if rows is not None:
            shared[np.frombuffer(rows, np.uint32)] += np.frombuffer(counts, np.uint32)
    return pd.DataFrame({"did": head["ids"], "sha": list(head["shas"]), "n": head["n"], "shared": shared})


def linked_pairs(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether the rows x and y link, by the blocked product; a row doesn't link with itself."""
    lengths = np.array([len(s) for s in sets], np.int64)
    columns, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, kept = np.repeat(np.arange(len(sets)), lengths), times[at] > 1
    number = np.cumsum(times > 1) - 1
    row, column = row[kept], number[at[kept]]
    n_columns = int((times > 1).sum())
    both = lengths[:, None] + lengths[None, :]
    # overlap o links when 100 o >= percent (both - o)
    bound = -(-percent * both // (100 + percent))
    overlap, left = np.zeros(both.shape, np.int64), np.bincount(row, minlength=len(sets)).astype(np.int64)
    alive = np.minimum(left[:, None], left[None, :]) >= bound
    np.fill_diagonal(alive, False)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for begin in range(0, n_columns, COLUMNS_AT_ONCE):
        live = alive.any(axis=1)
        if not live.any():
            return alive
        a, b = np.searchsorted(column, [begin, begin + COLUMNS_AT_ONCE])
        block = np.zeros((len(sets), min(COLUMNS_AT_ONCE, n_columns - begin)), np.float32)
        block[row[a:b], column[a:b] - begin] = 1
        overlap[np.ix_(live, live)] += (block[live] @ block[live].T).astype(np.int64)
        left -= block.sum(axis=1).astype(np.int64)
        alive &= overlap + np.minimum(left[:, None], left[None, :]) >= bound
    return alive & (overlap >= bound)


def linked_stars(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """(id, smallest id of its class here) of the rows that link with another one."""
    return _stars(ids, linked_pairs(sets, percent))


def _stars(ids: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    root = list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    by_id = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[by_id] = np.arange(len(ids))
    for x, y in np.argwhere(np.triu(linked)):
        x, y = find(int(x)), find(int(y))
        if x != y:
            low, high = (x, y) if rank[x] < rank[y] else (y, x)
            root[high] = low
    return [(int(ids[i]), int(ids[find(i)])) for i in range(len(ids)) if find(i) != i]


def _multiplied(percent: int):
    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("did")
        sets = [np.asarray(h, np.int64).view(np.uint64) for h in pdf["hashes"]]
        return pd.DataFrame(linked_stars(pdf["did"].to_numpy(np.int64), sets, percent) if len(sets) > 1 else [], columns=["a", "b"]).astype("int64")

    return multiply


def _counted(percent: int):
    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, block, copies = pdf["did"].to_numpy(np.int64), pdf["block"].to_numpy(np.int64), pdf["copies"].to_numpy(np.int64)
        if len(ids) < 2:
            return pd.DataFrame([], columns=["a", "b", "links"]).astype("int64")
        linked = linked_pairs([np.asarray(h, np.int64).view(np.uint64) for h in pdf["hashes"]], percent)
        if pdf["s"].iloc[0] != pdf["t"].iloc[0]:
            linked &= block[:, None] != block[None, :]  # those inside a block are counted where it meets itself
        root = dict(_stars(ids, linked))
        some = linked.any(axis=1)
        return pd.DataFrame({"a": ids[some], "b": [root.get(int(i), int(i)) for i in ids[some]], "links": (linked @ copies)[some]}).astype("int64")

    return count


def _counted_links(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(a, b, links): edges (a, b) that join all rows of a class, and parts of a's number of links, which b may be a's."""
    rows = sets.join(groups, "did")
    blocks = F.expr(f"greatest((2 * count(1) + {LINK_ROWS - 1}) div {LINK_ROWS}, sum(n) div {LINK_ENTRIES} + 1)")
    members = spread_join(rows.select("did", "label", "hashes", "copies"), rows.groupBy("label").agg(blocks.alias("blocks")), "label", ["did"])
    members = members.withColumn("block", F.pmod(F.xxhash64("did"), F.col("blocks")))
    units = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    units = units.select("did", "label", "hashes", "copies", "block", F.least("block", "other").alias("s"), F.greatest("block", "other").alias("t"))
    return stored(units.groupBy("label", "s", "t").applyInPandas(_counted(percent), "a long, b long, links long"), "counted-links")


def _sets(size: int):
    def to_sets(batches):
        for batch in slices(batches):
            for did, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = shingle_set(text, size)
                yield pa.RecordBatch.from_pydict({"did": pa.array([did], pa.int64()), "key": [set_key(h)], "n": pa.array([len(h)], pa.int64()), "hashes": pa.array([h.view(np.int64)], pa.list_(pa.int64()))})

    return to_sets


def _candidate_groups(sets: DataFrame, percent: int) -> DataFrame:
    """(did, label, rows) of the rows that share a column of both prefixes with another: label and size of the group."""
    entries = sets.select("did", "n", F.explode("hashes").alias("column"))
    often = entries.groupBy("column").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = spread_join(entries, often, "column", ["did"])
    rows = shared.groupBy("did", "n").agg(F.array_sort(F.collect_list(F.struct("df", "column"))).alias("c"))
    open_columns = F.col("n") - least_overlap_column(percent) + 1 - (F.col("n") - F.size("c"))
    prefix = rows.where(open_columns > 0).select("did", F.explode(F.slice("c", F.lit(1), open_columns.cast("int"))).alias("c")).select("did", "c.column")
    prefix = stored(prefix, "prefix-columns")
    first = prefix.groupBy("column").agg(F.min("did").alias("pivot"))
    meets = stored(spread_join(prefix, first, "column", ["did"]).where("did <> pivot").select(F.col("did").alias("a"), F.col("pivot").alias("b")).distinct(), "meetings")
    if meets.isEmpty():
        return meets.select(F.col("a").alias("did"), F.col("b").alias("label"), F.lit(0).cast("long").alias("rows"))
    labels = components(meets).select(F.col("v").alias("did"), F.col("component").alias("label"))
    return stored(spread_join(labels, labels.groupBy("label").agg(F.count(F.lit(1)).alias("rows")), "label", ["did"]), "candidate-groups")


def least_overlap_column(percent: int):
    return F.expr(f"({percent} * n + 99) div 100")


def _links(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that join all rows of a class."""
    multiply = _multiplied(percent)
    small = sets.join(groups.where(F.col("rows") <= GROUP_ROWS), "did").select("did", "label", "hashes")
    edges = stored(small.groupBy("label").applyInPandas(multiply, "a long, b long"), "links")
    large = groups.where(F.col("rows") > GROUP_ROWS)
    if large.isEmpty():
        return edges
    n_blocks = F.expr(f"(2 * rows + {GROUP_ROWS - 1}) div {GROUP_ROWS}")
    members = stored(sets.join(large, "did").select("did", "label", "rows", "hashes", n_blocks.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("did"), F.col("blocks"))), "group-blocks")
    units = F.when(F.col("block") == 0, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block"))
    first = members.select("did", "label", "hashes", F.explode(units).alias("unit")).groupBy("label", "unit").applyInPandas(multiply, "a long, b long")
    edges = stored(edges.unionByName(first), "links")
    named = _class_of(members.select("did", "label"), edges)
    sizes = named.groupBy("label", "component").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("label").agg(F.max(F.struct("size", F.col("component").alias("main"))).alias("m")).select("label", "m.main")
    apart = stored(spread_join(named, main, "label", ["did"]).where("component <> main").select("did", "label"), "apart")
    if apart.isEmpty():
        return edges
    loose = spread_join(apart, apart.groupBy("label").agg(F.count(F.lit(1)).alias("loose")), "label", ["did"])
    loose = loose.withColumn("loose_blocks", F.expr(f"(2 * loose + {GROUP_ROWS - 1}) div {GROUP_ROWS}"))
    per_label = loose.groupBy("label").agg(F.max("loose_blocks").alias("loose_blocks"))
    range_to = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    ours = members.join(loose.select("did", "loose_blocks"), "did").select("did", "label", "hashes", F.pmod(F.xxhash64("did", F.lit(1)), F.col("loose_blocks")).alias("s"), F.explode(range_to("blocks")).alias("block"))
    theirs = spread_join(members, per_label, "label", ["did"]).select("did", "label", "hashes", F.explode(range_to("loose_blocks")).alias("s"), "block")
    rest = ours.unionByName(theirs).groupBy("label", "s", "block").applyInPandas(multiply, "a long, b long")
    return stored(edges.unionByName(rest), "links")


def _class_of(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` (did, ...) with ``component``, its own id where no edge ends at it."""
    if edges.isEmpty():
        return rows.withColumn("component", F.col("did"))
    found = components(edges).withColumnRenamed("v", "did")
    return stored(rows.join(found, "did", "left").withColumn("component", F.coalesce("component", "did")), "classes")


def _classified(docs: DataFrame, size: int, percent: int, links: bool = False) -> DataFrame:
    """doc_id, sha, n, keeper (doc_id and sha of the class's first text), n_links if wanted of every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.unhex(F.sha2(text, 256)).alias("sha"), text.alias("text"))
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(6, (volume // (12 * BLOCK_ENTRIES)).bit_length())  # about that many entries to a column block
    blocks = rows.mapInArrow(_matrix_blocks(size, bits), BLOCK_DDL)
    totals = blocks.groupBy("key").applyInPandas(_shared_columns, BLOCK_DDL).groupBy("block").applyInPandas(_row_totals, "did long, sha binary, n long, shared long")
    totals = stored(totals.withColumn("doc_id", F.when(F.col("did") != NO_ID, F.col("did"))).drop("did"), "row-totals")
    texts = totals.groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("shared").alias("shared"), F.count(F.lit(1)).alias("rows"))
    # a text goes by its doc_id; without one, or where another text has it too, by a number above all ids
    alone = F.row_number().over(Window.partitionBy(F.coalesce("doc_id", F.xxhash64("sha"))).orderBy("sha")) == 1
    number = F.when(F.col("doc_id").isNotNull() & alone, F.col("doc_id")).otherwise(F.xxhash64("sha").bitwiseAND(F.lit(NAMELESS - 1)).bitwiseOR(F.lit(NAMELESS)))
    texts = stored(texts.withColumn("did", number), "distinct-texts")
    left = texts.where((F.col("n") > 0) & (F.col("shared") >= least_overlap_column(percent))).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("own"), "sha", F.col("did").alias("number"))
    found = rows.join(left, (F.col("did") == F.col("own")) & (rows["sha"] == left["sha"])).select(F.col("number").alias("did"), "text")
    sets = stored(found.mapInArrow(_sets(size), "did long, key binary, n long, hashes array<long>"), "sets")
    reps = sets.groupBy("key").agg(F.min("did").alias("rep"))
    members = stored(spread_join(sets.select("did", "key"), reps, "key", ["did"]).select("did", "rep").distinct(), "set-classes")
    one = stored(sets.join(reps.select(F.col("rep").alias("did"), "key"), ["did", "key"]).dropDuplicates(["did", "key"]), "class-sets")
    named = texts.select("sha", "doc_id", "did")
    if links:
        copies = stored(members.join(texts.select("did", "rows"), "did").groupBy("rep").agg(F.sum("rows").alias("copies")), "set-copies")
        found = _counted_links(one.join(copies.withColumnRenamed("rep", "did"), "did"), _candidate_groups(one, percent), percent)
        others = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
        n_links = copies.join(others, "rep", "left").select("rep", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
        named = named.join(spread_join(members, n_links, "rep", ["did"]).select("did", "n_links"), "did", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))
        edges = found.where("a <> b").select("a", "b")
    else:
        edges = _links(one, _candidate_groups(one, percent), percent)
    both = edges.unionByName(members.where("did <> rep").select(F.col("did").alias("a"), F.col("rep").alias("b")))
    named = _class_of(named, stored(both, "links"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "sha")).alias("keeper")
    keepers = spread_join(named, named.groupBy("component").agg(first), "component", ["sha"]).select("sha", "keeper", *(["n_links"] if links else []))
    return spread_join(totals, keepers, "sha", ["doc_id"])


def classes(docs: DataFrame, *, size: int = 5, percent: int = 80, links: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, and n_links, the number of other rows it links with.

    Without ``links`` they aren't counted, which spares pairs inside a class that other links join.

    ``size``: words of a shingle. ``percent``: least similarity in hundredths. Documents without words, or with a null
    text, have no shingles and link with nothing; shorter ones than a shingle have one, of all their words. Repeated
    rows are in one class. A null doc_id links like any other; its class has a null id only when no other is there. Two
    texts under one doc_id are two documents. An empty table gives no rows. Other columns, whatever their names, aren't
    read.
    """
    own = F.when(F.col("n") > 0, F.col("keeper.doc_id")).otherwise(F.col("doc_id"))
    return _classified(docs, size, percent, links).select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), *(["n_links"] if links else []))


def one_per_class(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each class does, with all their columns.

    The one with the smallest doc_id, then the first text by SHA-256; a class without ids keeps its first text. Documents
    without words, null texts among them, all stay, and rows that repeat both doc_id and text stay together. An empty
    table gives no rows; columns may have any names.
    """
    kept = F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("sha") == F.col("keeper.sha"))
    stays = _classified(docs, size, percent).where((F.col("n") == 0) | kept).select(F.col("doc_id").alias("_kept_id"), F.col("sha").alias("_kept_sha"))
    sha = unused("sha", docs.columns)
    named = docs.withColumn(sha, F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)))
    return named.join(stays, named["doc_id"].eqNullSafe(stays["_kept_id"]) & (named[sha] == stays["_kept_sha"]), "left_semi").drop(sha)
