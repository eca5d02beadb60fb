"""De-duplication of runs of lines with content-defined boundaries.

A boundary lies between two lines where the rolling hash of the pair, taken from the lines alone, falls on a quarter of
its values. An inserted or deleted line therefore moves no boundary but those beside it, and shared passages are cut
alike wherever they stand. A chunk of two lines or more that occurs again anywhere in the corpus, compared byte by
byte, is removed but for its first occurrence.

Passages shorter than a few chunks seldom hold a whole one. ``without_repeated_runs`` finds them all: its anchors are
the overlapping windows of two lines, and the windows that repeat, side by side, are the whole repeated run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread_join, stored

#: First hex digits of a pair's hash that make a boundary: 4 of 16, chunks of four lines on average.
CUT_DIGITS = ("0", "1", "2", "3")


def chunks_of(text: Column) -> Column:
    """array<struct<start, n_lines, chunk>> of a text: first line (from 0), number of lines, the lines with breaks."""

    def cut(lines: Column) -> Column:
        ends_here = lambda i: F.substring(F.md5(F.concat(F.element_at(lines, i), F.lit("\n"), F.element_at(lines, i + 1))), 1, 1).isin(*CUT_DIGITS)
        inner = F.when(F.size(lines) > 1, F.filter(F.sequence(F.lit(1), F.size(lines) - 1), ends_here)).otherwise(F.array().cast("array<int>"))
        starts, ends = F.concat(F.array(F.lit(0)), inner), F.concat(inner, F.array(F.size(lines)))
        return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a).alias("n_lines"), F.array_join(F.slice(lines, a + 1, b - a), "\n").alias("chunk")))

    return F.element_at(F.transform(F.array(F.split(text, "\n")), cut), 1)


def repeated_chunks(docs: DataFrame, least_lines: int = 2) -> DataFrame:
    """(doc_id, text_key, start) of the chunks to remove: all but the first occurrence, by doc_id and place."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    exploded = rows.select("doc_id", "text_key", F.explode(chunks_of(F.col("text"))).alias("c")).where((F.col("c.n_lines") >= least_lines) & (F.trim(F.translate("c.chunk", "\n", " ")) != ""))
    narrow = stored(exploded.select("doc_id", "text_key", "c.start", F.xxhash64("c.chunk").alias("h")), "line-chunks")
    often = narrow.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    suspects = spread_join(narrow, often, "h", ["doc_id", "start"])
    per_doc = suspects.groupBy("doc_id", "text_key").agg(F.collect_set("start").alias("starts"))
    hit = rows.join(per_doc, rows["doc_id"].eqNullSafe(per_doc["doc_id"]) & (rows["text_key"] == per_doc["text_key"])).select(rows["doc_id"], rows["text_key"], F.filter(chunks_of(F.col("text")), lambda c: F.array_contains(F.col("starts"), c["start"])).alias("cs"))
    texts = stored(hit.select("doc_id", "text_key", F.explode("cs").alias("c")).select("doc_id", "text_key", "c.start", "c.chunk"), "line-suspects")
    place = F.struct("doc_id", "text_key", "start")
    firsts = texts.groupBy("chunk").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).select("chunk", "first")
    return spread_join(texts, firsts, "chunk", ["doc_id", "start"]).where(~place.eqNullSafe(F.col("first"))).select("doc_id", "text_key", "start").distinct()


def deduplicated(docs: DataFrame, least_lines: int = 2) -> DataFrame:
    """(doc_id, text, n_chunks, n_removed, n_lines_removed) of every row; text is null where it was.

    Lines end at line feeds. Chunks of blank lines alone stay. Rows that agree in doc_id and text count as one
    occurrence, and a null doc_id comes first. An empty table gives no rows; other columns aren't read.
    """
    rows = docs.select("doc_id", "text").withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    gone = repeated_chunks(docs, least_lines).groupBy("doc_id", "text_key").agg(F.collect_set("start").alias("gone")).withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    both = rows.join(gone, rows["doc_id"].eqNullSafe(gone["_id"]) & (rows["text_key"] == gone["_key"]), "left")
    removed = lambda c: F.array_contains(F.coalesce(F.col("gone"), F.array().cast("array<int>")), c["start"])
    cut = both.withColumn("cs", F.transform(chunks_of(F.coalesce("text", F.lit(""))), lambda c: F.struct(removed(c).alias("gone"), c["n_lines"].alias("n_lines"), F.when(~removed(c), c["chunk"]).alias("chunk"))))
    kept = F.array_join(F.transform(F.filter("cs", lambda c: ~c["gone"]), lambda c: c["chunk"]), "\n")
    dropped = F.filter("cs", lambda c: c["gone"])
    return cut.select(
        "doc_id", F.when(F.col("text").isNotNull(), kept).alias("text"), F.size("cs").cast("long").alias("n_chunks"), F.size(dropped).cast("long").alias("n_removed"),
        F.aggregate(dropped, F.lit(0).cast("long"), lambda n, c: n + c["n_lines"]).alias("n_lines_removed"),
    )


def _of_lines(text: Column, f) -> Column:
    """``f`` of the lines of ``text``, which are split once."""
    return F.element_at(F.transform(F.array(F.split(text, "\n")), f), 1)


def _windows(lines: Column, least_lines: int) -> Column:
    """array<struct<start, lines>> of all windows of ``least_lines`` lines; ``lines`` is null for blank ones."""

    def window(i: Column) -> Column:
        joined = F.array_join(F.slice(lines, i + 1, least_lines), "\n")
        return F.struct(i.alias("start"), F.when(F.trim(F.translate(joined, "\n", " ")) != "", joined).alias("lines"))

    return F.when(F.size(lines) >= least_lines, F.transform(F.sequence(F.lit(0), F.size(lines) - least_lines), window)).otherwise(F.array().cast("array<struct<start:int,lines:string>>"))


def repeated_windows(docs: DataFrame, least_lines: int = 2) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key) of the rows whose whole text an earlier row has, and (doc_id, text_key, start) of all windows
    of ``least_lines`` lines of the other rows but the first occurrence, by doc_id and place.

    A copy's windows all occur in its first row, so no window of a copy needs to be compared.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    hashes = F.transform(_of_lines(F.col("text"), lambda lines: _windows(lines, least_lines)), lambda w: F.when(w["lines"].isNotNull(), F.xxhash64(w["lines"])))
    hashed = stored(rows.select("doc_id", "text_key", F.unhex(F.sha2("text", 256)).alias("text_sha"), hashes.alias("hs")), "line-hashes")
    row, place = F.struct("doc_id", "text_key"), F.struct("doc_id", "text_key", "start")
    of_copies = hashed.groupBy("text_sha").agg(F.min(row).alias("first"), F.max(row).alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).select("text_sha", "first")
    copies = stored(spread_join(hashed.select("doc_id", "text_key", "text_sha"), of_copies, "text_sha", ["doc_id"]).where(~row.eqNullSafe(F.col("first"))).select("doc_id", "text_key").distinct(), "line-copies")
    once = hashed.groupBy("text_sha").agg(F.min(F.struct("doc_id", "text_key", "hs")).alias("r")).select("r.doc_id", "r.text_key", F.posexplode("r.hs").alias("start", "h"))
    narrow = stored(once.where("h is not null"), "line-windows")
    often = narrow.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    per_doc = spread_join(narrow, often, "h", ["doc_id", "start"]).groupBy("doc_id", "text_key").agg(F.collect_set("start").alias("starts"))
    hit = rows.join(per_doc, rows["doc_id"].eqNullSafe(per_doc["doc_id"]) & (rows["text_key"] == per_doc["text_key"])).select(
        rows["doc_id"], rows["text_key"], _of_lines(F.col("text"), lambda lines: F.transform("starts", lambda i: F.struct(i.alias("start"), F.array_join(F.slice(lines, i + 1, least_lines), "\n").alias("lines")))).alias("ws")
    )
    texts = stored(hit.select("doc_id", "text_key", F.explode("ws").alias("w")).select("doc_id", "text_key", "w.start", "w.lines"), "window-suspects")
    firsts = texts.groupBy("lines").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).select("lines", "first")
    return copies, spread_join(texts, firsts, "lines", ["doc_id", "start"]).where(~place.eqNullSafe(F.col("first"))).select("doc_id", "text_key", "start").distinct()


def without_repeated_runs(docs: DataFrame, least_lines: int = 2) -> DataFrame:
    """(doc_id, text, n_lines, n_lines_removed) of every row; text is null where it was.

    A line goes if it belongs to a run of ``least_lines`` lines or more that occurs earlier, by doc_id and place, in the
    corpus; runs may overlap. So the first occurrence of each line stays. Blank lines alone are no run. Nulls and
    repeated rows count as in ``deduplicated``. An empty table gives no rows; other columns aren't read.
    """
    rows = docs.select("doc_id", "text").withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    cover = lambda start: F.sequence(start, start + least_lines - 1)
    copies, windows = repeated_windows(docs, least_lines)
    lines_gone = windows.select("doc_id", "text_key", F.explode(cover(F.col("start"))).alias("line")).groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("gone"))
    marks = lines_gone.withColumn("copy", F.lit(False)).unionByName(copies.select("doc_id", "text_key", F.array().cast("array<int>").alias("gone"), F.lit(True).alias("copy")))
    marks = marks.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    both = rows.join(marks, rows["doc_id"].eqNullSafe(marks["_id"]) & (rows["text_key"] == marks["_key"]), "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))

    def left(lines: Column) -> Column:
        filled = F.filter(_windows(lines, least_lines), lambda w: w["lines"].isNotNull())
        gone = F.when(F.col("copy"), F.array_distinct(F.flatten(F.transform(filled, lambda w: cover(w["start"]))))).otherwise(F.col("gone"))
        kept = lambda g: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), g), lambda i: F.element_at(lines, i + 1))
        return F.element_at(F.transform(F.array(gone), lambda g: F.struct(F.size(lines).alias("n"), F.size(g).alias("n_gone"), F.array_join(kept(g), "\n").alias("text"))), 1)

    cut = both.withColumn("left", _of_lines(F.coalesce("text", F.lit("")), left))
    return cut.select("doc_id", F.when(F.col("text").isNotNull(), F.col("left.text")).alias("text"), F.col("left.n").cast("long").alias("n_lines"), F.col("left.n_gone").cast("long").alias("n_lines_removed"))
