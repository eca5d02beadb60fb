"""Homomorphic multiset fingerprints of documents.

A document is the multiset of its paragraphs. Each paragraph is hashed to a wide vector and a document's fingerprint is
the sum of its paragraphs' vectors, each lane modulo a power of two: order plays no part, and paragraphs are added to or
taken from a fingerprint without the rest of the text. The vector has two blocks. Four lanes modulo 2**60 hold hash
words and make fingerprints of different multisets differ; 120 lanes, modulo 2**64 as longs, count single hash bits,
and as sums of signs (2 * bits - paragraphs) they estimate the size of the difference of two multisets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hex60

#: Paragraphs end at line breaks, and long ones are divided after ASCII marks other than commas, hyphens, quotes and
#: brackets: the ends of sentences and of table cells.
SENTENCE_END = r"([!#$%&*+.:;<=>?@^|~]) "
WORD_BITS = 60
#: Lanes packed in one long while up to 2**PACK_BITS - 1 paragraphs are counted.
PACK_BITS, PACKED = 12, 5
BLOCK = (1 << PACK_BITS) - 1
UNIT_MASK = sum(1 << PACK_BITS * j for j in range(PACKED))


def paragraphs(text: Column) -> Column:
    return F.split(F.regexp_replace(text, SENTENCE_END, "$1\n"), "\n")


def vector(text: Column) -> Column:
    """struct<n, words array<long>, bits array<long>> of a text: the paragraph count and the lanes of both blocks."""
    digests = F.transform(paragraphs(text), lambda p: F.struct(F.md5(p).alias("a"), F.md5(F.concat(F.lit("+"), p)).alias("b")))
    units = F.transform(digests, lambda d: F.struct(hex60(d["a"], 0).alias("a0"), hex60(d["a"], 1).alias("a1"), hex60(d["b"], 0).alias("b0"), hex60(d["b"], 1).alias("b1")))

    def of(hashed: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(hashed) - 1) / BLOCK).cast("int")), lambda k: F.slice(hashed, k * BLOCK + 1, F.lit(BLOCK)))
        packs = F.transform(blocks, lambda block: F.array(*(_packed(block, w, i) for w in ("a0", "a1") for i in range(PACK_BITS))))
        return F.struct(F.size(hashed).cast("long").alias("n"), F.array(*(_sum(hashed, w) for w in ("a0", "a1", "b0", "b1"))).alias("words"), _unpacked(packs).alias("bits"))

    return F.element_at(F.transform(F.array(units), of), 1)


def _sum(hashed: Column, word: str) -> Column:
    mask = F.lit((1 << WORD_BITS) - 1).cast("long")
    return F.aggregate(hashed, F.lit(0).cast("long"), lambda s, u: (s + u[word]).bitwiseAND(mask))


def _packed(block: Column, word: str, i: int) -> Column:
    """Counts of bits i, i + 12, ... of a word, each in its own twelve bits of a long."""
    return F.aggregate(block, F.lit(0).cast("long"), lambda s, u: s + F.shiftright(u[word], i).bitwiseAND(F.lit(UNIT_MASK).cast("long")))


def _unpacked(packs: Column) -> Column:
    """The 120 counts, summed over blocks: packs in turn, within each from the lowest bit."""
    each = lambda pack: F.flatten(F.transform(pack, lambda x: F.array(*(F.shiftright(x, PACK_BITS * j).bitwiseAND(F.lit(BLOCK).cast("long")) for j in range(PACKED)))))
    opened = F.transform(packs, each)
    rest = F.slice(opened, 2, F.greatest(F.size(opened) - 1, F.lit(0)))
    return F.aggregate(rest, F.element_at(opened, 1), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))


def signs(v: Column) -> Column:
    """The 120 signed lanes."""
    return F.transform(v["bits"], lambda x: x * 2 - v["n"])


def shown(v: Column) -> Column:
    """A fingerprint as text: the paragraph count, the word lanes and the bit lanes."""
    listed = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ".")
    return F.concat_ws(":", v["n"].cast("string"), listed(v["words"]), listed(v["bits"]))


def distance(a: Column, b: Column) -> Column:
    """struct<d, s>: squared distance of two sign sums, sum of their squared lengths."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct(((x - y) * (x - y)).alias("d"), (x * x + y * y).alias("s")))
    total = lambda part: F.aggregate(pairs, F.lit(0).cast("long"), lambda t, p: t + p[part])
    return F.struct(total("d").alias("d"), total("s").alias("s"))


def likeness(sums: Column) -> Column:
    """0 to 1: one less the squared distance by the sum of the squared lengths; 1 if both are zero."""
    return F.when(sums["s"] == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - sums["d"] / sums["s"]))


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of the sum of two multisets, or with sign -1 of ``a`` without ``b``, from fingerprints alone."""
    mask = F.lit((1 << WORD_BITS) - 1).cast("long")
    words = F.zip_with(a["words"], b["words"], lambda x, y: (x + sign * y).bitwiseAND(mask))
    return F.struct((a["n"] + sign * b["n"]).alias("n"), words.alias("words"), F.zip_with(a["bits"], b["bits"], lambda x, y: x + sign * y).alias("bits"))


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """(doc_id, text, next_text): the next row in descending doc_id, after the last the first; ties by text.

    Rows are dealt by ranges of doc_id from approximate quantiles, so no task orders the whole table. Each range also
    gets a copy of the first row of the range below it, which stands last there and is left out of the result.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = rows.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else None
    cuts = sorted(set(cuts or ()))
    part = F.size(F.filter(F.array(*(F.lit(c).cast("long") for c in cuts)), lambda c: c < F.col("doc_id"))) if cuts else F.lit(0)
    dealt = rows.withColumn("part", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(part))
    tops = {r["part"]: r["top"] for r in dealt.groupBy("part").agg(F.max("doc_id").alias("top")).collect()}  # one for each range
    if not tops:
        return rows.withColumn("next_text", F.col("text"))
    places = sorted(tops, reverse=True)
    above = F.create_map(*(F.lit(x) for a, b in zip(places, places[1:] + places[:1]) for x in (b, a)))
    known = [t for t in tops.values() if t is not None]
    heads = dealt.where(F.col("doc_id").isin(known) | F.col("doc_id").isNull()).groupBy("part").agg(F.min("text").alias("text"))
    copies = heads.select(F.lit(None).cast("long").alias("doc_id"), "text", F.element_at(above, F.col("part")).alias("part"), F.lit(True).alias("copy"))
    order = Window.partitionBy("part").orderBy("copy", F.col("doc_id").desc_nulls_last(), "text")
    both = dealt.withColumn("copy", F.lit(False)).unionByName(copies)
    return both.withColumn("next_text", F.lead("text").over(order)).where(~F.col("copy")).select("doc_id", "text", "next_text")


def edited(text: Column, following: Column) -> Column:
    """``text`` whose last half, rounded down, gives way to as many first code points of ``following``, or all."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    A null text is empty; the empty text is one empty paragraph. A table of one row is followed by itself. Rows are
    followed in descending doc_id, ties by text, nulls last. An empty table gives no rows; other columns aren't read.
    """
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(docs, parts).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    v = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), vector(F.col("text")).alias("v"), vector(F.col("edited")).alias("e"), vector(F.col("next_text")).alias("f"))
    s = v.select("*", signs(F.col("v")).alias("sv"), signs(F.col("e")).alias("se"), signs(F.col("f")).alias("sf"))
    d = s.select("*", distance(F.col("sv"), F.col("se")).alias("to_edited"), distance(F.col("sv"), F.col("sf")).alias("to_next"))
    return d.select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("v")).alias("fingerprint"), shown(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("to_edited")).alias("near_edited"), likeness(F.col("to_next")).alias("near_next"),
    )
