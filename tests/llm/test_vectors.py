"""Fingerprints and shards."""

import random
from collections import Counter

from pyspark.sql import functions as F
from texts import frame

from loomgraph.llm import fingerprints as f
from loomgraph.llm import hilbert_shards


def test_order_plays_no_part_and_edits_are_incremental(spark):
    a, b, c = "First one.", "Second | cell.", "Third"
    df = spark.createDataFrame([(f"{a}\n{b}\n{c}", f"{c}\n{a} {b}".replace("| ", "| "), f"{a}\n{c}", b)], "x string, y string, less string, gone string")
    v = df.select(*(f.vector(F.col(k)).alias(k) for k in df.columns))
    row = v.select(f.shown(F.col("x")).alias("x"), f.shown(F.col("y")).alias("y"), f.shown(f.combined(F.col("x"), F.col("gone"), -1)).alias("taken"), f.shown(F.col("less")).alias("less"), f.shown(f.combined(F.col("less"), F.col("gone"))).alias("added")).first()
    assert row["x"] == row["y"] == row["added"] and row["taken"] == row["less"] != row["x"]


def test_many_paragraphs_fill_several_blocks(spark, monkeypatch):
    text = "\n".join(f"p{i % 50}" for i in range(200))
    want = spark.range(1).select(f.shown(f.vector(F.lit(text))).alias("v")).first()["v"]
    monkeypatch.setattr(f, "BLOCK", 63)
    assert spark.range(1).select(f.shown(f.vector(F.lit(text))).alias("v")).first()["v"].split(":")[:2] == want.split(":")[:2]


def test_likeness_follows_shared_paragraphs(spark):
    r = random.Random(1)
    rows = []
    for i in range(60):
        rows.append((i, "\n".join(f"paragraph {r.random()}" for _ in range(20))))
    out = f.fingerprints(frame(spark, rows)).collect()
    assert all(0 <= x["near_edited"] <= 1 and 0 <= x["near_next"] <= 1 for x in out)
    assert sum(x["near_edited"] for x in out) / 60 > 0.3 > 0.15 > sum(x["near_next"] for x in out) / 60
    same = f.fingerprints(frame(spark, [(1, "x\ny"), (2, "x\ny")])).collect()
    assert same[0]["fingerprint"] == same[1]["fingerprint"] and same[0]["near_next"] == 1.0


def test_next_document(spark):
    rows = [(i * 3, f"text {i}") for i in range(100)]
    got = {x["doc_id"]: x["next_text"] for x in f.with_next(frame(spark, rows), 7).collect()}
    assert got == {i * 3: f"text {(i - 1) % 100}" for i in range(100)}


def test_curve_steps_to_neighbours():
    for n in (2, 3):
        digits, following = hilbert_shards.curve(n)
        place = {}
        for code in range(1 << 3 * n):
            point = [code >> 3 * k & 7 for k in range(n)]
            state = h = 0
            for level in (2, 1, 0):
                corner = 0
                for x in point:
                    corner = corner * 2 + (x >> level & 1)
                h, state = h << n | digits[state << n | corner], following[state << n | corner]
            place[h] = point
        assert sorted(place) == list(range(1 << 3 * n))
        assert all(sum(abs(a - b) for a, b in zip(place[h], place[h + 1])) == 1 for h in range(len(place) - 1))


def test_shards(spark):
    r = random.Random(2)
    rows = [(i, f"copy {r.randint(0, 25)}" if r.random() < 0.15 else f"single {i} " * r.randint(1, 9)) for i in range(900)]
    out = hilbert_shards.shards(frame(spark, rows)).collect()
    counts, texts = Counter(x["shard"] for x in out), dict(rows)
    assert sorted(counts) == list(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(x["slot"] for x in out if x["shard"] == s) == list(range(n))
    where = {}
    for x in out:
        where.setdefault(texts[x["doc_id"]], set()).add(x["shard"])
    assert sum(len(s) > 1 for s in where.values()) <= 2
    assert all(x["size"] == len(texts[x["doc_id"]].encode()) + 8 for x in out)
