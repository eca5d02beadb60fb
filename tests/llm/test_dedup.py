"""Exact copies, near copies and repeated lines against plain versions."""

import hashlib
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from texts import frame

from loomgraph.llm import exact_dedup, jaccard_join, line_dedup
from loomgraph.llm.shingles import set_key, shingle_set, words


@pytest.mark.parametrize("options", [{}, {"filter_bytes": 4096}, {"bits_per_row": 1}])
def test_copies(spark, options):
    r = random.Random(1)
    rows = [(i, f"text {r.randint(0, 400)}") for i in range(700)]
    got = {x["doc_id"]: x for x in exact_dedup.copies(frame(spark, rows), **options).collect()}
    size, last = Counter(t for _, t in rows), {t: i for i, t in rows}
    for i, t in rows:
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (last[t], size[t], last[t] == i, hashlib.sha256(t.encode()).hexdigest())


def test_filter_lets_single_rows_pass(spark):
    got = exact_dedup.copies(frame(spark, [(i, f"text {i // 2 if i < 20 else i}") for i in range(3000)])).collect()
    assert sum(x["suspect"] for x in got) < 100 and all(x["suspect"] for x in got if x["group_size"] > 1)


def near(rows, size, percent):
    """component of each row, from all pairs."""
    sets = {i: frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if (w := words(t)) else frozenset() for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_filter_by_hash_ranges(spark):
    """Many filters, one after the other: equal results, few suspects besides the copies, and no shuffle of the rest."""
    docs = frame(spark, [(i, f"text {i // 2 if i < 20 else i}") for i in range(20000)])
    got = exact_dedup.copies(docs, filter_bytes=8192)
    out = {x["doc_id"]: x for x in got.collect()}
    assert all(out[i]["keep_id"] == (i | 1 if i < 20 else i) and out[i]["kept"] == (i >= 20 or i % 2 == 1) for i in out) and len(out) == 20000
    assert 20 <= sum(x["suspect"] for x in out.values()) < 2000
    asked = exact_dedup.marked(docs.select("doc_id", F.xxhash64("text").alias("h")), bits_per_row=12, filter_bytes=8192)
    assert "Exchange" not in asked.where("not suspect")._jdf.queryExecution().executedPlan().toString()
    kept = exact_dedup.deduplicated(docs, filter_bytes=8192)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in out if out[i]["kept"])


def test_ids_of_any_width(spark):
    docs = frame(spark, [(1, "a"), (2, "a"), (3, None)]).withColumn("doc_id", F.col("doc_id").cast("int"))
    assert {(x["doc_id"], x["keep_id"]) for x in exact_dedup.copies(docs).collect()} == {(1, 2), (2, 2), (3, 3)}
    assert sorted(r["doc_id"] for r in exact_dedup.deduplicated(docs).collect()) == [2, 3]


def near_rows(seed, families, copies, length, edits):
    r = random.Random(seed)
    rows = []
    for _ in range(families):
        base = [f"w{r.randint(0, 3000)}" for _ in range(r.randint(3, length))]
        for _ in range(r.randint(1, copies)):
            w = list(base)
            for _ in range(r.randint(0, edits)):
                w[r.randrange(len(w))] = f"x{r.randint(0, 99999)}"
            rows.append((len(rows), "  ".join(w).upper() if r.random() < 0.2 else " ".join(w)))
    return rows


def test_near_copies(spark):
    rows = near_rows(2, 60, 8, 120, 4) + [(9000, None), (9001, ""), (9002, " one two "), (9003, "ONE\ttwo"), (9004, "a b c d"), (9005, "a b c d")]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.classes(frame(spark, rows), size=4, percent=85).collect()}
    assert got == near(rows, 4, 85) and got[9002][1] == got[9003][1] == 9002 and got[9001] == (0, 9001)


def test_large_groups_go_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP_ROWS", 12)
    rows = near_rows(3, 2, 90, 100, 9) + near_rows(4, 1, 1, 9, 0)[:0]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.classes(frame(spark, rows), size=5, percent=80).collect()}
    assert got == near(rows, 5, 80) and len({c for _, c in got.values()}) > 2


def test_product_over_column_blocks(monkeypatch):
    monkeypatch.setattr(jaccard_join, "COLUMNS_AT_ONCE", 7)
    rows = near_rows(5, 6, 6, 60, 3)
    sets = [shingle_set(t, 4) for _, t in rows]
    stars = dict(jaccard_join.linked_stars(np.arange(len(rows)), sets, 85))
    assert {i: stars.get(i, i) for i, _ in rows} == {i: c for i, (_, c) in near(rows, 4, 85).items()}


def test_shingles():
    assert len(shingle_set("A b\tC d", 4)) == 1 and set_key(shingle_set("A b C d", 4)) == set_key(shingle_set("a B c D", 4))
    assert len(shingle_set("É é", 1)) == 2 and len(shingle_set("", 4)) == 0 and len(shingle_set("a b", 4)) == 1


def plain_chunks(text):
    lines = text.split("\n")
    cuts = [i for i in range(1, len(lines)) if hashlib.md5(f"{lines[i - 1]}\n{lines[i]}".encode()).hexdigest()[0] in "0123"]
    return [(a, lines[a:b]) for a, b in zip([0, *cuts], [*cuts, len(lines)])]


def test_line_chunks(spark):
    r = random.Random(6)
    passages = [[f"shared {p} line {k}" for k in range(r.randint(2, 12))] for p in range(5)]
    rows = []
    for i in range(80):
        own = [[f"own {i} {k}" for k in range(r.randint(0, 5))], r.choice(passages), [f"more {i} {k}" for k in range(r.randint(0, 6))], r.choice(passages) if r.random() < 0.3 else [], ["", ""]]
        rows.append((i, "\n".join(x for part in own for x in part)))
    got = {x["doc_id"]: x for x in line_dedup.deduplicated(frame(spark, rows)).collect()}
    seen, gone_at_all = set(), 0
    for i, t in rows:
        kept, gone = [], 0
        for _, lines in plain_chunks(t):
            key = "\n".join(lines)
            if len(lines) >= 2 and key.strip() and key in seen:
                gone += 1
            else:
                kept.append(key)
            seen.add(key)
        assert (got[i]["text"], got[i]["n_removed"]) == ("\n".join(kept), gone)
        gone_at_all += gone
    assert gone_at_all > 20
