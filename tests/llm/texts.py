"""Fixtures of the text operators' tests: odd rows that every operator must take, and plain helpers."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names operators use inside.
CLASHING = ("blob", "spans", "sha", "h", "did", "n", "key", "block", "part", "row", "label", "terms", "component", "start", "kept", "pos", "_one", "_sha", "_key", "_blob", "_spans", "_kept_id", "_kept_sha", "_bad_id", "_bad_key", "own", "last", "suspect", "hash_range", "bucket", "_bucket")


def frame(spark, rows, extra=False):
    """Documents from (doc_id, text) pairs."""
    df = spark.createDataFrame([(i, t, "en", f"s{k % 3}", len(t) if t is not None else None) for k, (i, t) in enumerate(rows)], SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("x") for c in CLASHING})
    return df


LONG = " ".join(f"word{i % 701} tail{i % 97}." for i in range(9000))
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Same text here, twice over and again."), (6, "Same text here, twice over and again."),
    (None, "a row without an id"), (None, "a row without an id"), (None, None), (7, LONG), (8, LONG), (9, "é 日本 ß 😀 ümlaut"), (5, "Same text here, twice over and again."), (5, "another text under a taken id"),
]


def by_id(rows, column=None):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append(r if column is None else r[column])
    return out
