"""Queries of the operators that need DataFrame functions only: line chunks, fingerprints, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, hilbert_shards, line_dedup
from .common import load


def op1_line_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its globally repeated line chunks: counts and the digest of what is left."""
    out = line_dedup.deduplicated(load(spark, sf_dir, "documents"))
    left = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_chunks", "n_removed", "n_lines_removed", F.length(left).cast("long").alias("n_chars_left"), F.sha2(left, 256).alias("text_sha256"))


OP1_SQL = """
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
c AS (SELECT doc_id, lines, len(lines) AS n, list_filter(range(1, len(lines)), lambda i: substr(md5(lines[i] || chr(10) || lines[i + 1]), 1, 1) IN ('0', '1', '2', '3')) AS cuts FROM l),
s AS (SELECT doc_id, lines, list_concat([0], cuts) AS a, list_concat(cuts, [n]) AS b FROM c),
k AS (SELECT doc_id, unnest(list_transform(range(1, len(a) + 1), lambda j: {'s': a[j], 'n': b[j] - a[j], 'chunk': array_to_string(lines[a[j] + 1 : b[j]], chr(10))})) AS c FROM s),
r AS (SELECT doc_id, c.s AS s, c.n AS n, c.chunk AS chunk, c.n >= 2 AND trim(replace(c.chunk, chr(10), ' ')) <> '' AND row_number() OVER (PARTITION BY c.chunk ORDER BY doc_id, c.s) > 1 AS gone FROM k)
SELECT *, length(kept) AS n_chars_left, sha256(kept) AS text_sha256 FROM (
  SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (gone) AS n_removed, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_lines_removed,
    coalesce(string_agg(chunk, chr(10) ORDER BY s) FILTER (NOT gone), '') AS kept FROM r GROUP BY doc_id)
"""
OP1_SQL = f"SELECT doc_id, n_chunks, n_removed, n_lines_removed, n_chars_left, text_sha256 FROM ({OP1_SQL})"


def op1_line_run_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines of any run of two or more that occurs earlier: counts and the digest of what is left."""
    out = line_dedup.without_repeated_runs(load(spark, sf_dir, "documents"))
    left = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_lines_removed", F.length(left).cast("long").alias("n_chars_left"), F.sha2(left, 256).alias("text_sha256"))


OP1_RUNS_SQL = """
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, unnest(list_transform(range(1, len(lines)), lambda i: {'s': i, 'lines': lines[i] || chr(10) || lines[i + 1]})) AS win FROM l),
g AS (SELECT doc_id, win.s AS s FROM w WHERE trim(replace(win.lines, chr(10), ' ')) <> '' QUALIFY row_number() OVER (PARTITION BY win.lines ORDER BY doc_id, win.s) > 1),
d AS (SELECT doc_id, list(s) AS gone FROM g GROUP BY doc_id),
k AS (SELECT doc_id, lines, list_filter(range(1, len(lines) + 1), lambda i: NOT list_contains(coalesce(gone, []), i) AND NOT list_contains(coalesce(gone, []), i - 1)) AS kept FROM l LEFT JOIN d USING (doc_id)),
t AS (SELECT doc_id, len(lines) AS n_lines, len(lines) - len(kept) AS n_lines_removed, array_to_string(list_transform(kept, lambda i: lines[i]), chr(10)) AS text FROM k)
SELECT doc_id, n_lines, n_lines_removed, length(text) AS n_chars_left, sha256(text) AS text_sha256 FROM t
"""


def op3_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness."""
    return fingerprints.fingerprints(load(spark, sf_dir, "documents"))


def _fingerprints_sql() -> str:
    word = lambda d, part: f"('0x' || substr({d}, {15 * part + 1}, 15))::BIGINT"
    vector = """{{'n': len(u), 'words': list_transform([{sums}], lambda x: (x % 1152921504606846976)::BIGINT), 'bits': flatten([{bits}])}}"""
    sums = ", ".join(f"list_sum(list_transform(u, lambda x: x.{w}::HUGEINT))" for w in ("a0", "a1", "b0", "b1"))
    bits = ", ".join(
        f"list_transform(range(0, 60), lambda k: list_sum(list_transform(u, lambda x: (x.{w} >> ((k // 5) + 12 * (k % 5))::INT) & 1))::BIGINT)" for w in ("a0", "a1")
    )
    vector = vector.format(sums=sums, bits=bits)
    units = f"list_transform(list_transform(string_split(regexp_replace(t, '{fingerprints.SENTENCE_END}', '\\1' || chr(10), 'g'), chr(10)), lambda p: {{'a': md5(p), 'b': md5('+' || p)}}), lambda d: {{'a0': {word('d.a', 0)}, 'a1': {word('d.a', 1)}, 'b0': {word('d.b', 0)}, 'b1': {word('d.b', 1)}}})"
    shown = lambda v: f"{v}.n || ':' || array_to_string({v}.words, '.') || ':' || array_to_string({v}.bits, '.')"
    sign = lambda v: f"list_transform({v}.bits, lambda x: 2 * x - {v}.n)"
    near = "CASE WHEN {s} = 0 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - {d}::DOUBLE / {s}) END"
    d = lambda b: f"list_sum(list_transform(list_zip(sa, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    s = lambda b: f"list_sum(list_transform(list_zip(sa, {b}), lambda p: p[1] * p[1] + p[2] * p[2]))::BIGINT"
    return f"""
WITH r AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id DESC) AS k, count(*) OVER () AS n FROM documents),
p AS (SELECT a.doc_id, a.text, b.text AS next_text, a.text[1 : length(a.text) - length(a.text) // 2] || b.text[1 : length(a.text) // 2] AS edited FROM r a JOIN r b ON b.k = a.k % a.n + 1),
long AS (SELECT doc_id, kind, t FROM (SELECT doc_id, unnest(['v', 'e', 'f']) AS kind, unnest([text, edited, next_text]) AS t FROM p)),
u AS (SELECT doc_id, kind, {units} AS u FROM long),
v AS (SELECT doc_id, kind, {vector} AS v FROM u),
w AS (SELECT doc_id, any_value(v) FILTER (kind = 'v') AS v, any_value(v) FILTER (kind = 'e') AS e, any_value(v) FILTER (kind = 'f') AS f FROM v GROUP BY doc_id),
g AS (SELECT doc_id, {sign('v')} AS sa, {sign('e')} AS sb, {sign('f')} AS sc, {shown('v')} AS fingerprint, {shown('e')} AS edited_fingerprint FROM w),
h AS (SELECT *, {d('sb')} AS db, {s('sb')} AS qb, {d('sc')} AS dc, {s('sc')} AS qc FROM g)
SELECT doc_id, length(p.text) AS n_chars, sha256(p.edited) AS edited_sha256, fingerprint, edited_fingerprint, {near.format(d='db', s='qb')} AS near_edited, {near.format(d='dc', s='qc')} AS near_next
FROM h JOIN p USING (doc_id)
"""


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard, slot, size and text checksum of every document."""
    return hilbert_shards.shards(load(spark, sf_dir, "documents"))


QUERIES = {"op1_line_chunk_dedup": op1_line_chunk_dedup, "op1_line_run_dedup": op1_line_run_dedup, "op3_multiset_fingerprints": op3_multiset_fingerprints, "op5_hilbert_shards": op5_hilbert_shards}
ORACLE_SQL = {"op1_line_chunk_dedup": OP1_SQL, "op1_line_run_dedup": OP1_RUNS_SQL, "op3_multiset_fingerprints": _fingerprints_sql()}
