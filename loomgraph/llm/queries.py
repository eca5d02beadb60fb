"""The registered queries of the text operators, with their DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, queries_models, queries_native, queries_similar, queries_tokens, secret_scan
from .common import load

SHA = "sha256(coalesce(text, ''))"


def op8_bloom_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with the copy that stays, its group's size and its text's SHA-256."""
    return exact_dedup.copies(load(spark, sf_dir, "documents")).drop("suspect")


OP8_SQL = f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, {SHA} AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op4_blob_ledger_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, spans and their digest of the secrets of every document."""
    found = secret_scan.findings(load(spark, sf_dir, "documents"))
    spans = F.col("spans")
    kinds = {f"n_{r.kind}": secret_scan.n_of_kind(spans, r.kind) for r in secret_scan.RULES}
    listed = secret_scan.span_list(spans)
    return found.select("doc_id", *(c.alias(n) for n, c in kinds.items()), F.sha2(listed, 256).alias("base_sha256"), listed.alias("spans"))


def _secrets_sql() -> str:
    one = """
SELECT doc_id, {no} AS kind_no, '{kind}' AS kind, unnest(list_transform(range(1, len(size) + 1), lambda i: {{'s': list_sum(gap[1:i]) + coalesce(list_sum(size[1:i-1]), 0), 'n': size[i], 'tested': tested[i]}})) AS m, {least} AS least
FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '(?s)(.*?)({p})', 1), lambda x: length(x)) AS gap, list_transform(regexp_extract_all(text, '(?s)(.*?)({p})', 2), lambda x: length(x)) AS size,
  list_transform(regexp_extract_all(text, '(?s)(.*?)({p})', {g}), lambda x: length(x)) AS tested FROM documents)"""
    parts = [one.format(no=i, kind=r.kind, p=r.pattern.replace("'", "''"), g=2 + r.group, least=r.least) for i, r in enumerate(secret_scan.RULES)]
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secret_scan.RULES)
    return f"""
WITH every AS ({" UNION ALL ".join(parts)}),
found AS (SELECT doc_id, kind_no, kind, m.s::BIGINT AS s, (m.s + m.n)::BIGINT AS e FROM every WHERE m.tested >= least),
per AS (SELECT d.doc_id, {counts}, coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_no), '') AS spans FROM documents d LEFT JOIN found USING (doc_id) GROUP BY d.doc_id)
SELECT *, sha256(spans) AS base_sha256 FROM per
"""


QUERIES = {
    "op8_bloom_exact_dedup": op8_bloom_exact_dedup,
    "op4_blob_ledger_secrets": op4_blob_ledger_secrets,
} | queries_native.QUERIES | queries_similar.QUERIES | queries_tokens.QUERIES | queries_models.QUERIES
ORACLE_SQL = {
    "op8_bloom_exact_dedup": OP8_SQL,
    "op4_blob_ledger_secrets": _secrets_sql(),
} | queries_native.ORACLE_SQL | queries_similar.ORACLE_SQL | queries_tokens.ORACLE_SQL | queries_models.ORACLE_SQL
