"""Query of the n-gram Jaccard join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import jaccard_join
from .common import load


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and shingle count of every document: 4-word shingles, similarity of 0.85 or more."""
    return jaccard_join.classes(load(spark, sf_dir, "documents"), size=4, percent=85, links=False)


def op7_ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, shingle count and number of links of every document, with every link counted."""
    return jaccard_join.classes(load(spark, sf_dir, "documents"), size=4, percent=85)


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS o FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * o >= 85 * (na + nb - o)),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached)
SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id FROM s JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""

OP7_LINKS_SQL = OP7_SQL.replace(", c.component_id", ", c.component_id, (SELECT count(*) FROM l WHERE l.a = s.doc_id) AS n_links")

QUERIES = {"op7_ngram_jaccard_join": op7_ngram_jaccard_join, "op7_ngram_jaccard_links": op7_ngram_jaccard_links}
ORACLE_SQL = {"op7_ngram_jaccard_join": OP7_SQL, "op7_ngram_jaccard_links": OP7_LINKS_SQL}
