"""The pipeline's stages against plain versions on the smallest documents, and registered queries against SQL."""

import os
from collections import Counter

import duckdb
import pytest
from test_dedup import near
from test_secrets import plain

import corpus_pipeline
from loomgraph.llm import queries, toxicity
from loomgraph.llm.common import load, stored

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = c.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert Counter(tuple(r) for r in df.select(*columns).collect()) == Counter(want)


def test_stages(spark):
    docs = load(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "ngram_jaccard_join", "secret_scans", "packing"]
    bad = {r["doc_id"] for r in toxicity.scores(docs, load(spark, SF, "labels")).where("predicted = 1").collect()}
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    after = stored(corpus_pipeline.drop_toxic(spark, docs, SF), "t")
    rows = {i: t for i, t in rows.items() if i not in bad}
    assert after.columns == docs.columns and {r["doc_id"] for r in after.collect()} == set(rows)
    after = stored(corpus_pipeline.drop_copies(spark, after, SF), "t")
    last = {t: i for i, t in sorted(rows.items())}
    rows = {i: t for i, t in rows.items() if last[t] == i}
    assert after.columns == docs.columns and {r["doc_id"] for r in after.collect()} == set(rows)
    after = stored(corpus_pipeline.drop_near_copies(spark, after, SF), "t")
    classes = near(list(rows.items()), 5, 80)
    rows = {i: t for i, t in rows.items() if classes[i][1] == i}
    assert after.columns == docs.columns and {r["doc_id"] for r in after.collect()} == set(rows)
    after = stored(corpus_pipeline.mask_secrets(spark, after, SF), "t")
    got = {r["doc_id"]: r["text"] for r in after.collect()}
    assert after.columns == docs.columns and set(got) == set(rows)
    for i, t in rows.items():
        assert (got[i] == t) == (not plain(t)) and not any(x[3] != "assign" for x in plain(got[i]))
    pieces = corpus_pipeline.pack_sequences(spark, after, SF)
    assert {r["doc_id"] for r in pieces.collect()} == set(rows)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() > 100
