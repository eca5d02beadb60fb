"""Every operator on odd rows, repeated rows, an empty table and columns with clashing names."""

import pytest
from pyspark.sql import functions as F
from texts import ODD, frame

from loomgraph.llm import exact_dedup, fingerprints, hilbert_shards, jaccard_join, line_dedup, lm_scoring, packing, piece_transducer, secret_scan, toxicity

N = len(ODD)


def labels(spark):
    return spark.createDataFrame([(4, 0), (5, 1), (6, None), (99, 1), (None, 1)], "doc_id long, toxic int")


OPERATORS = {
    "line_dedup": lambda s, d: line_dedup.deduplicated(d),
    "fingerprints": lambda s, d: fingerprints.fingerprints(d),
    "secret_scan": lambda s, d: secret_scan.findings(d),
    "redacted": lambda s, d: secret_scan.redacted_documents(d),
    "shards": lambda s, d: hilbert_shards.shards(d),
    "pieces": lambda s, d: piece_transducer.decoded(piece_transducer.encoded(d)),
    "classes": lambda s, d: jaccard_join.classes(d),
    "copies": lambda s, d: exact_dedup.copies(d),
    "lm": lambda s, d: lm_scoring.scores(d),
    "toxicity": lambda s, d: toxicity.scores(d, labels(s)),
}


@pytest.fixture(scope="module", autouse=True)
def quick():
    before, lm_scoring.LEAST_SYMBOLS = lm_scoring.LEAST_SYMBOLS, 100
    yield
    lm_scoring.LEAST_SYMBOLS = before


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(spark, name):
    out = OPERATORS[name](spark, frame(spark, ODD, extra=True)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out) == sorted((i is None, i or 0) for i, _ in ODD)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, frame(spark, ODD).limit(0)).collect() == []


def test_rows_that_stay(spark):
    docs = frame(spark, ODD, extra=True)
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len({t or "" for _, t in ODD})
    one = jaccard_join.one_per_class(docs)
    assert one.columns == docs.columns and one.where("doc_id = 7").count() == 1 and one.where("doc_id = 8").count() == 0
    assert one.where(F.coalesce("text", F.lit("")) == "").count() == 3
    assert toxicity.accepted(docs, labels(spark)).columns == docs.columns


def test_packing_takes_them_all(spark):
    out = packing.pack(frame(spark, ODD, extra=True), size=64, n_open=2).collect()
    assert sum(r["length"] for r in out if r["start"] == 0 and r["doc_id"] in (1, 2)) == 2
    assert sum(r["doc_id"] is None for r in out) >= 3 and packing.pack(frame(spark, ODD).limit(0)).collect() == []
