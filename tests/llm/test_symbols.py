"""The language model goes over stored symbols, in memory that it keeps."""

import tracemalloc
from collections import Counter

import numpy as np
import pytest
from texts import frame

from loomgraph.llm import gru, lm_scoring


def test_stored_symbols_are_the_lexicons(spark):
    """Of frequent, rare and unseen words: the symbols, sums and rare words of a text are those of its tokens."""
    seen = Counter({f"w{i}".encode(): 40 - i for i in range(20)})
    h = lambda w: int(lm_scoring._hashes([w])[:1].view(np.int64)[0])
    hot = [(h(w), lm_scoring.bucket(w), c) for w, c in seen.items() if c > 25]
    tail = Counter()
    for w, c in seen.items():
        tail[lm_scoring.bucket(w)] += c + 1
    size, lm_scoring.SYMBOLS = lm_scoring.SYMBOLS, 5
    try:
        lexicon = lm_scoring.Lexicon([*hot, (0, -1, 9)], tail, sum(seen.values()) + 9, 21, 9)
    finally:
        lm_scoring.SYMBOLS = size
    texts = ["w0 W1 w7 w19 w19 never", "", "w3", "w18 w18 w18 w2", " \n", "W19 w0"]
    rows = frame(spark, list(enumerate(texts))).selectExpr("doc_id", "text", "doc_id % 2 = 0 as held_out", "3L as share")
    got = {x["doc_id"]: x for x in lm_scoring.symbols_of(rows, spark.sparkContext.broadcast(lexicon)).collect()}
    assert len({x["row"] for x in got.values()}) == len(texts)
    for i, text in enumerate(texts):
        tokens, x = text.encode().lower().split(), got[i]
        symbol, c, hashes = lexicon.read(tokens)
        assert np.frombuffer(x["symbols"], np.int16).tolist() == symbol.tolist()
        assert (x["n_tokens"], x["n_known"], x["held_out"], x["share"]) == (len(tokens) + 1, (c > 0).sum(), i % 2 == 0, 3)
        assert x["rare"] == Counter(hashes[c < 0].view(np.int64).tolist())
        log_c = np.log10(np.maximum(c, 0) + 1.0)
        inside = (symbol >= lexicon.first_bucket) & (symbol < lexicon.end)
        assert x["logs"] == pytest.approx(log_c.sum())
        assert x["tail"] == pytest.approx((log_c[inside] - lexicon.log_mass[symbol[inside] - lexicon.first_bucket]).sum())


def test_windows_are_computed_in_kept_memory():
    """A window after the first asks for little memory; each one of the arrays of all its states and logits is larger."""
    rng = np.random.default_rng(6)
    adam = gru.Adam(gru.Network.fresh(rng.integers(1, 1000, 400).astype(float), 24))
    x, y, h = rng.integers(0, 400, (1024, 16)), rng.integers(0, 400, (1024, 16)), np.zeros((1024, 24), np.float32)
    h, _ = adam.update(x, y, h, 0.01)
    tracemalloc.start()
    try:
        adam.update(x, y, h, 0.01)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 3_000_000
