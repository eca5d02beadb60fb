"""Counts of words that aren't sent to the executors."""

import math
import zlib
from collections import Counter

from loomgraph.llm import lm_scoring


def test_only_held_out_rows_meet_in_buckets(spark, monkeypatch):
    texts = {i: " ".join(f"w{(i * k) % 11}" for k in range(i % 9)) + (" new" if i % 5 == 0 else "") for i in range(60)}
    out = {i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    count = Counter(w for i in texts if i not in out for w in [*texts[i].split(), None])
    met, plain = [], lm_scoring.spread_join
    monkeypatch.setattr(lm_scoring, "HOT_WORDS", 1)  # no word is frequent
    monkeypatch.setattr(lm_scoring, "ROUNDS", 1)
    monkeypatch.setattr(lm_scoring, "LEAST_SYMBOLS", 1)
    monkeypatch.setattr(lm_scoring, "spread_join", lambda rows, *x, **y: met.append(rows.count()) or plain(rows, *x, **y))
    rows = lm_scoring.scores(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    n, v = sum(count.values()), len(count)
    for r in rows:
        tokens = [*texts[r["doc_id"]].split(), None]
        assert r["n_known"] == sum(count[w] > 0 for w in tokens)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens), abs_tol=1e-9)
    assert len(rows) == 60 and out and sum(met) == sum(len(set(texts[i].split())) for i in out)
