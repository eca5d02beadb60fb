"""The recurrent weights learn from all training documents."""

import random

from texts import frame

from loomgraph.llm import lm_scoring


def test_weights_learn_from_all_documents(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "LEAST_SYMBOLS", 1_000_000)
    r = random.Random(9)
    rows = []
    for i in range(1500):
        k = r.randrange(30)
        rows.append((i, " ".join(f"w{(k + j) % 30}" for j in range(40))))
    out = [x for x in lm_scoring.scores(frame(spark, rows)).collect() if x["held_out"]]
    assert sum(x["score"] for x in out) > 0.8 * sum(x["base_score"] for x in out)
