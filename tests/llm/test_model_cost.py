"""What the language model saves per symbol leaves its results as they are."""

import numpy as np
import pytest

from loomgraph.llm import gru, lm_scoring


def test_buckets_of_many_words_at_once():
    tokens = [x.encode() for x in ("a", "ab", "ä", "abcdefghijklm", "x" * 40, "日本", "-", "z9")]
    assert lm_scoring.buckets(tokens).tolist() == [lm_scoring.bucket(x) for x in tokens]
    assert lm_scoring.buckets([]).tolist() == []


@pytest.mark.parametrize("large", [False, True])
def test_scores_by_stretches(large):
    """Scores are sums over single steps, wherever stretches end, also where logits are too large to exponentiate."""
    rng = np.random.default_rng(3)
    net = gru.Network.fresh(rng.integers(1, 50, 30).astype(float), 5)
    for p in (net.to_class, net.to_member):
        p[...] = rng.standard_normal(p.shape) * (300 if large else 1)
    assert gru._moderate(net.to_class, net.class_bias) != large
    texts = [rng.integers(0, 30, n) for n in (1, 7, 40, 3, 40, 12)]
    for rows, buffered in ((1024, 1 << 16), (2, 5), (4, 1)):
        got = net.score(texts, rows, buffered)
        for text, score in zip(texts, got):
            h, x, want = np.zeros((1, 5), np.float32), np.array([net.start]), 0.0
            for y in text:
                h, x = net.step(x, h), np.array([y])
                want += float(net.log_prob(h, x)[0])
            assert score == pytest.approx(want, rel=1e-4)


def test_gradients_by_parts(monkeypatch):
    """Columns computed in parts add up to the gradients of all at once."""
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 30, (8, 16)), rng.integers(0, 30, (8, 16))
    found = []
    for at_once in (1 << 20, 10):
        monkeypatch.setattr(gru, "AT_ONCE", at_once)
        adam = gru.Adam(gru.Network.fresh(np.arange(1.0, 31), 5))
        for _ in range(3):
            h, loss = adam.update(x, y, np.zeros((8, 5), np.float32), 0.01)
        found.append((h, loss, *adam.params))
    assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(*found))
