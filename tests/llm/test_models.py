"""The language model's probabilities and gradients, and toxicity against brute force and held-out labels."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from texts import frame

from loomgraph.llm import gru, lm_scoring, toxicity


def trained(net, texts, times, rate):
    """Goes through the texts, a lane each, so many times."""
    adam = gru.Adam(net)
    for _ in range(times):
        for t in texts[:8]:
            adam.update(np.concatenate([[net.start], t[:-1]])[None, :], t[None, :], np.zeros((1, net.hidden), np.float32), rate)


def test_probabilities_sum_to_one():
    net = gru.Network.fresh(np.array([50.0, 3, 7, 1, 20, 4, 9]), 8)
    trained(net, [np.array([0, 4, 0, 2, 6]), np.array([1, 3, 5])] * 20, 30, 0.01)
    h = np.random.default_rng(1).standard_normal((5, 8)).astype(np.float32)
    total = sum(np.exp(net.log_prob(h, np.full(5, s))) for s in range(7))
    assert total == pytest.approx(np.ones(5), abs=1e-5)


def test_gradients():
    """One step of training against numerical differences: the loss falls along the update."""
    texts = [np.array([0, 1, 2, 3, 0, 1, 2, 3]) for _ in range(8)]
    net = gru.Network.fresh(np.array([1.0, 1, 1, 1]), 12)
    before = net.score(texts).sum()
    trained(net, texts, 150, 0.02)
    assert net.score(texts).sum() > 0.3 * before and before < 0


def test_every_gradient_against_differences():
    """What one plain step changes in the mean loss is what the gradients say, for weights of every kind."""
    rng = np.random.default_rng(8)
    net = gru.Network.fresh(np.array([5.0, 3, 2, 4, 1]), 6)
    for p in net.params:
        p += rng.standard_normal(p.shape).astype(np.float32) * 0.3 * (np.abs(p) < 1e8)
    x, y = np.array([[net.start, 1, 2, net.start, 3]] * 2), np.array([[1, 2, 0, 3, 4]] * 2)
    loss = lambda: -(net.score([y[0, :3], y[0, 3:]])).sum() / 5
    adam = gru.Adam(net)
    adam.update(x, y, np.zeros((2, 6), np.float32), 0.0)
    grads = [m / 0.1 for m in adam.first]
    for p, g in zip(net.params, grads):
        for at in [tuple(rng.integers(0, k) for k in p.shape) for _ in range(12)]:
            if abs(p[at]) > 1e8:
                continue
            kept = p[at]
            p[at] = kept + np.float32(1e-2)
            up = loss()
            p[at] = kept - np.float32(1e-2)
            down = loss()
            p[at] = kept
            assert g[at] == pytest.approx((up - down) / 2e-2, abs=2e-3)


def test_state_is_carried_through_a_text():
    net = gru.Network.fresh(np.array([3.0, 1, 2]), 6)
    net.to_class[:] = np.random.default_rng(2).standard_normal(net.to_class.shape)
    texts = [np.array([0, 1, 2, 2, 1]), np.array([2]), np.array([1, 0, 1])]
    got = net.score(texts, rows_at_once=2, buffered=3)
    for t, s in zip(texts, got):
        h, x, total = np.zeros((1, 6), np.float32), net.start, 0.0
        for y in t:
            h = net.step(np.array([x]), h)
            total += float(net.log_prob(h, np.array([y]))[0])
            x = y
        assert s == pytest.approx(total, rel=1e-5)


def lm_rows():
    r = random.Random(3)
    a, b = [f"ab{i}" for i in range(40)], [f"éc{i}" for i in range(40)]
    return [(i, " ".join(r.choices(a if i % 2 else b, k=r.randint(5, 60))) + (" Rare%d" % i if i % 5 == 0 else "")) for i in range(300)]


@pytest.mark.parametrize("hot", [1 << 20, 8])
def test_scores(spark, monkeypatch, hot):
    monkeypatch.setattr(lm_scoring, "HOT_WORDS", hot)
    monkeypatch.setattr(lm_scoring, "LEAST_SYMBOLS", 150_000)
    rows = lm_rows()
    out = {x["doc_id"]: x for x in lm_scoring.scores(frame(spark, rows)).collect()}
    tokens = {i: t.encode().lower().split() + [None] for i, t in rows}
    seen = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(seen.values()), len(seen)
    for i, ws in tokens.items():
        x = out[i]
        assert (x["n_tokens"], x["n_known"], x["train_tokens"]) == (len(ws), sum(seen[w] > 0 for w in ws), n)
        assert x["base_score"] == pytest.approx(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in ws))
        assert x["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
    if hot > 8:
        held = [x for x in out.values() if x["held_out"]]
        assert sum(x["score"] for x in held) > sum(x["base_score"] for x in held)


def test_nearest_by_blocks_is_exact():
    r = random.Random(4)
    vectors = []
    for _ in range(500):
        raw = {t: r.random() for t in r.sample(range(30), r.randint(1, 6))}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        vectors.append({t: w / norm for t, w in raw.items()})
    index = toxicity.BlockMaxIndex(vectors, np.ones((500, 2)), np.ones(500, np.int64), [(i,) for i in range(500)], 30)
    for q in vectors[:60]:
        rows, sims = index.nearest(q, 7)
        every = sorted((round(sum(w * v.get(t, 0) for t, w in q.items()), 9) for v in vectors), reverse=True)
        assert list(sims) == pytest.approx([s for s in every if s >= every[6] and s > 0])
        assert len({index.ids[i] for i in rows}) == len(rows)


def test_toxicity_on_held_out_labels(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choices(["la", "ti", "on", "er", "da"], k=r.randint(2, 4)))
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        ws = [word() for _ in range(40)] + (r.choices(["idiot", "quxbad" + word(), "Scum!"], k=2) if bad else [])
        r.shuffle(ws)
        rows.append((i, " ".join(ws)))
        labels.append((i, int(bad)))
    out = toxicity.scores(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [x for x in out if x["held_out"]]
    wrong = sum(x["predicted"] != (x["doc_id"] % 6 == 0) for x in held)
    assert len(held) > 100 and wrong <= 0.03 * len(held)
    assert all(0 <= x["score"] <= 1 for x in out) and all(x["evidence"] for x in held)


def test_terms():
    find = toxicity.TermFinder(["ab$", "abc", "é$"])
    assert find("ab abc-ab xab É abcd") == {0: 2, 1: 2, 2: 1} and toxicity.TermFinder([])("ab") == {}


def test_scores_against_all_examples():
    """Votes from every example but the text's own, one by one, on the same scale."""
    r = random.Random(6)
    idf = np.array([1.0 + 0.1 * t for t in range(12)])
    label = {i: int(i % 4 == 0) for i in range(90)}
    examples = [(i, tuple(sorted({t: r.randint(1, 3) for t in r.sample(range(6 * label[i], 6 * label[i] + 6), r.randint(0, 3))}.items()))) for i in label]
    jury = toxicity.Jury(examples, label, {0: 136, 1: 46}, idf, 5)
    weight = {y: jury.weight[y] for y in (0, 1)}

    def plain(key, but):
        q, sims = toxicity._vector(dict(key), idf), []
        for i, other in examples:
            if i != but:
                sims.append((round(sum(w * toxicity._vector(dict(other), idf).get(t, 0) for t, w in q.items()), 5), label[i]))
        least = sorted((s for s, _ in sims), reverse=True)[4]
        near = [(s, y) for s, y in sims if s >= least]
        total = sum(s * weight[y] for s, y in near) + toxicity.PRIOR_WEIGHT
        return (sum(s * weight[y] for s, y in near if y) + toxicity.PRIOR_WEIGHT * jury.prior) / total

    for i, key in examples:
        assert jury.vote(key, jury.own(i))[0] == pytest.approx(plain(key, i), abs=1e-4)
        assert jury.vote(key, None)[0] == pytest.approx(plain(key, None), abs=1e-4)
        assert all(x["doc_id"] != i for x in jury.vote(key, jury.own(i))[1])
        want = 1 / (1 + math.exp(-(jury.scale[0] * math.log(plain(key, None) / (1 - plain(key, None))) + jury.scale[1])))
        assert jury.score(key, None)[0] == pytest.approx(want, abs=1e-3)


def test_scale_is_calibrated():
    """Labels drawn at other rates than the shares say: the fitted scale gives the rates, bin by bin."""
    rng = np.random.default_rng(3)
    share = rng.uniform(0.02, 0.98, 20000)
    true = toxicity.scaled(share, (2.0, -1.0))
    label = (rng.uniform(size=20000) < true).astype(int)
    got = toxicity.scaled(share, toxicity.fitted_scale(share, label, np.ones(20000)))
    for low in np.arange(0, 1, 0.1):
        here = (got >= low) & (got < low + 0.1)
        assert label[here].mean() == pytest.approx(got[here].mean(), abs=0.04)


def test_shares_of_the_whole_vocabulary_sum_to_one():
    """Over every word that was seen and one that wasn't, symbols and shares of buckets, as scores add them up."""
    r = random.Random(8)
    seen = Counter({f"w{i}".encode(): r.randint(1, 9) for i in range(400)})
    h = lambda w: int(lm_scoring._hashes([w])[:1].view(np.int64)[0])
    tail = Counter()
    for w, c in seen.items():
        tail[lm_scoring.bucket(w)] += c + 1
    size, lm_scoring.SYMBOLS = lm_scoring.SYMBOLS, 50
    try:
        lexicon = lm_scoring.Lexicon([*((h(w), lm_scoring.bucket(w), c) for w, c in seen.items()), (0, -1, 30)], tail, sum(seen.values()) + 30, 401, 30)
    finally:
        lm_scoring.SYMBOLS = size
    net = gru.Network.fresh(lexicon.counts, 6)
    net.to_class += np.random.default_rng(4).standard_normal(net.to_class.shape).astype(np.float32)
    state = np.random.default_rng(5).standard_normal((1, 6)).astype(np.float32)
    p = [math.exp(net.log_prob(state, np.array([s]))[0]) for s in range(len(lexicon.counts))]
    assert sum(p) == pytest.approx(1, abs=1e-5)
    shares = Counter()
    for w, c in seen.items():
        s, count, _ = lexicon.read([w])
        assert count[0] == c
        if s[0] >= lexicon.first_bucket:
            shares[s[0]] += (c + 1) / 10 ** lexicon.log_mass[s[0] - lexicon.first_bucket]
    for b in range(lm_scoring.BUCKETS):  # what is left is an unseen word's
        assert shares[lexicon.first_bucket + b] + 1 / 10 ** lexicon.log_mass[b] == pytest.approx(1)
