"""Ids against the tokenizers library, and packing's laws."""

import random
import zlib

import numpy as np
from texts import frame

from loomgraph.llm import packing
from loomgraph.llm.tokens import PLAIN, default_paths, encoder


def test_both_engines_agree_on_plain_texts():
    paths = default_paths()
    fast, exact = encoder(*paths), encoder(paths[0], None)
    plain = [chr(c) for c in range(0x3000) if PLAIN.fullmatch(chr(c))]
    assert len(plain) > 500
    for c in plain:
        for t in (c, f"a{c}b", f" {c} {c}", f"1{c}2", c * 3, f"x {c}'s {c}!\n\n{c}", f"\n{c}  {c}"):
            assert list(fast(t)) == list(exact(t))
    r = random.Random(1)
    for _ in range(2000):
        t = "".join(r.choices([*plain, *"  \n\tabcs't1", "日", "😀"], k=r.randint(0, 40)))
        assert list(fast(t)) == list(exact(t))


def test_packing(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choices(["alpha", "beta", "Gamma", "日本", "1234"], k=r.randint(0, 300)))) for i in range(400)]
    out = packing.pack(frame(spark, rows).repartition(7), size=128, n_open=4).collect()
    exact = encoder(default_paths()[0], None)
    pieces, sequences = {}, {}
    for p in out:
        pieces.setdefault(p["doc_id"], []).append(p)
        sequences.setdefault(p["sequence_id"], []).append(p)
    for i, t in rows:
        ids, at = np.append(exact(t), np.uint32(0)), 0
        for p in sorted(pieces[i], key=lambda p: p["start"]):
            own = ids[at : at + p["length"]].astype("<u4").tobytes()
            assert (p["start"], p["doc_tokens"], bytes(p["token_ids"]), p["ids_crc32"]) == (at, len(ids), own, zlib.crc32(own))
            at += p["length"]
        assert at == len(ids)
    for own in sequences.values():
        own.sort(key=lambda p: p["offset"])
        ends = np.cumsum([p["length"] for p in own])
        assert [p["offset"] for p in own] == [0, *ends[:-1]] and ends[-1] <= 128 and int(ends[-1]) & int(ends[-1]) - 1 == 0


def test_open_windows_are_bounded():
    p = packing.Packer(10, 3)
    closed = [w for k in range(50) for w in p.take(k, np.arange(k % 23 + 1, dtype=np.uint32))]
    assert len(p.windows) == 3 and all(w.used == 10 for w in closed) and all(w.used < 10 for w in p.windows)
