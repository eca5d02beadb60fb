"""The transducer against the sentencepiece library."""

import random

import numpy as np
import sentencepiece

from loomgraph.llm.piece_transducer import Recent, default_path, transducer


def test_against_the_library():
    t, sp = transducer(default_path()), sentencepiece.SentencePieceProcessor(model_file=default_path())
    r = random.Random(1)
    texts = ["", " ", "  a  b ", "\n", "\t x", "ﬁ ①", "日本語", "😀", "\x00a", "a\r\nb", "▁x", "<s>", "<0x41>", " " * 17, "a" + " " * 33 + "b", "don't, (x_y).", "e²."]
    texts += ["".join(r.choices("abcdeinorst \n éüß日本,.-…😀\t0123ÅЖ   _'²", k=r.randint(0, 40))) for _ in range(4000)]
    texts += [" ".join("".join(r.choices(["th", "er", "on", "an", "tion", "é", "ß", "x"], k=r.randint(1, 8))) for _ in range(20)) for _ in range(300)]
    for x in texts:
        ids = t.encode(x)
        assert np.frombuffer(ids, "<u4").tolist() == sp.encode(x), x
        assert t.decode(ids) == sp.decode(sp.encode(x))
        assert "▁" in x or t.decode(ids) == x


def test_adjacent_pieces_against_merging():
    t = transducer(default_path())
    r, pieces = random.Random(2), [p for p in t.id_of if len(p) > 1]
    for _ in range(5000):
        whole = r.choice(pieces) + r.choice(["", "a", "in", "er"])
        k = r.randint(1, len(whole) - 1)
        for left, right in ((whole[:k], whole[k:]), (r.choice(pieces), r.choice(pieces))):
            if left in t.id_of and right in t.id_of:
                assert t._stay_apart(left, right) == (t.merged(left + right) == [left, right])


def test_recent_is_bounded():
    table = Recent(3)
    for i in range(20):
        table.put(i, i)
        assert table.get(0) in (0, None) and len(table.young) <= 3 and len(table.old) <= 3
