"""Repeated runs of lines against brute force."""

import random

import pytest
from texts import ODD, frame

from loomgraph.llm import line_dedup


def plain_runs(rows, least=2):
    """Texts without the lines of any run of ``least`` or more that occurs earlier."""
    seen, out = set(), {}
    for i, t in rows:
        lines, gone = t.split("\n"), set()
        for k in range(len(lines) - least + 1):
            run = tuple(lines[k : k + least])
            if "".join(run).strip(" "):
                gone |= set(range(k, k + least)) if run in seen else set()
                seen.add(run)
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone))
    return out


def test_repeated_runs_go_whole(spark):
    r = random.Random(8)
    passages = [[f"shared {p} line {k}" for k in range(2 + p % 4)] for p in range(12)]
    rows = []
    for i in range(90):
        own = [[f"own {i} {k}" for k in range(r.randint(1, 4))], r.choice(passages), [f"more {i}"], r.choice(passages), ["", ""]]
        rows.append((i, "\n".join(x for part in own for x in part)))
    rows += [(200, "a\na\na\na"), (201, "one line"), (202, "one line"), (203, "")]
    docs = frame(spark, rows)
    got = {x["doc_id"]: (x["text"], x["n_lines_removed"]) for x in line_dedup.without_repeated_runs(docs).collect()}
    assert got == plain_runs(rows)
    # of the shared passages, only the first occurrence of each line is left, where chunks leave most
    left = [x for t, _ in got.values() for x in t.split("\n") if x.startswith("shared")]
    chunked = [x for y in line_dedup.deduplicated(docs).collect() for x in y["text"].split("\n") if x.startswith("shared")]
    assert sorted(left) == sorted({x for p in passages for x in p if x in left}) and len(chunked) > 2 * len(left)


@pytest.mark.parametrize("least", [2, 3])
def test_copies_of_whole_texts(spark, least):
    """Copies keep what no window holds; the first row stands for them, nulls first, repeated rows as one."""
    r = random.Random(9)
    pool = ["\n".join(r.choice(["", " ", "a", "b", "c", f"own {k}"]) for _ in range(r.randint(1, 9))) for k in range(40)]
    rows = [(i, r.choice(pool)) for i in range(300)]
    want = plain_runs([(None, pool[0]), *rows], least)
    docs = frame(spark, rows + rows[:20] + [(None, pool[0])] * 3)
    assert {x["doc_id"]: (x["text"], x["n_lines_removed"]) for x in line_dedup.without_repeated_runs(docs, least).collect()} == want
    assert line_dedup.without_repeated_runs(docs, least).count() == 323


def test_odd_rows(spark):
    out = line_dedup.without_repeated_runs(frame(spark, ODD, extra=True)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out) == sorted((i is None, i or 0) for i, _ in ODD)
    assert line_dedup.without_repeated_runs(frame(spark, ODD).limit(0)).collect() == []
