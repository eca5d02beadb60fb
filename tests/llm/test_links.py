"""Numbers of links of the Jaccard join against all pairs."""

import pytest
from test_dedup import near, near_rows
from texts import frame

from loomgraph.llm import jaccard_join
from loomgraph.llm.shingles import words


def plain_links(rows, size, percent):
    sets = [frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if (w := words(t)) else frozenset() for _, t in rows]
    return {i: sum(y != x and bool(a) and 100 * len(a & b) >= percent * len(a | b) for y, b in enumerate(sets)) for x, ((i, _), a) in enumerate(zip(rows, sets))}


@pytest.mark.parametrize("link_rows", [1024, 12])
def test_no_link_is_left_out(spark, monkeypatch, link_rows):
    monkeypatch.setattr(jaccard_join, "LINK_ROWS", link_rows)
    rows = near_rows(3, 2, 90, 100, 9)
    rows += [(1000 + i, t) for i, (_, t) in enumerate(rows[:9])] + [(9000, None), (9001, ""), (9002, "one two"), (9003, "ONE\ttwo")]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["n_links"]) for x in jaccard_join.classes(frame(spark, rows), size=5, percent=80).collect()}
    links, classes = plain_links(rows, 5, 80), near(rows, 5, 80)
    assert got == {i: (*classes[i], links[i]) for i in links} and max(links.values()) > 12
