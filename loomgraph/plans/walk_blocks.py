"""The sums of a PageRank sweep over blocks of a hypergraph, as arrays.

Hyperedges lie in ranges, a block each, which holds its incidences as codes of its own vertices; vertices lie in ranges
too. Blocks stay where they are. A sweep moves one number for each vertex of a block to it and one back, however many
incidences the block has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored

#: Incidences of a block, and vertices of a range.
BLOCK_ROWS, RANGE_ROWS = 500_000, 100_000
#: Kinds of rows: values on the way to ``part`` from ``peer``, and a range's own scores.
MOVED, SCORES = 0, 1
_BLOCKS = "kind int, part int, peer int, a binary, b binary, c binary, d binary"
_STATE = "kind int, part int, peer int, value binary, change double, dangling double"
_NAMES = [x.split()[0] for x in _STATE.split(", ")]


def _array(value: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(value, kind)


def _state(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.float64(), pa.float64())
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(_NAMES, kinds))})


class WalkBlocks:
    """Blocks of ``weighted`` (hyperedge_id, vertex_id, weight) of ``n_rows`` rows and ranges of ``ids`` (vertex_id) of
    ``n``."""

    def __init__(self, ids: DataFrame, weighted: DataFrame, n: int, n_rows: int, rows: int = BLOCK_ROWS, width: int = RANGE_ROWS) -> None:
        ranges = -(-n // width) or 1
        self.ranges = stored(ids.repartitionByRange(ranges, "vertex_id").mapInArrow(_ranges, "part int, least long, ids binary"), "walk-ranges")
        least = sorted((r["least"], r["part"]) for r in self.ranges.select("least", "part").collect())
        bounds, parts = np.array([x for x, _ in least], np.int64), np.array([p for _, p in least], np.int64)
        blocks = stored(weighted.select("hyperedge_id", "vertex_id", "weight").repartitionByRange(-(-n_rows // rows) or 1, "hyperedge_id").mapInArrow(_blocks(bounds, parts), _BLOCKS), "walk-blocks")
        self.lists = max(-(-n_rows // rows), ranges)
        # kept by part, so that the sweeps shuffle only what moves
        self.blocks = blocks.where("kind = 0").select("part", "a", "b", "c", "d").repartition(self.lists, "part").persist(StorageLevel.DISK_ONLY)
        own = self.ranges.select("part", F.lit(-1).alias("peer"), "ids")
        routes = blocks.where("kind = 1").select("part", "peer", F.col("a").alias("ids"))
        weights = blocks.where("kind = 1").select(F.lit(MOVED).alias("kind"), "part", "peer", F.col("b").alias("value"), F.lit(0.0).alias("change"), F.lit(0.0).alias("dangling"))
        self.routed = own.unionByName(routes).repartition(self.lists, "part")
        degrees = self.routed.groupBy("part").cogroup(weights.groupBy("part")).applyInArrow(_degrees, "part int, peer int, ids binary, d binary")
        self.vertices = stored(degrees, "walk-vertices").repartition(self.lists, "part").persist(StorageLevel.DISK_ONLY)
        self.n = n

    def first(self) -> DataFrame:
        """All scores 1 / n."""
        none = self.blocks.select(F.lit(MOVED).alias("kind"), "part", F.lit(0).alias("peer"), F.col("a").alias("value"), F.lit(0.0).alias("change"), F.lit(0.0).alias("dangling")).limit(0)
        return stored(self.vertices.groupBy("part").cogroup(none.groupBy("part")).applyInArrow(_scored(1.0 / self.n, 0.0, True), _STATE), "page-rank")

    def swept(self, state: DataFrame, base: float, damping: float) -> DataFrame:
        """The scores after one sweep, each ``base`` and ``damping`` times what flows in."""
        moved, own = state.where(F.col("kind") == MOVED), state.where(F.col("kind") == SCORES)
        back = self.blocks.groupBy("part").cogroup(moved.groupBy("part")).applyInArrow(_through, _STATE)
        return stored(self.vertices.groupBy("part").cogroup(back.unionByName(own).groupBy("part")).applyInArrow(_scored(base, damping, False), _STATE), "page-rank")

    def scores(self, state: DataFrame) -> DataFrame:
        """(vertex_id, score)."""
        own = state.where(F.col("kind") == SCORES).select("part", "value")
        return self.ranges.join(own, "part").select("ids", "value").mapInArrow(_rows, "vertex_id long, score double")

    def close(self) -> None:
        self.blocks.unpersist()
        self.vertices.unpersist()


def _all(batches: Iterator[pa.RecordBatch], *names: str) -> list[np.ndarray] | None:
    table = [b for b in batches if b.num_rows]
    return [np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in table]) for c in names] if table else None


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if (columns := _all(batches, "vertex_id")) is not None:
        ids = np.sort(columns[0])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([int(ids[0])], pa.int64()), pa.array([ids.tobytes()], pa.binary())], names=["part", "least", "ids"])


def _blocks(bounds: np.ndarray, parts: np.ndarray) -> Callable:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's codes, shares and the length of each range's part of its vertices; and a row for each range, with
        the vertices and what they weigh in this block."""
        if (columns := _all(batches, "hyperedge_id", "vertex_id", "weight")) is None:
            return
        part = TaskContext.get().partitionId()
        _, h = np.unique(columns[0], return_inverse=True)
        ids, v = np.unique(columns[1], return_inverse=True)
        weight = np.nan_to_num(columns[2].astype(np.float64))
        share = np.zeros(h.max() + 1)
        share[h] = weight
        share /= np.bincount(h)
        degree = np.bincount(v, weights=weight, minlength=len(ids))
        at = np.maximum(np.searchsorted(bounds, ids, side="right") - 1, 0)  # those below all ranges are no vertices
        begins = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        ends = np.append(begins[1:], len(ids))
        peers = parts[at[begins]]
        rows = [(0, part, -1, h.astype(np.int32).tobytes(), v.astype(np.int32).tobytes(), share.tobytes(), np.stack([peers, ends - begins]).astype(np.int64).tobytes())]
        rows += [(1, int(q), part, ids[i:j].tobytes(), degree[i:j].tobytes(), None, None) for q, i, j in zip(peers, begins, ends)]
        for r in rows:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32() if k < 3 else pa.binary()) for k, x in enumerate(r)], names=[x.split()[0] for x in _BLOCKS.split(", ")])

    return make


def _placed_in(ids: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``wanted`` lie in ``ids``, and whether they do."""
    at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
    return at, ids[at] == wanted


def _own(routes: pa.Table) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """A range's vertices and those of each block that has any."""
    lists = {p: _array(x.as_py(), np.int64) for p, x in zip(routes["peer"].to_pylist(), routes["ids"])}
    return lists.pop(-1), lists


def _summed(ids: np.ndarray, lists: dict[int, np.ndarray], rows: pa.Table) -> np.ndarray:
    """What the blocks sent, at each vertex."""
    out = np.zeros(len(ids))
    for kind, peer, value in sorted(zip(rows["kind"].to_pylist(), rows["peer"].to_pylist(), rows["value"].to_pylist()), key=lambda r: r[:2]):
        if kind == MOVED:
            at, known = _placed_in(ids, lists[peer])
            out[at[known]] += _array(value, np.float64)[known]
    return out


def _degrees(routes: pa.Table, weights: pa.Table) -> pa.Table:
    ids, lists = _own(routes)
    d = _summed(ids, lists, weights)
    peers = [-1, *lists]
    return pa.table({"part": pa.array([routes["part"][0].as_py()] * len(peers), pa.int32()), "peer": pa.array(peers, pa.int32()), "ids": pa.array([ids.tobytes(), *(x.tobytes() for x in lists.values())], pa.binary()), "d": pa.array([d.tobytes()] + [None] * len(lists), pa.binary())})


def _through(block: pa.Table, rows: pa.Table) -> pa.Table:
    """What comes out of a block's hyperedges at each of its vertices, by range."""
    if not block.num_rows or not rows.num_rows:
        return _state([])
    part = block["part"][0].as_py()
    h, v, share = _array(block["a"][0].as_py(), np.int32), _array(block["b"][0].as_py(), np.int32), _array(block["c"][0].as_py(), np.float64)
    peers, sizes = _array(block["d"][0].as_py(), np.int64).reshape(2, -1)
    came = dict(zip(rows["peer"].to_pylist(), rows["value"].to_pylist()))
    x = np.concatenate([_array(came[q], np.float64) for q in peers.tolist()])
    y = np.bincount(h, weights=x[v], minlength=len(share)) * share
    out = np.bincount(v, weights=y[h], minlength=len(x))
    cuts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    return _state([(MOVED, q, part, out[i:j].tobytes(), 0.0, 0.0) for q, i, j in zip(peers.tolist(), cuts, cuts[1:])])


def _scored(base: float, damping: float, first: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def score(vertices: pa.Table, rows: pa.Table) -> pa.Table:
        """A range's new scores, and what they send to each block."""
        ids, lists = _own(vertices)
        part = vertices["part"][0].as_py()
        d = _array(next(x for x in vertices["d"].to_pylist() if x is not None), np.float64)
        new = base + damping * _summed(ids, lists, rows)
        was = new if first else _array(next(x for k, x in zip(rows["kind"].to_pylist(), rows["value"].to_pylist()) if k == SCORES), np.float64)
        x = np.divide(new, d, out=np.zeros(len(ids)), where=d > 0)
        out = [(SCORES, part, part, new.tobytes(), float(np.abs(new - was).sum()), float(new[d <= 0].sum()))]
        for peer, wanted in lists.items():
            at, known = _placed_in(ids, wanted)
            out.append((MOVED, peer, part, np.where(known, x[at], 0.0).tobytes(), 0.0, 0.0))
        return _state(out)

    return score


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, value in zip(batch.column("ids"), batch.column("value")):
            yield pa.RecordBatch.from_arrays([pa.array(_array(ids.as_py(), np.int64)), pa.array(_array(value.as_py(), np.float64))], names=["vertex_id", "score"])
