"""Bounded-space online packing of token ids into sequences.

Each partition keeps a fixed number of open windows. A document's whole windows leave at once; the rest goes to the
open window that it fits best. Where none fits, the fullest one is filled up with the head of the rest and emitted, and
the tail starts a new window. The windows still open at the end of a partition are merged with those of neighbouring
partitions; what remains there is cut into lengths that are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored
from .tokens import default_paths, encoder

#: Partitions whose last windows are merged by one task.
MERGED = 32
END_ID = 0
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, token_ids binary"
_ARROW = pa.schema([(n, pa.binary() if t == "binary" else pa.int64()) for n, t in (c.split() for c in (PIECES + ", open long").split(", "))])


class Window:
    """An open sequence: (doc_id, start, doc_tokens, ids) pieces."""

    def __init__(self) -> None:
        self.pieces: list[tuple] = []
        self.used = 0

    def add(self, doc_id, start: int, total: int, ids: np.ndarray) -> None:
        self.pieces.append((doc_id, start, total, ids))
        self.used += len(ids)

    def rows(self, sequence: int, kept: bool, is_open: int) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, total, ids in self.pieces:
            raw = ids.astype("<u4").tobytes()
            yield doc_id, start, len(ids), zlib.crc32(raw), total, sequence, offset, raw if kept or is_open else None, is_open
            offset += len(ids)


class Packer:
    """Best-fit packing with ``n_open`` windows; ``take`` returns the windows that a document closes."""

    def __init__(self, size: int, n_open: int) -> None:
        self.size, self.windows = size, [Window() for _ in range(n_open)]

    def take(self, doc_id, ids: np.ndarray) -> Iterator[Window]:
        at, total = 0, len(ids)
        while total - at >= self.size:
            whole = Window()
            whole.add(doc_id, at, total, ids[at : at + self.size])
            at += self.size
            yield whole
        if at == total:
            return
        rest = total - at
        fitting = [k for k, w in enumerate(self.windows) if w.used + rest <= self.size]
        if fitting:
            k = max(fitting, key=lambda k: self.windows[k].used)
            self.windows[k].add(doc_id, at, total, ids[at:])
        else:
            k = max(range(len(self.windows)), key=lambda k: self.windows[k].used)
            head = self.size - self.windows[k].used
            self.windows[k].add(doc_id, at, total, ids[at : at + head])
            yield self.windows[k]
            self.windows[k] = Window()
            self.windows[k].add(doc_id, at + head, total, ids[at + head :])
        if self.windows[k].used == self.size:
            yield self.windows[k]
            self.windows[k] = Window()


def merged(windows: list[Window], size: int) -> list[Window]:
    """Open windows merged into full ones, and what is left over into lengths that are powers of two."""
    out, current = [], Window()
    total = sum(w.used for w in windows)
    full, over = divmod(total, size)
    lengths = [size] * full + [1 << b for b in reversed(range(over.bit_length())) if over >> b & 1]
    wanted = iter(lengths)
    room = next(wanted, 0)
    for w in sorted(windows, key=lambda w: -w.used):
        for doc_id, start, doc_tokens, ids in w.pieces:
            while len(ids):
                n = min(room - current.used, len(ids))
                current.add(doc_id, start, doc_tokens, ids[:n])
                start, ids = start + n, ids[n:]
                if current.used == room:
                    out.append(current)
                    current, room = Window(), next(wanted, 0)
    return out


def pack(docs: DataFrame, *, size: int = 1024, n_open: int = 16, with_ids: bool = True, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, token_ids.

    A document's ids are those of its text (null: empty), then id 0, so that an empty one has one id. token_ids are
    little-endian unsigned 32-bit ids, null unless ``with_ids``. Repeated rows, and rows with a null doc_id, are packed
    each by itself. An empty table gives no rows; other columns aren't read. Memory is bounded by ``n_open`` windows
    and one document a task.
    """
    if json_path is None:
        json_path, ranks_path = default_paths()

    def fill(batches):
        encode, packer, base, n = encoder(json_path, ranks_path), Packer(size, n_open), TaskContext.get().partitionId() << 32, 0
        rows: list[tuple] = []
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for window in packer.take(doc_id, np.append(encode(text), np.uint32(END_ID))):
                    rows.extend(window.rows(base + n, with_ids, 0))
                    n += 1
                if len(rows) >= 1024:
                    yield _batch(rows)
                    rows = []
        for window in packer.windows:
            rows.extend(window.rows(base + n, True, 1))
            n += 1
        yield _batch(rows)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        windows = []
        for _, w in pdf.sort_values(["sequence_id", "offset"]).groupby("sequence_id", sort=True):
            windows.append(Window())
            for doc_id, start, total, raw in zip(w["doc_id"], w["start"], w["doc_tokens"], w["token_ids"]):
                windows[-1].add(None if pd.isna(doc_id) else int(doc_id), int(start), int(total), np.frombuffer(raw, "<u4"))
        base = 1 << 62 | int(pdf["sequence_id"].min()) & ~0xFFFFFFFF
        rows = [r[:8] for k, w in enumerate(merged(windows, size)) for r in w.rows(base + k, with_ids, 0)]
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])
        return out.astype({c: "Int64" for c in out.columns if c != "token_ids"})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = stored(texts.mapInArrow(fill, PIECES + ", open long"), "pieces")
    closed = pieces.where("open = 0").drop("open")
    left = pieces.where("open = 1").drop("open")
    group = F.shiftright("sequence_id", 32 + MERGED.bit_length() - 1)
    return closed.unionByName(left.groupBy(group.alias("_group")).applyInPandas(merge, PIECES))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)
