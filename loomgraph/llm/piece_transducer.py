"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The normaliser maps spaces to U+2581 and puts one in front. The piece transducer has a state for each piece last read;
an arc reads a further piece's characters, writes its id and costs one if the two pieces may stand side by side, else
infinitely much. Characters outside the vocabulary are read by byte arcs. Composed with an input and shortest in the
tropical semiring, a path is the model's encoding.

The vocabulary at hand is a BPE model, whose encoding isn't the path of the best scores but that of its merges. Merges
look at neighbours only: a sequence of pieces is the encoding of its text exactly if each two adjacent pieces are the
encoding of theirs. With that as the arcs' weights one finite path is left for every prefix of an input, and so one
state for each of its positions.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SPACE = "▁"
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Entries that each of the two generations of a worker's tables of segments and of adjacent pieces holds at most.
SEGMENTS, PAIRS = 300_000, 300_000
PREFIX, UNKNOWN = -1, -2


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Recent:
    """A table of bounded size: what was used since the table last filled, and what was in it then."""

    def __init__(self, size: int) -> None:
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Transducer:
    """Normaliser, pieces and byte fallback of one BPE model file."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only BPE models whose normaliser keeps every character are supported")
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        kinds = pb.ModelProto.SentencePiece
        normal = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)]
        if any(SPACE in p[1:] and set(p) != {SPACE} for _, p, _ in normal):
            raise ValueError("pieces that hold a space behind other characters aren't supported")
        self.id_of = {p: i for i, p, _ in normal}
        self.score = {p: s for _, p, s in normal}
        # the pieces as a tree: the id of each piece, PREFIX for what only begins one
        self.nodes = {p[:k]: PREFIX for p in self.id_of for k in range(1, len(p))} | self.id_of
        self.joined = {p[k : k + 2] for p in self.id_of for k in range(len(p) - 1)}
        if any(c not in self.id_of for p in self.id_of for c in p):
            raise ValueError("pieces with characters outside the vocabulary aren't supported")
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.raw = [p.piece.replace(SPACE, " ").encode() if p.type in (kinds.NORMAL, kinds.USER_DEFINED) else bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else b"" for p in model.pieces]
        self.adjacent = Recent(PAIRS)
        self.whole: dict[str, bool] = {}
        self.halves: dict[str, tuple[str, str]] = {}
        self.segments = Recent(SEGMENTS)
        # segments begin at spaces, and after a word where a mark follows that no piece joins to a letter
        letter = re.compile(f"[{LETTERS}]")
        marks = "".join(re.escape(c) for c in sorted({c for p in self.id_of for c in p}) if not c.isalnum() and c not in f"_{SPACE}\n" and not any(b == c and letter.match(a) for a, b in self.joined))
        lines = "" if "\n" in self.id_of else "\n"
        self.plain = re.compile(f"{SPACE}*[{LETTERS}]+")
        self.cut = re.compile(f"{SPACE}*[{LETTERS}]+(?=[{marks}])|{SPACE}*[^{SPACE}{lines}]+|{SPACE}+|\n")

    def merged(self, text: str) -> list[str]:
        """The encoding of a short text by merging the best-scored neighbours, the first of equals, until none is left."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            if len(parts) == 2:
                self.halves.setdefault(text, (parts[0], parts[1]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def is_whole(self, piece: str) -> bool:
        """Whether a piece's own text is encoded by that piece."""
        if piece not in self.whole:
            self.whole[piece] = len(piece) == 1 or self.merged(piece) == [piece]
        return self.whole[piece]

    def last_merge(self, piece: str) -> tuple[str, str]:
        """The two halves that a whole piece was merged from."""
        if piece not in self.halves:
            self.merged(piece)
        return self.halves[piece]

    def may_follow(self, left: str, right: str) -> bool:
        """Whether the arc from state ``left`` over ``right`` has a finite weight."""
        key = self.id_of[left] << 32 | self.id_of[right]
        found = self.adjacent.get(key)
        if found is None:
            found = self._stay_apart(left, right)
            self.adjacent.put(key, found)
        return found

    def _stay_apart(self, left: str, right: str) -> bool:
        """Undo the last merges of both pieces, latest first: at no time may the pieces at the seam merge earlier than
        the merge just undone."""
        if not (self.is_whole(left) and self.is_whole(right)):
            return False
        if left[-1] == SPACE and right[0] == SPACE:
            return self.merged(left + right) == [left, right]  # runs of spaces share one score
        score, after = self.score, None  # after: (score, on the left side) of the merge undone last
        while True:
            s = score.get(left + right)
            # across the seam a merge comes before one of equal score to its right, behind one to its left
            if s is not None and (after is None or s > after[0] or (s == after[0] and not after[1])):
                return False
            undo_left, undo_right = len(left) > 1, len(right) > 1
            if not undo_left and not undo_right:
                return True
            # the later merge of the two: the lower score, of equals the right one
            if undo_left and (not undo_right or score[left] < score[right]):
                after = (score[left], True)
                left = self.last_merge(left)[1]
            else:
                after = (score[right], False)
                right = self.last_merge(right)[0]

    def shortest_path(self, text: str) -> list[int]:
        """The ids on the one finite path over a normalised text.

        Depth first, long pieces first. A position that can be reached is reached by one path only, that of the prefix's
        encoding, so one from which the search has come back is never entered again.
        """
        nodes, recent, n = self.nodes, self.adjacent.young, len(text)
        path: list[tuple[int, int, list]] = []  # (begin, id, shorter pieces that begin there too)
        closed, at, before = bytearray(n + 1), 0, UNKNOWN
        while at < n:
            found, end = [], at + 1
            node = nodes.get(text[at:end])
            if node is None:
                found.append((end, UNKNOWN))
            while node is not None:
                if node >= 0:
                    found.append((end, node))
                end += 1
                node = nodes.get(text[at:end]) if end <= n else None
            while True:
                step = None
                while found:
                    end, node = found.pop()
                    if closed[end]:
                        continue
                    if at == 0:
                        ok = node == UNKNOWN or self.is_whole(text[:end])
                    elif before == UNKNOWN or node == UNKNOWN:
                        ok = True
                    else:
                        ok = recent.get(before << 32 | node)
                        if ok is None:
                            ok = self.may_follow(text[path[-1][0] : at], text[at:end])
                    if ok:
                        step = (at, node, found)
                        break
                if step:
                    path.append(step)
                    at, before = end, node
                    break
                closed[at] = 1
                at, _, found = path.pop()
                before = path[-1][1] if path else UNKNOWN
        out: list[int] = []
        for begin, node, _ in path:
            out.extend([node] if node != UNKNOWN else [self.byte_id[b] for b in text[begin].encode("utf-8", "surrogatepass")])
        return out

    def normalise(self, text: str) -> str:
        return self.prefix + text.replace(" ", SPACE) if text else ""

    def _segment(self, segment: str) -> bytes:
        """The ids of a segment, by its parts between characters that never stand side by side in a piece."""
        if self.plain.fullmatch(segment):
            return np.array(self.shortest_path(segment), "<u4").tobytes()
        kept, joined, parts, begin = self.segments, self.joined, [], 0
        for end in range(1, len(segment) + 1):
            if end == len(segment) or segment[end - 1 : end + 1] not in joined:
                part, begin = segment[begin:end], end
                ids = kept.get(part)
                if ids is None:
                    ids = np.array(self.shortest_path(part), "<u4").tobytes()
                    if len(part) <= 32:
                        kept.put(part, ids)
                parts.append(ids)
        return b"".join(parts)

    def encode(self, text: str) -> bytes:
        """The ids of a text, little-endian unsigned 32-bit. No piece reaches over the segments, so each is composed
        by itself, and frequent ones are kept."""
        kept, out = self.segments, []
        for s in self.cut.findall(self.normalise(text)):
            ids = kept.young.get(s) or kept.get(s)
            if ids is None:
                ids = self._segment(s)
                if len(s) <= 32:
                    kept.put(s, ids)
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def encoded(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, ids, n_ids) of every row; ids are little-endian unsigned 32-bit.

    Null and empty texts have no ids. Rows are independent: repeated rows give equal ids, a null doc_id stays, an empty
    table gives no rows, and other columns aren't read.
    """
    path = model_path or default_path()

    def run(batches):
        t = transducer(path)
        for part in slices(batches):
            ids = [t.encode(x) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "ids": pa.array(ids, pa.binary()), "n_ids": pa.array([len(x) // 4 for x in ids], pa.int64())})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, ids binary, n_ids long")


def decoded(encodings: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, ids, n_ids, text) of the rows of :func:`encoded`: the text that the ids stand for."""
    path = model_path or default_path()

    def run(batches):
        t = transducer(path)
        for part in slices(batches):
            texts = [t.decode(x) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "ids": part.column(1), "n_ids": part.column(2), "text": pa.array(texts, pa.string())})

    return encodings.select("doc_id", "ids", "n_ids").mapInArrow(run, "doc_id long, ids binary, n_ids long, text string")
