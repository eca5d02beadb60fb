"""Log-likelihood of whole documents under a recurrent word model.

Word counts come from every training document. The most frequent words, the end of a text, and buckets of all other
words by their last letters are the symbols of a gated recurrent network, trained by truncated backpropagation over all
training documents: in rounds, in each of which every partition goes on from the same weights over its own documents,
and the partitions' weights are then averaged by their numbers of symbols. A round takes a share of the documents, so
that a large corpus is gone through once; a small one is gone through until enough symbols have been seen. The
class-factored softmax gives each symbol's probability in the state that the whole text so far has left. A word that is
no symbol itself has its bucket's probability times its share of the bucket, (count + 1) / (sum of the bucket's counts
and words + 1), so that an unseen word has a share too and all shares sum to one. Words of a count below a fixed part of
the corpus aren't sent to the executors; their counts are joined. Texts are read twice, once for the counts and once for
their symbols, which are stored; training and scoring go over those.
"""

from __future__ import annotations

import copy
from collections import Counter
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, spread_join, stored
from .gru import Adam, Network, train_through
from .shingles import words

#: A word with at least this part of all tokens is sent to every executor: so many words at most.
HOT_WORDS = 1 << 20
#: Words that are symbols, buckets of the others, size of the state.
SYMBOLS, BUCKETS, HIDDEN = 1200, 96, 24
#: Rounds of training, the first one's rate, and the symbols that all rounds see at least, in repeated passes if need be.
ROUNDS, RATE, LEAST_SYMBOLS = 6, 0.006, 3_000_000
#: Symbols that a partition trains on at a time, weights to a row on their way to the average, and groups of partitions
#: that are averaged before all are.
SYMBOLS_AT_ONCE, WEIGHTS_AT_ONCE, GROUPS = 1 << 20, 2048, 64
#: Distinct words that a task counts before it passes them on, and that it holds looked up.
COUNT_AT_ONCE, READ_AT_ONCE = 500_000, 300_000
END = np.uint64(0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 7 == 2, F.lit(False))


def bucket(word: bytes) -> int:
    return (word[-1] * 31 + (word[-2] if len(word) > 1 else 0) * 17 + min(len(word), 12) // 4 * 5) % BUCKETS


def buckets(tokens: list[bytes]) -> np.ndarray:
    """``bucket`` of each word; no word is empty."""
    size, ends = np.fromiter(map(len, tokens), np.int64, len(tokens)), b"".join([x[-2:] for x in tokens])
    text, last = np.frombuffer(ends, np.uint8), np.cumsum(np.minimum(size, 2)) - 1
    return (text[last].astype(np.int64) * 31 + np.where(size > 1, text[last - 1], 0).astype(np.int64) * 17 + np.minimum(size, 12) // 4 * 5) % BUCKETS


def _hashes(tokens: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, none of which is the end's, and then the end."""
    out = np.empty(len(tokens) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    out[out == END] = 1
    out[-1] = END
    return out


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, bucket, c) of every token of ``texts`` (text); the end has bucket -1."""

    def count(batches):
        seen, ends = Counter(), 0

        def flush():
            distinct = list(seen)
            c = np.fromiter(seen.values(), np.int64, len(seen))
            return pa.RecordBatch.from_pydict({"h": pa.array(_hashes(distinct).view(np.int64)), "bucket": pa.array(np.append(buckets(distinct), -1).astype(np.int32)), "c": pa.array(np.append(c, ends))})

        for b in slices(batches):
            for text in b.column(0).to_pylist():
                seen.update(words(text))
                ends += 1
                if len(seen) >= COUNT_AT_ONCE:
                    yield flush()
                    seen, ends = Counter(), 0
        if ends:
            yield flush()

    return texts.mapInArrow(count, "h long, bucket int, c long").groupBy("h", "bucket").agg(F.sum("c").alias("c"))


class _Numbers(dict):
    """Numbers what it is asked for, from 0 on."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


class Lexicon:
    """Frequent words by hash: count and symbol. Symbols: words by falling count, then the buckets, the end last."""

    def __init__(self, hot: list[tuple[int, int, int]], tail: dict[int, float], total: int, distinct: int, ends: int) -> None:
        order = sorted((r for r in hot if r[1] >= 0), key=lambda r: (-r[2], r[0]))
        n_words = min(SYMBOLS, len(order))
        self.total, self.distinct = total, distinct
        symbols = {r[0]: i for i, r in enumerate(order[:n_words])}
        self.first_bucket, self.end = n_words, n_words + BUCKETS
        own = np.zeros(BUCKETS)
        for r in order[:n_words]:
            own[r[1]] += r[2] + 1
        mass = np.array([tail.get(b, 0.0) for b in range(BUCKETS)]) - own
        self.log_mass = np.log10(mass + 1)
        self.counts = np.array([*(r[2] for r in order[:n_words]), *np.maximum(mass, 1), max(ends, 1)], np.float64)
        rows = sorted((np.int64(r[0]).view(np.uint64), r[2], symbols.get(r[0], n_words + r[1]) if r[1] >= 0 else self.end) for r in hot)
        if ends and not any(h == END for h, _, _ in rows):
            rows = [(END, ends, self.end), *rows]
        self.h = np.array([r[0] for r in rows], np.uint64)
        self.c = np.array([r[1] for r in rows], np.int64)
        self.symbol = np.array([r[2] for r in rows], np.int64)

    def read(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, counts, hashes) of a text's tokens and its end; the count is -1 for words that aren't frequent."""
        h = _hashes(tokens)
        at = np.searchsorted(self.h, h)
        at[at == len(self.h)] = 0
        known = self.h[at] == h if len(self.h) else np.zeros(len(h), bool)
        symbol, c = (np.where(known, self.symbol[at], -1), np.where(known, self.c[at], -1)) if len(self.h) else (np.full(len(h), -1), np.full(len(h), -1))
        unread = np.flatnonzero(symbol[:-1] < 0)
        symbol[unread] = buckets([tokens[i] for i in unread.tolist()]) + self.first_bucket
        if symbol[-1] < 0:
            symbol[-1] = self.end
        return symbol, c, h


class Reader:
    """What ``Lexicon.read`` says of many texts, in which a distinct word is looked up once until ``READ_AT_ONCE`` words
    are held."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.known = _Numbers({None: 0}), self._of(self.lexicon.read([]))

    def _of(self, read: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
        """Of words: symbol, whether it is known and frequent, log10(count + 1), what a symbol's probability is to be
        multiplied with (log10), hash."""
        (symbol, c, h), first = read, self.lexicon.first_bucket
        log_c, in_bucket = np.log10(np.maximum(c, 0) + 1.0), (symbol >= first) & (symbol < self.lexicon.end)
        tail = np.zeros(len(symbol))
        tail[in_bucket] = log_c[in_bucket] - self.lexicon.log_mass[symbol[in_bucket] - first]
        return symbol.astype(np.int16), (c > 0).astype(np.int64), c >= 0, log_c, tail, h

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of the texts, and the places of their tokens in ``known``, one text after the other, each with its end."""
        if len(self.numbers) > READ_AT_ONCE:
            self._forget()
        places, before = [], len(self.numbers)
        for text in texts:
            own = words(text)
            own.append(None)
            places.append(np.fromiter(map(self.numbers.__getitem__, own), np.int32, len(own)))
        new = self.lexicon.read(list(islice(self.numbers, before, None)))
        self.known = tuple(np.concatenate([a, b[:-1]]) for a, b in zip(self.known, self._of(new)))
        return np.fromiter(map(len, places), np.int64, len(places)), np.concatenate(places)


def read_lexicon(counts: DataFrame) -> Lexicon:
    sums = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = int(sums["n"] or 0), int(sums["v"])
    tail = {r["bucket"]: float(r["m"]) for r in counts.groupBy("bucket").agg(F.sum(F.col("c") + 1).alias("m")).collect()}
    least = max(1, -(-total // HOT_WORDS))
    hot = [(r["h"], r["bucket"], r["c"]) for r in counts.where(F.col("c") >= least).collect()]  # at most HOT_WORDS rows
    ends = next((r["c"] for r in counts.where("bucket = -1").collect()), 0)
    return Lexicon(hot, tail, total, distinct, ends)


_READ = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("share", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("tail", pa.float64()), ("symbols", pa.binary()), ("rare", pa.map_(pa.int64(), pa.int64()))])
_READ_DDL = "row long, doc_id long, held_out boolean, share long, n_tokens long, n_known long, logs double, tail double, symbols binary, rare map<long,long>"


def symbols_of(rows: DataFrame, lexicon) -> DataFrame:
    """One row per row of ``rows`` (doc_id, text, held_out, share): its symbols as 16-bit integers, and of its tokens: the
    number, that of known frequent ones, the sum of log10(count + 1) of frequent ones, the log10 factor of the model's
    probability that the frequent ones' shares of buckets make, and the times of the others by hash."""

    def read(batches):
        row, reader = TaskContext.get().partitionId() << 32, Reader(lexicon.value)
        for b in slices(batches):
            n = b.num_rows
            size, at = reader.read(b.column(1).to_pylist())
            symbol, known, frequent, log_c, tail, h = reader.known
            starts = np.concatenate([[0], np.cumsum(size)])
            held, sums = symbol[at].tobytes(), lambda x: np.add.reduceat(x[at], starts[:-1], dtype=x.dtype)
            rare = np.flatnonzero(~frequent[at])
            owners, hashes = np.repeat(np.arange(n), size)[rare], h[at[rare]].view(np.int64)
            order = np.lexsort((hashes, owners))
            owners, hashes = owners[order], hashes[order]
            firsts = np.flatnonzero(np.concatenate([[True], (owners[1:] != owners[:-1]) | (hashes[1:] != hashes[:-1])])[: len(owners)])
            times = np.diff(firsts, append=len(owners))
            columns = (
                row + np.arange(n), b.column(0), b.column(2), b.column(3), size, sums(known), sums(log_c), sums(tail), [held[2 * i : 2 * j] for i, j in zip(starts, starts[1:])],
                pa.MapArray.from_arrays(np.searchsorted(owners[firsts], np.arange(n + 1)).astype(np.int32), hashes[firsts], times),
            )
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, _READ)], schema=_READ)
            row += n

    return rows.select("doc_id", "text", "held_out", "share").mapInArrow(read, _READ_DDL)


def _symbols(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int16) for x in column.to_pylist()]


def _trained_by_all(symbols: DataFrame, net: Network, rate: float, repeats: int) -> Network:
    """The mean of the networks that the partitions of ``symbols`` make of ``net``, weighted by their symbols; the mean
    loss of a symbol before its update is added to ``losses``."""
    before = symbols.sparkSession.sparkContext.broadcast(net)

    def learn(batches):
        own, done, loss = copy.deepcopy(before.value), 0, 0.0
        adam, targets, inputs, held = Adam(own), [], [], 0
        for b in slices(batches):
            for y in _symbols(b.column(0)):
                y = y.astype(np.int32)
                targets.append(y)
                inputs.append(np.concatenate([[own.start], y[:-1]]).astype(np.int32))
                held += len(y)
                while held >= SYMBOLS_AT_ONCE:
                    y, x = np.concatenate(targets), np.concatenate(inputs)
                    for _ in range(repeats):
                        loss += train_through(adam, y[:SYMBOLS_AT_ONCE], x[:SYMBOLS_AT_ONCE], rate)
                    targets, inputs = [y[SYMBOLS_AT_ONCE:]], [x[SYMBOLS_AT_ONCE:]]
                    held, done = held - SYMBOLS_AT_ONCE, done + SYMBOLS_AT_ONCE
        if held:
            y, x = np.concatenate(targets), np.concatenate(inputs)
            for _ in range(repeats):
                loss += train_through(adam, y, x, rate)
        if done + held:
            flat, part = np.concatenate([p.ravel() for p in own.params]), TaskContext.get().partitionId()
            pieces = [flat[i : i + WEIGHTS_AT_ONCE].tobytes() for i in range(0, len(flat), WEIGHTS_AT_ONCE)]
            m = len(pieces)
            yield pa.RecordBatch.from_pydict({"piece": pa.array(range(m), pa.int32()), "part": pa.array([part] * m, pa.int32()), "n": pa.array([done + held] * m, pa.int64()), "loss": pa.array([loss / repeats] * m, pa.float64()), "weights": pa.array(pieces, pa.binary())})

    def mean(pdf):
        pdf = pdf.sort_values("part")
        total = sum(np.frombuffer(w, np.float32).astype(np.float64) * n for w, n in zip(pdf["weights"], pdf["n"]))
        n = pdf["n"].sum()
        return pd.DataFrame({"piece": [pdf["piece"].iloc[0]], "part": [pdf["part"].iloc[0]], "n": [n], "loss": [pdf["loss"].sum()], "weights": [(total / n).astype(np.float32).tobytes()]})

    ddl = "piece int, part int, n long, loss double, weights binary"
    grouped = symbols.mapInArrow(learn, ddl).groupBy("piece", F.pmod("part", F.lit(GROUPS))).applyInPandas(mean, ddl)
    rows = sorted(grouped.groupBy("piece").applyInPandas(mean, ddl).collect(), key=lambda r: r["piece"])  # one network
    if not rows:
        return net
    flat, out, at = np.frombuffer(b"".join(r["weights"] for r in rows), np.float32), copy.deepcopy(net), 0
    for p in out.params:
        p[...] = flat[at : at + p.size].reshape(p.shape)
        at += p.size
    out.losses.append(rows[0]["loss"] / rows[0]["n"])
    return out


def scores(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words and one end a text, so that null and empty texts have one token. Rows whose doc_id's checksum is 2
    modulo 7 are held out; a null doc_id isn't. Without training documents every word is unseen. Repeated rows count
    as often as they occur and score alike. An empty table gives no rows; other columns aren't read.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    counts = stored(word_counts(texts.where("not held_out").select("text")), "word-counts")
    lexicon = read_lexicon(counts)
    total, distinct = lexicon.total, lexicon.distinct
    passes = -(-LEAST_SYMBOLS // max(total, 1)) if total else 0
    shares = max(1, ROUNDS // max(passes, 1))
    repeats = -(-max(passes, 1) * shares // ROUNDS)
    context = docs.sparkSession.sparkContext
    share = F.when(F.col("held_out"), -1).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(shares))).cast("long")
    rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out", share.alias("share"))
    seen = stored(symbols_of(rows, context.broadcast(lexicon)), "lm-symbols")
    net = Network.fresh(lexicon.counts, HIDDEN)
    for k in range(ROUNDS if total else 0):
        net = _trained_by_all(seen.where(F.col("share") == k % shares).select("symbols"), net, RATE * (1 - 0.9 * k / ROUNDS), repeats)
    shared = context.broadcast(net)

    def score(batches):
        # a whole batch at a time, so that long texts are scored side by side
        for b in batches:
            model = shared.value.score(_symbols(b.column(len(_SCORED) - 1))) / np.log(10) + b.column(len(_SCORED) - 2).to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(model)], names=[*_SCORED[:-2], "model"])

    ddl = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, model double"
    per_row = stored(seen.select(*_SCORED).mapInArrow(score, ddl), "lm-rows")
    # in training rows no such word is frequent, so those need no buckets against hot keys
    rare_of = lambda held: seen.where(F.col("held_out") == held).select("row", F.explode("rare").alias("h", "times"))
    rare = rare_of(False).join(counts.select("h", "c"), "h").unionByName(spread_join(rare_of(True), counts.select("h", "c"), "h", ["row"], buckets=16))
    more = rare.groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + F.lit(1.0))).alias("log_c"))
    both = per_row.join(more, "row", "left").withColumn("log_c", F.coalesce("log_c", F.lit(0.0)))
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("log_c") - F.col("n_tokens") * float(np.log10(total + distinct + 1))).alias("base_score"), (F.col("model") + F.col("log_c")).alias("score"),
    )


_SCORED = ["row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "tail", "symbols"]
