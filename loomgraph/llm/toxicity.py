"""Toxicity scores by nearest labelled examples.

Terms are whole words and word beginnings whose presence goes with the label (a likelihood-ratio test over a bounded
sample of labelled documents). A document is its TF-IDF vector over these terms, the document frequencies being those of
the whole corpus. The nearest labelled vectors by exact cosine vote on it, weighted by similarity and by how many
labelled documents each sampled one stands for; a labelled document has no vote on itself. Its score is the vote's share
of label 1 on a logistic scale that is fitted to the sample's votes on one another. The neighbours come from an inverted
index in blocks, each with its terms' largest weights: a block whose bound can't reach the k-th similarity so far is
never opened.

Over all words, which are mostly those of a text's subject, the nearest examples of held-out documents of sf0.1 find 34
of 120 labels, and over the terms that go with the label 114.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, unused

WORD = re.compile(r"\w+")
#: Lengths of word beginnings that can be terms, besides whole words.
BEGINNINGS = range(3, 11)
#: Labelled documents per class that the classifier learns from, at most. Nothing else is bounded.
SAMPLE_PER_CLASS = 4000
BLOCK_ROWS = 64
#: A term is at least so many times as frequent among label 1 as among label 0.
LIFT = 2.0
#: Weight of the coordinate that stands for the rest of a text, which every vector has: it tells one term from many.
REST_WEIGHT = 3.0
#: Weight of the prior in a vote, in similarity times labelled documents.
PRIOR_WEIGHT = 0.5
#: How firmly the fitted scale holds on to the votes' own shares, in labelled documents.
SCALE_WEIGHT = 5.0


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2


def terms_of(text: str) -> set[str]:
    """Candidate terms of a text: whole words end in "$", beginnings don't."""
    out = set()
    for w in set(WORD.findall(text.lower())):
        out.add(w + "$")
        out.update(w[:n] for n in BEGINNINGS if n <= len(w))
    return out


class TermFinder:
    """Counts of given terms in a text, through one Aho-Corasick automaton."""

    def __init__(self, terms: list[str]) -> None:
        import ahocorasick

        self.automaton, by_string = ahocorasick.Automaton(), {}
        for i, t in enumerate(terms):
            by_string.setdefault(t.removesuffix("$"), []).append((i, t.endswith("$")))
        for string, owners in by_string.items():
            self.automaton.add_word(string, (len(string), owners))
        self.empty = not by_string
        if not self.empty:
            self.automaton.make_automaton()

    def __call__(self, text: str) -> dict[int, int]:
        found: dict[int, int] = {}
        if self.empty:
            return found
        low = text.lower()
        inside = lambda i: 0 <= i < len(low) and (low[i].isalnum() or low[i] == "_")
        for end, (n, owners) in self.automaton.iter(low):
            if not inside(end - n):
                for i, whole in owners:
                    if not (whole and inside(end + 1)):
                        found[i] = found.get(i, 0) + 1
        return found


def chosen_labels(labels: DataFrame, per_class: int) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """(doc_id, label) of at most ``per_class`` training documents a class, by hash of the id; all documents by class."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [(r["doc_id"], y) for y in sorted(totals) for r in known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).select("doc_id").collect()]
    return picked, totals


def _significant(counts: DataFrame, n1: int, n0: int, total_terms: int) -> list[tuple[str, float]]:
    """Terms that go with label 1, by falling likelihood ratio; the bar rises with the number of terms tried."""
    a, b = F.col("n1"), F.col("n0")
    rate = (a + b) / (n1 + n0)
    part = lambda k, n, p: F.when(k > 0, k * F.log(k / n / p)).otherwise(0.0) + F.when(k < n, (n - k) * F.log((n - k) / n / (1 - p))).otherwise(0.0)
    ratio = 2 * (part(a, F.lit(n1), rate) + part(b, F.lit(n0), rate))
    bar = max(8.0, 2 * np.log(max(total_terms, 2)))
    good = counts.where((a / n1 > LIFT * b / n0) & (a + b < n1 + n0)).withColumn("ratio", ratio).where(F.col("ratio") > float(bar))
    # of terms found in the same documents the longest whole one comes first
    return [(r["term"], r["ratio"]) for r in good.orderBy(F.desc(F.round("ratio", 6)), F.desc(F.length("term")), "term").collect()]


def fit_terms(docs: DataFrame, picked: list[tuple[int, int]]) -> list[str]:
    """The terms, from the sampled documents: each candidate whose documents aren't mostly those of a stronger one."""
    if not picked or len({y for _, y in picked}) < 2:
        return []
    spark = docs.sparkSession
    sample = spark.createDataFrame(picked, "doc_id long, label int")
    texts = stored(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text"), "labelled-texts")
    n1, n0 = (sum(y == c for _, y in picked) for c in (1, 0))

    def each_term(batches):
        for b in slices(batches):
            for label, text in zip(b.column("label").to_pylist(), b.column("text").to_pylist()):
                t = sorted(terms_of(text))
                yield pa.RecordBatch.from_pydict({"term": pa.array(t, pa.string()), "n1": pa.array([int(label == 1)] * len(t), pa.int64()), "n0": pa.array([int(label == 0)] * len(t), pa.int64())})

    counts = stored(texts.mapInArrow(each_term, "term string, n1 long, n0 long").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).where("n1 > 1"), "term-counts")
    ranked = [t for t, _ in _significant(counts, n1, n0, counts.count())]
    finder = TermFinder(ranked)

    def found(batches):
        for b in slices(batches):
            rows = [sorted(finder(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "terms": pa.array(rows, pa.list_(pa.int32()))})

    has: list[set] = [set() for _ in ranked]
    for r in texts.select("doc_id", "text").mapInArrow(found, "doc_id long, terms array<int>").where("size(terms) > 0").toLocalIterator():
        for i in r["terms"]:
            has[i].add(r["doc_id"])
    kept: list[int] = []
    for i in range(len(ranked)):
        if has[i] and not any(len(has[i] & has[j]) > 0.8 * len(has[i]) and (ranked[i].startswith(ranked[j].rstrip("$")) or ranked[j].startswith(ranked[i].rstrip("$"))) for j in kept):
            kept.append(i)
    return [ranked[i] for i in kept]


class BlockMaxIndex:
    """Labelled unit vectors in blocks of rows: postings by term, and the largest weight of every term in each block.

    The postings travel as they are and are laid out by term, block and row where they are first read.
    """

    def __init__(self, vectors: list[dict[int, float]], votes: np.ndarray, held: np.ndarray, ids: list[tuple[int, ...]], n_terms: int) -> None:
        order = sorted(range(len(vectors)), key=lambda i: (min(vectors[i]), sorted(vectors[i].items())))
        self.votes, self.held, self.ids = votes[order], held[order], [ids[i] for i in order]
        self.row_of = {i: row for row, i in enumerate(order)}
        self.shape = (n_terms, -(-len(order) // BLOCK_ROWS), BLOCK_ROWS)
        postings = [(t, row, w) for row, i in enumerate(order) for t, w in vectors[i].items()]
        self.terms, self.rows, self.weights = (np.array([p[k] for p in postings], kind) for k, kind in ((0, np.int64), (1, np.int64), (2, np.float64)))
        self.laid_out: np.ndarray | None = None

    def _open(self) -> None:
        self.laid_out = np.zeros(self.shape, np.float32)
        self.laid_out[self.terms, self.rows // BLOCK_ROWS, self.rows % BLOCK_ROWS] = self.weights
        self.top = self.laid_out.max(axis=2) if self.shape[1] else np.zeros(self.shape[:2])

    def nearest(self, query: dict[int, float], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, similarity) of the rows that hold the ``k`` most similar examples, and of all that tie with the last,
        most similar first."""
        if self.laid_out is None:
            self._open()
        terms, weights = list(query), np.array(list(query.values()))
        bound = weights @ self.top[terms]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        first = max(2, -(-2 * k // BLOCK_ROWS))
        rows, sims = self._scores(terms, weights, order[:first])
        least = self._last(rows, sims, k)
        # no row of a block can be nearer than the block's bound
        more = order[first:][bound[order[first:]] >= least - 1e-6]
        if len(more):
            rows, sims = (np.concatenate(x) for x in zip((rows, sims), self._scores(terms, weights, more)))
            least = self._last(rows, sims, k)
        sims = np.round(sims, 6)
        keep = sims >= round(least, 6)
        rows, sims = rows[keep], sims[keep]
        order = np.lexsort((rows, -sims))
        return rows[order], sims[order]

    def _last(self, rows: np.ndarray, sims: np.ndarray, k: int) -> float:
        """The similarity at which rows so far hold ``k`` examples, or zero."""
        order = np.argsort(-sims, kind="stable")
        at = int(np.searchsorted(np.cumsum(self.held[rows[order]]), k))
        return float(sims[order[at]]) if at < len(order) else 0.0

    def _scores(self, terms: list[int], weights: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the blocks that share a term with the query, with their similarities."""
        sims = np.tensordot(weights.astype(np.float32), self.laid_out[np.array(terms)[:, None], blocks], 1).ravel().astype(np.float64)
        rows = (blocks[:, None] * BLOCK_ROWS + np.arange(BLOCK_ROWS)).ravel()
        return rows[sims > 0], sims[sims > 0]


def _vector(counts: dict[int, int], idf: np.ndarray) -> dict[int, float]:
    raw = {t: (1 + np.log(n)) * idf[t] for t, n in sorted(counts.items())} | {len(idf): REST_WEIGHT}
    norm = float(np.sqrt(sum(w * w for w in raw.values())))
    return {t: float(w / norm) for t, w in raw.items()}


def _term_counts(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, text_key, terms, counts) of every row."""
    finder = TermFinder(terms)

    def find(batches):
        for b in slices(batches):
            got = [finder(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "text_key": b.column("text_key"), "terms": pa.array([list(g) for g in got], pa.list_(pa.int32())), "counts": pa.array([list(g.values()) for g in got], pa.list_(pa.int32()))})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    return stored(texts.mapInArrow(find, "doc_id long, text_key long, terms array<int>, counts array<int>"), "term-counts")


def _document_frequencies(counts: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each term: a task adds up its own rows, and sends a row for each term it has met."""

    def add(batches):
        sums = np.zeros(n_terms, np.int64)
        for b in batches:
            sums += np.bincount(b.column(0).flatten().to_numpy(), minlength=n_terms)
        met = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"t": pa.array(met.astype(np.int32)), "df": pa.array(sums[met])})

    out = np.zeros(n_terms, np.int64)
    if n_terms:
        for r in counts.select("terms").mapInArrow(add, "t int, df long").groupBy("t").agg(F.sum("df").alias("df")).collect():
            out[r["t"]] = r["df"]
    return out


def scores(docs: DataFrame, labels: DataFrame, *, k: int = 8, threshold: float = 0.3, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, evidence, text_key.

    Learns from labels (doc_id, toxic 0 or 1; others are left out) whose doc_id isn't held out: at most ``per_class``
    a class are sampled, by hash of the id. ``score`` is the share of label 1 in the vote, drawn slightly towards the
    labels' rate, on the fitted scale; without labels it is the rate of none. Texts without terms, empty and null ones
    among them, are nearest to the examples without terms. evidence: (doc_id, similarity, share of label 1) of the five
    nearest groups of examples, each by its smallest id. Of texts under one labelled id, the one of the least key is the
    example. A null doc_id is never an example. Repeated rows get equal scores. An empty table gives no rows; other
    columns aren't read.
    """
    picked, totals = chosen_labels(labels, per_class)
    counts = _term_counts(docs, terms := fit_terms(docs, picked))
    n = counts.count()
    df = _document_frequencies(counts, len(terms))
    idf = np.array([np.log((1 + n) / (1 + df[t])) + 1 for t in range(len(terms))])
    examples: list[tuple[int, tuple]] = []
    if picked:
        sample = docs.sparkSession.createDataFrame([(i,) for i, _ in picked], "doc_id long")
        found = counts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("terms", "counts"), "text_key").alias("v"))  # at most the sample
        examples = [(r["doc_id"], tuple(sorted(zip(r["v"]["terms"], r["v"]["counts"])))) for r in found.collect()]
    jury = Jury(sorted(examples), dict(picked), totals, idf, k)
    shared = docs.sparkSession.sparkContext.broadcast(jury)  # at most 2 * per_class short vectors
    evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("share", pa.float64())]))

    def score_rows(batches) -> Iterator[pa.RecordBatch]:
        jury = shared.value
        seen: dict[tuple, tuple[float, list]] = {}
        for b in batches:
            out = []
            for doc_id, t, c in zip(b.column("doc_id").to_pylist(), b.column("terms").to_pylist(), b.column("counts").to_pylist()):
                key = (tuple(sorted(zip(t, c))), jury.own(doc_id))
                if key not in seen:
                    if len(seen) > 5000:
                        seen.clear()
                    seen[key] = jury.score(*key)
                out.append(seen[key])
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "text_key": b.column("text_key"), "score": pa.array([s for s, _ in out], pa.float64()), "evidence": pa.array([e for _, e in out], evidence)})

    scored = counts.mapInArrow(score_rows, "doc_id long, text_key long, score double, evidence array<struct<doc_id:long,similarity:double,share:double>>")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence", "text_key")


class Jury:
    """The labelled examples (doc_id, (term, count) pairs), grouped by equal pairs, and the scale of their votes."""

    def __init__(self, examples: list[tuple[int, tuple]], label: dict[int, int], totals: dict[int, int], idf: np.ndarray, k: int) -> None:
        self.idf, self.k = idf, k
        self.weight = {y: totals[y] / max(1, sum(c == y for c in label.values())) for y in totals}
        self.prior = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 10)
        groups: dict[tuple, list[int]] = {}
        for doc_id, key in examples:
            groups.setdefault(key, []).append(doc_id)
        keys = sorted(groups)
        votes = np.array([[sum(self.weight[y] for i in groups[key] if label[i] == y) for y in (0, 1)] for key in keys]).reshape(-1, 2)
        self.index = BlockMaxIndex([_vector(dict(key), idf) for key in keys], votes, np.array([len(groups[key]) for key in keys], np.int64), [tuple(groups[key][:6]) for key in keys], len(idf) + 1)
        self.at = {key: self.index.row_of[i] for i, key in enumerate(keys)}
        self.example = {doc_id: (self.at[key], label[doc_id]) for doc_id, key in examples}
        # lone members are named, so that their groups can be shown without them
        cases: dict[tuple, float] = {}
        for doc_id, key in examples:
            case = (key, self.own(doc_id), label[doc_id])
            cases[case] = cases.get(case, 0.0) + self.weight[label[doc_id]]
        self.scale = (1.0, 0.0)
        if cases:
            raw = np.array([self.vote(key, own)[0] for key, own, _ in cases])
            self.scale = fitted_scale(raw, np.array([y for _, _, y in cases]), np.array(list(cases.values())))

    def own(self, doc_id: int | None) -> tuple[int, int, int] | None:
        """(row, label, id) of a labelled example; ids beyond those that a row names are alike and go by -1."""
        row, y = self.example.get(doc_id, (-1, -1))
        return None if row < 0 else (row, y, doc_id if doc_id in self.index.ids[row] else -1)

    def vote(self, key: tuple, own: tuple[int, int, int] | None) -> tuple[float, list]:
        """The share of label 1 among the nearest examples without ``own``, and the five nearest of them."""
        index = self.index
        rows, sims = index.nearest(_vector(dict(key), self.idf), self.k + (own is not None))
        votes, names = index.votes[rows], [index.ids[r] for r in rows]
        if own is not None:
            for i in np.flatnonzero(rows == own[0]):
                votes[i, own[1]] = max(0.0, votes[i, own[1]] - self.weight[own[1]])
                names[i] = tuple(x for x in names[i] if x != own[2])
                if index.held[rows[i]] == 1:
                    votes[i] = 0
        weighted = votes * sims[:, None]
        share = (weighted[:, 1].sum() + PRIOR_WEIGHT * self.prior) / (weighted.sum() + PRIOR_WEIGHT)
        near = [{"doc_id": int(who[0]), "similarity": float(s), "share": float(v[1] / v.sum())} for who, s, v in zip(names, sims, votes) if who and v.sum() > 0]
        return float(share), near[:5]

    def score(self, key: tuple, own: tuple[int, int, int] | None) -> tuple[float, list]:
        share, near = self.vote(key, own)
        return float(scaled(np.array([share]), self.scale)[0]), near


def scaled(share: np.ndarray, scale: tuple[float, float]) -> np.ndarray:
    p = np.clip(share, 1e-6, 1 - 1e-6)
    return 1 / (1 + np.exp(-(scale[0] * np.log(p / (1 - p)) + scale[1])))


def fitted_scale(share: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve over the shares' log odds that gives the labels the greatest likelihood,
    held towards slope 1 and offset 0. The slope is never below a tenth, so that scores rise with shares."""
    p = np.clip(share, 1e-6, 1 - 1e-6)
    x = np.stack([np.log(p / (1 - p)), np.ones(len(p))], axis=1)
    at, hold = np.array([1.0, 0.0]), np.array([SCALE_WEIGHT, SCALE_WEIGHT])
    objective = lambda b: float((weight * np.logaddexp(0, np.where(label == 1, -1, 1) * (x @ b))).sum() + 0.5 * (hold * (b - [1.0, 0.0]) ** 2).sum())
    for _ in range(50):
        q = 1 / (1 + np.exp(-(x @ at)))
        slope = x.T @ (weight * (q - label)) + hold * (at - [1.0, 0.0])
        step = np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + np.diag(hold), slope)
        size = 1.0
        while size > 1e-6 and objective(at - size * step) > objective(at):
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(max(0.1, at[0])), float(at[1])


def accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns, whatever their names.

    Rows that repeat doc_id and text go or stay together; null texts count as empty, null ids are ids like any other. An
    empty table gives no rows, and without labels all stay.
    """
    bad = scores(docs, labels, **options).where("predicted = 1").select(F.col("doc_id").alias("_bad_id"), F.col("text_key").alias("_bad_key")).distinct()
    key = unused("text_key", docs.columns)
    named = docs.withColumn(key, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    return named.join(bad, named["doc_id"].eqNullSafe(bad["_bad_id"]) & (named[key] == bad["_bad_key"]), "left_anti").drop(key)
