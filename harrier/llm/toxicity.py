"""Toxicity by a classifier chain.

The categories are predicted one after the other; each linear (logistic) model sees the words of a document and the
probabilities that the earlier models gave it. In training those are out-of-fold predictions (vocabulary included), so a model
learns from probabilities as honest as the ones it will get; copies of a text are in one fold. The last category is the label
column ``toxic`` itself. Earlier categories are label columns of the table if their names are given; otherwise they have weak
labels: a document has them if it is labelled toxic and holds a word of the category's list.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import tokens
from .common import batch_of, binary, lean, without
from .tokens import U64

#: Word lists that give the weak labels of the earlier categories, in chain order.
CATEGORIES: dict[str, tuple[str, ...]] = {
    "insult": ("idiot", "moron", "clown", "loser", "fool", "imbecile", "jerk", "dummkopf", "imbécile", "estúpido"),
    "demeaning": ("stupid", "worthless", "pathetic", "disgusting", "useless", "ugly", "dumm", "inútil", "dégoûtant"),
    "dehumanising": ("trash", "scum", "vermin", "filth", "garbage", "abschaum", "basura", "ordure"),
}
#: Labelled rows of each class that the chain is fitted on at most: a bounded sample by hash of doc_id, weighted to the classes' true ratio.
TRAIN_ROWS_PER_CLASS = 5000
FOLDS = 5
REJECT_AT = 0.5


@dataclass
class Presence:
    """Which rows hold which words of a vocabulary: each (row, place) once, by row. Only what is there takes memory."""

    row: np.ndarray
    place: np.ndarray
    rows: int
    words: int

    def dot(self, v: np.ndarray) -> np.ndarray:
        """By row, the sum over its words."""
        return np.bincount(self.row, v[self.place], self.rows)

    def back(self, v: np.ndarray) -> np.ndarray:
        """By word, the sum over its rows."""
        return np.bincount(self.place, v[self.row], self.words)

    def where(self, keep: np.ndarray) -> Presence:
        held = keep[self.row]
        return Presence((np.cumsum(keep) - 1)[self.row[held]], self.place[held], int(keep.sum()), self.words)


@dataclass
class Chain:
    """Word hashes (ascending) and, per category, weights of the words, of the earlier probabilities, and the intercept."""

    names: list[str]
    words: np.ndarray
    weights: list[np.ndarray]
    chained: list[np.ndarray]
    intercepts: list[float]

    def probabilities(self, x: Presence) -> np.ndarray:
        out = np.zeros((x.rows, len(self.names)))
        for k in range(len(self.names)):
            out[:, k] = _sigmoid(x.dot(self.weights[k]) + out[:, :k] @ self.chained[k] + self.intercepts[k])
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logistic(x: Presence, more: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1.0, steps: int = 25) -> tuple[np.ndarray, np.ndarray, float]:
    """Ridge-penalised logistic regression of weighted rows on words and ``more`` columns: their weights and the intercept.

    Newton's method with steps by preconditioned conjugate gradients, so any number of words will do; with one class only, its
    smoothed rate.
    """
    n, d, k = x.rows, x.words, more.shape[1]
    rate = (weight @ y + 0.5) / (weight.sum() + 2)  # under a half without any rows
    beta = np.r_[np.zeros(d + k), np.log(rate / (1 - rate))]
    if not 0 < y.sum() < n:
        return beta[:d], beta[d:-1], float(beta[-1])
    penalty = np.r_[np.full(d + k, l2), 1e-3]

    def along(v: np.ndarray) -> np.ndarray:
        return x.dot(v[:d]) + more @ v[d:-1] + v[-1]

    def back(r: np.ndarray) -> np.ndarray:
        return np.r_[x.back(r), more.T @ r, r.sum()]

    def loss(v: np.ndarray) -> float:
        m = along(v)
        return float(weight @ (np.logaddexp(0, m) - y * m) + (penalty * v * v).sum() / 2)

    now = loss(beta)
    for _ in range(steps):
        p = _sigmoid(along(beta))
        h = weight * p * (1 - p)
        rest = back(weight * (y - p)) - penalty * beta
        scale = 1 / (np.r_[x.back(h), (more * more).T @ h, h.sum()] + penalty)
        step, turned = np.zeros(len(beta)), scale * rest
        way, size, enough = turned.copy(), rest @ turned, 1e-12 * (rest @ (scale * rest))
        for _ in range(10 * len(beta)):
            if size <= enough:
                break
            curved = back(h * along(way)) + penalty * way
            far = size / (way @ curved)
            step += far * way
            rest = rest - far * curved
            turned = scale * rest
            size, before = rest @ turned, size
            way = turned + size / before * way
        while (after := loss(beta + step)) > now and np.abs(step).max() > 1e-9:
            step /= 2
        beta = beta + step
        if now - after < 1e-7:
            break
        now = after
    return beta[:d], beta[d:-1], float(beta[-1])


def _presence(words: np.ndarray, first: np.ndarray, vocabulary: np.ndarray) -> Presence:
    rows, size = len(first) - 1, len(vocabulary)
    if not size or not len(words):
        return Presence(np.zeros(0, np.int64), np.zeros(0, np.int64), rows, size)
    marked = np.zeros(1 << 16, bool)
    marked[(vocabulary & U64(0xFFFF)).astype(np.int64)] = True
    at = np.flatnonzero(marked[(words & U64(0xFFFF)).astype(np.int64)])
    place = np.minimum(np.searchsorted(vocabulary, words[at]), size - 1)
    hit = vocabulary[place] == words[at]
    held = np.unique((np.searchsorted(first, at[hit], "right") - 1) * size + place[hit])
    return Presence(held // size, held % size, rows, size)


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    import pyarrow.compute as pc

    buf, off = tokens.string_buffers(pc.utf8_lower(column.cast(pa.large_string())))
    for lo, hi in tokens.chunks(off):
        own, at = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        starts, ends, first = tokens.word_runs(own, at)
        yield lo, hi, tokens.word_hashes(own, starts, ends), first


def outcomes(labels: DataFrame, categories: Sequence[str] = ()) -> DataFrame:
    """(doc_id, toxic, and the label columns ``categories``): one row per labelled document; a category's null is no."""
    more = [F.coalesce((F.max(F.col(f"`{c}`").cast("int")) > 0).cast("int"), F.lit(0)).alias(f"y{k}") for k, c in enumerate(categories)]
    return labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"), *more)


def training_sample(docs: DataFrame, labels: DataFrame, rows: int, categories: Sequence[str] = ()) -> DataFrame:
    """(doc_id, toxic, y0, y1, ..., words): the distinct word hashes of at most ``rows`` labelled documents of each class, chosen by hash."""
    own = outcomes(labels, categories)
    rank = F.xxhash64(F.lit("toxicity"), "doc_id")
    picked = own.where("toxic = 1").orderBy(rank, "doc_id").limit(rows).unionByName(own.where("toxic = 0").orderBy(rank, "doc_id").limit(rows))

    names = ["doc_id", "toxic", *(f"y{k}" for k in range(len(categories)))]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words, first in _words(batch.column("text")):
                yield batch_of(
                    **{c: batch.column(c).slice(lo, hi - lo) for c in names},
                    words=binary(np.unique(words[a:b]).tobytes() for a, b in zip(first[:-1], first[1:])),
                )

    # the sample has 2 * rows ids at most, whatever the corpus
    return docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(picked), "doc_id").select(*names, "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} int" for c in names[1:]) + ", words binary")


def marking_words(flat: np.ndarray, counts: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All words (ascending) that mark toxic rows by their likelihood ratio."""
    positive, negative = (np.unique(flat[np.repeat(y == k, counts)], return_counts=True) for k in (1, 0))
    n1, n0 = max(y.sum(), 1), max(len(y) - y.sum(), 1)
    other = np.zeros(len(positive[0]))
    if len(negative[0]):
        at = np.minimum(np.searchsorted(negative[0], positive[0]), len(negative[0]) - 1)
        other = np.where(negative[0][at] == positive[0], negative[1][at], 0)
    a, b = positive[1] / n1, other / n0
    gain = np.where((positive[1] >= 3) & (a > 2 * b), positive[1] * np.log((a + 1e-9) / (b + 0.5 / n0)), 0)
    return positive[0][gain > 8]


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = TRAIN_ROWS_PER_CLASS, folds: int = FOLDS, categories: Sequence[str] = ()) -> Chain:
    """Fits the chain on the driver, on ``training_sample``. ``categories`` are label columns that come before ``toxic`` in the chain; without any, the weak ones of ``CATEGORIES`` do.

    Words count as features if they mark toxic documents: at least 3 of them, twice as often as clean ones, and a gain of over
    8 nats; all that do are kept. A class that the sample cuts is weighted by the inverse of its sampling rate, so
    probabilities do not depend on the cut. The probabilities that later models learn from were predicted for documents that
    neither the vocabulary nor the earlier models have seen.
    """
    sample = training_sample(docs, labels, rows_per_class, categories).toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    names = [*(categories or CATEGORIES), "toxic"]
    y = sample["toxic"].to_numpy().astype(float)
    per_row = [np.frombuffer(x.as_buffer(), U64) for x in sample["words"]]
    counts = np.array([len(x) for x in per_row], np.int64)
    flat = np.concatenate(per_row) if per_row else np.zeros(0, U64)
    first = np.r_[0, np.cumsum(counts)]
    # two rows: all labelled documents of each class
    total = {r.toxic: r["count"] for r in outcomes(labels).groupBy("toxic").count().collect()}
    over = [max(total.get(k, 0) / max(rows_per_class, 1), 1.0) for k in (0, 1)]
    weight = np.where(y == 1, over[1], over[0])
    if categories:
        targets = [sample[f"y{k}"].to_numpy().astype(float) for k in range(len(categories))] + [y]
    else:
        lists = [np.array(sorted(tokens.hash_word(w) for w in words), U64) for words in CATEGORIES.values()]
        targets = [y * (_presence(flat, first, own).dot(np.ones(len(own))) > 0) for own in lists] + [y]
    # by words, so that copies are together; dealt in the order of their hashes, so that folds are alike in size
    kind = np.array([int(np.bitwise_xor.reduce(tokens.mix(x.copy()))) if len(x) else 0 for x in per_row], U64)
    fold = np.unique(kind, return_inverse=True)[1] % folds
    held = []
    for f in range(folds):
        train = fold != f
        held.append((train, _presence(flat, first, marking_words(flat[np.repeat(train, counts)], counts[train], y[train]))))
    vocabulary = marking_words(flat, counts, y)
    x = _presence(flat, first, vocabulary)
    honest = np.zeros((len(y), len(names)))
    chain = Chain(names, vocabulary, [], [], [])
    for k, target in enumerate(targets):
        for train, own in held:
            w, v, c = _logistic(own.where(train), honest[train, :k], target[train], weight[train])
            honest[~train, k] = _sigmoid(own.where(~train).dot(w) + honest[~train, :k] @ v + c)
        w, v, c = _logistic(x, honest[:, :k], target, weight)
        chain.weights.append(w)
        chain.chained.append(v)
        chain.intercepts.append(c)
    return chain


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """Adds p_<category> for each category and ``toxic`` (p_toxic at or above ``REJECT_AT``) to the documents.

    A null or empty text has no words and gets the chain's intercepts. Input columns of these names are replaced. Every row
    is scored on its own, repeated rows too; doc_id may be null.
    """
    added = [f"p_{x}" for x in chain.names]
    docs = without(docs, [*added, "toxic"])
    model = docs.sparkSession.sparkContext.broadcast(chain)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            p = [np.zeros((0, len(own.names)))] + [own.probabilities(_presence(w, first, own.words)) for _, _, w, first in _words(batch.column("text"))]
            p = np.concatenate(p)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(p[:, -1] >= REJECT_AT)], names=[*batch.schema.names, *added, "toxic"])

    schema = StructType(list(docs.schema.fields))
    for x in added:
        schema = schema.add(x, "double")
    return docs.mapInArrow(run, schema.add("toxic", "boolean"))


def toxicity(docs: DataFrame, labels: DataFrame, rows_per_class: int = TRAIN_ROWS_PER_CLASS, categories: Sequence[str] = ()) -> DataFrame:
    """Fits the chain on the labelled documents and scores all.

    Repeated label rows of a document count once, as toxic if one of them is; label rows with nulls, or of no document, are
    passed over. Without toxic labels (or without any) nothing is toxic. The whole of a long text counts. An empty table gives
    an empty result. doc_id must be a number, or text that reads as one, or null.
    """
    return score(docs, fit(docs, labels, rows_per_class, categories=categories))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not toxic, with the input's columns; see ``toxicity``. Documents without words, and all of them without labels, stay."""
    chain = fit(docs, labels)
    model = docs.sparkSession.sparkContext.broadcast(chain)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [model.value.probabilities(_presence(w, first, model.value.words))[:, -1] for _, _, w, first in _words(batch.column("text"))]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0), *p]) < REJECT_AT))

    return docs.mapInArrow(run, docs.schema)
