"""Hierarchical language identification.

Linear models over hashed character n-grams: one-versus-rest squared-hinge SVMs name the language family, then, inside the
family, one-versus-one SVMs separate its languages by vote. A document's feature vector is the share of each n-gram bucket
among all its n-grams, so a model's score of a document is a mean of per-n-gram weights over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import tokens
from .common import batch_of, binary, lean, without

FAMILIES: dict[str, tuple[str, ...]] = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "ur", "mr", "gu", "pa", "ne"),
}
#: Labelled documents of each language that the models are fitted on, about: a bounded sample by hash of id and text.
TRAIN_ROWS_PER_LANGUAGE = 1000
#: Languages that models are fitted for, the most frequent ones: a bound for a ``lang`` column that holds anything.
MAX_LANGUAGES = 64
BUCKET_BITS = 12
#: Lengths of n-grams, in bytes of the lower-case text.
ORDERS = (2, 3)


@dataclass
class Hierarchy:
    families: list[str]
    languages: dict[str, list[str]]
    weights: np.ndarray  # buckets by models: first the families (one for two), then each family's pairs
    intercepts: np.ndarray
    pairs: list[tuple[str, str, str]]  # family, language of the positive side, language of the negative side

    @property
    def heads(self) -> int:
        return 0 if len(self.families) < 2 else 1 if len(self.families) == 2 else len(self.families)

    def decide(self, scores: np.ndarray) -> tuple[list[str], np.ndarray, list[str], np.ndarray]:
        """Family, its margin over the next, language, and its mean margin over the others of the family."""
        n, heads = len(scores), self.heads
        if heads == 0:
            family, lead = np.zeros(n, np.int64), np.zeros(n)
        elif heads == 1:
            family, lead = (scores[:, 0] < 0).astype(np.int64), np.abs(scores[:, 0])
        else:
            ranked = np.sort(scores[:, :heads], axis=1)
            family, lead = scores[:, :heads].argmax(axis=1), ranked[:, -1] - ranked[:, -2]
        language, margin = [""] * n, np.zeros(n)
        for k, name in enumerate(self.families):
            rows = np.flatnonzero(family == k)
            own = self.languages[name]
            votes, sums = np.zeros((len(rows), len(own))), np.zeros((len(rows), len(own)))
            for j, (f, a, b) in enumerate(self.pairs):
                if f == name:
                    s = scores[rows, heads + j]
                    i, o = own.index(a), own.index(b)
                    votes[:, i] += s >= 0
                    votes[:, o] += s < 0
                    sums[:, i] += s
                    sums[:, o] -= s
            # ties in votes go by summed margins, then by name
            best = np.array([np.lexsort((np.arange(len(own)), -s, -v))[0] for v, s in zip(votes, sums)], np.int64)
            for r, b, s in zip(rows, best, sums):
                language[r] = own[b]
                margin[r] = s[b] / max(len(own) - 1, 1)
        return [self.families[k] for k in family], lead, language, margin


def _buckets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, list[np.ndarray]]]:
    """Per chunk of rows: their range, offsets, and for each order the bucket of the n-gram that starts at each byte (those at a row's end run on into the next and are left out later)."""
    import pyarrow.compute as pc

    buf, off = tokens.string_buffers(pc.utf8_lower(column.cast(pa.large_string())))
    for lo, hi in tokens.chunks(off):
        own, at = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        # digits, punctuation and white space are all one boundary mark
        folded = np.where(tokens._IS_WORD[own] & ~((own >= 48) & (own <= 57)), own, 32).astype(np.uint32)
        padded = np.concatenate([folded, np.zeros(max(ORDERS), np.uint32)])
        out = []
        for n in ORDERS:
            code = padded[: len(own)].copy()
            for k in range(1, n):
                code = code * np.uint32(0x01000193) ^ padded[k : k + len(own)]
            code *= np.uint32(0x9E3779B1)
            out.append((code >> np.uint32(32 - BUCKET_BITS)).astype(np.int32))
        yield lo, hi, at, out


def _counts(at: np.ndarray, n: int) -> np.ndarray:
    return np.maximum(np.diff(at) - n + 1, 0)


def _features(column: pa.Array) -> np.ndarray:
    """Share of each bucket among a row's n-grams."""
    size = 1 << BUCKET_BITS
    x = np.zeros((len(column), size), np.float32)
    for lo, hi, at, orders in _buckets(column):
        for r in range(lo, hi):
            a, b = at[r - lo], at[r - lo + 1]
            for n, codes in zip(ORDERS, orders):
                x[r] += np.bincount(codes[a : max(b - n + 1, a)], minlength=size)
    return x / np.maximum(x.sum(axis=1, keepdims=True), 1)


def _scores(column: pa.Array, weights: np.ndarray, intercepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of all rows, and the number of n-grams of each."""
    out, grams = np.zeros((len(column), len(intercepts))), np.zeros(len(column), np.int64)
    for lo, hi, at, orders in _buckets(column):
        rows = np.flatnonzero(np.diff(at) > 0)
        if not len(rows):
            continue
        begins = at[:-1][rows]
        total = np.zeros((len(rows), len(intercepts)))
        for n, codes in zip(ORDERS, orders):
            for m in range(len(intercepts)):
                total[:, m] += np.add.reduceat(weights[codes, m], begins)
            for k in range(1, n):  # n-grams that would run past the row's end
                late = at[1:][rows] - k
                ok = late >= begins
                total[ok] -= weights[codes[late[ok]]]
            grams[lo + rows] += _counts(at, n)[rows]
        out[lo + rows] = total
    return out / np.maximum(grams, 1)[:, None] + intercepts, grams


def _svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, by accelerated gradient; features are centred and scaled meanwhile."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-4
    z = (x - mean) / scale / np.sqrt(x.shape[1])
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)  # classes count alike
    w, b = np.zeros(z.shape[1], np.float32), np.float32(0)
    pw, pb = w.copy(), b
    rate = np.float32(1 / (1 / c + 2 * float((weight * ((z**2).sum(axis=1) + 1)).sum())))
    for k in range(steps):
        momentum = np.float32(k / (k + 3))
        vw, vb = w + momentum * (w - pw), b + momentum * (b - pb)
        slack = np.maximum(1 - y * (z @ vw + vb), 0) * weight * y
        pw, pb = w, b
        w = vw - rate * (vw / np.float32(c * len(y)) - 2 * (slack @ z))
        b = vb + rate * 2 * slack.sum()
    w = w / scale / np.sqrt(x.shape[1])
    return w, float(b - mean @ w)


def training_sample(docs: DataFrame, rows: int, languages: int = MAX_LANGUAGES) -> DataFrame:
    """(doc_id, lang, features) of about ``rows`` documents of each of the ``languages`` most frequent languages, chosen by hash of id and text; repeated rows count once."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL AND length(text) > 0").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    # one row per language, ``languages`` at most
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    shares = F.broadcast(counts.select(F.col("lang").alias("h_lang"), (F.least(F.lit(1.0), rows / F.col("n")) * (1 << 30)).cast("long").alias("h_share")))
    chosen = labelled.withColumn("h_hash", F.xxhash64(F.lit("langid"), "doc_id", "text")).join(shares, F.col("lang") == F.col("h_lang"))
    chosen = chosen.where(F.pmod("h_hash", F.lit(1 << 30)) < F.col("h_share")).dropDuplicates(["lang", "h_hash"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                yield batch_of(doc_id=part.column("doc_id"), lang=part.column("lang"), features=binary(f.tobytes() for f in _features(part.column("text")).astype(np.float16)))

    return chosen.select("doc_id", "text", "lang").mapInArrow(run, "doc_id long, lang string, features binary")


def fit(docs: DataFrame, rows_per_language: int = TRAIN_ROWS_PER_LANGUAGE, families: Mapping[str, tuple[str, ...]] = FAMILIES) -> Hierarchy:
    """Fits all models on the driver. A language of no listed family is a family of its own."""
    sample = training_sample(docs, rows_per_language).toArrow().sort_by([("lang", "ascending"), ("doc_id", "ascending"), ("features", "ascending")])
    langs = sample["lang"].to_pylist()
    size = 1 << BUCKET_BITS
    x = np.frombuffer(b"".join(v.as_buffer() for v in sample["features"]), np.float16).reshape(-1, size).astype(np.float32)
    home = {lang: family for family, members in families.items() for lang in members}
    family = np.array([home.get(x_, x_) for x_ in langs], object)
    lang = np.array(langs, object)
    names = sorted(set(family))
    members = {f: sorted(set(lang[family == f])) for f in names}
    weights, intercepts, pairs = [], [], []
    if len(names) == 2:
        heads = names[:1]
    else:
        heads = names if len(names) > 2 else []
    for f in heads:
        w, b = _svm(x, np.where(family == f, 1, -1).astype(np.float32))
        weights.append(w)
        intercepts.append(b)
    for f in names:
        for a, b in combinations(members[f], 2):
            rows = (lang == a) | (lang == b)
            w, c = _svm(x[rows], np.where(lang[rows] == a, 1, -1).astype(np.float32))
            weights.append(w)
            intercepts.append(c)
            pairs.append((f, a, b))
    return Hierarchy(names, members, np.stack(weights, 1).astype(np.float32) if weights else np.zeros((size, 0), np.float32), np.array(intercepts, np.float64), pairs)


def identify(docs: DataFrame, model: Hierarchy) -> DataFrame:
    """Adds pred_family, family_margin, pred_lang and lang_margin; input columns of these names are replaced.

    The language is null where there is nothing to tell it by: null and empty texts, texts of one byte, and when no model
    could be fitted for want of labelled documents; margins are 0 then. Every row is judged on its own, repeated ones too.
    """
    names = ["pred_family", "family_margin", "pred_lang", "lang_margin"]
    docs = without(docs, names)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores, grams = _scores(batch.column("text"), own.weights, own.intercepts)
            known = (grams > 0) & bool(own.families)
            if own.families:
                family, lead, lang, margin = own.decide(scores)
            else:
                family, lang, lead, margin = [None] * len(grams), [None] * len(grams), np.zeros(len(grams)), np.zeros(len(grams))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f if k else None for f, k in zip(family, known)], pa.string()), pa.array(np.where(known, lead, 0.0)), pa.array([x if k else None for x, k in zip(lang, known)], pa.string()), pa.array(np.where(known, margin, 0.0))],
                names=[*batch.schema.names, *names],
            )

    added = StructType.fromDDL("pred_family string, family_margin double, pred_lang string, lang_margin double")
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *added.fields]))


def language_id(docs: DataFrame, rows_per_language: int = TRAIN_ROWS_PER_LANGUAGE, families: Mapping[str, tuple[str, ...]] = FAMILIES) -> DataFrame:
    """Fits the models on the documents that name their language in ``lang`` and identifies all.

    Rows with a null ``lang`` or no text are not trained on. The whole of a long text counts. An empty table gives an empty
    result. doc_id must be a number, or text that reads as one, or null; it tells nothing about the language.
    """
    return identify(docs, fit(docs, rows_per_language, families))
