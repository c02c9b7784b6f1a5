"""Benchmark decontamination with a generalised suffix automaton.

The automaton is built over the words of all test items, one string per item, and shipped as flat arrays. A document's words
are streamed through it and the longest match that ends at each word is tracked. Only windows of ``seed`` words that occur in
some item can start or continue a match of that length, so a vectorised look-up of window hashes finds the stretches to stream;
no match of ``seed`` words or more lies outside them. Items of fewer words are looked up as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from . import tokens
from .common import lean, without
from .tokens import U64

#: Words of the shortest match that counts at all.
SEED = 8
#: A match of at least so many words is always removed.
MAX_LENGTH = 13
#: Shorter matches (of ``SEED`` at least) are removed if, together with the document's other matches, they cover so much of an item.
ITEM_COVERAGE = 0.5
#: A document is dropped if so large a share of its words is removed.
DROP_COVERAGE = 0.8
#: Items of fewer words change nothing: any text holds them. From here up to ``SEED`` words, an item is removed where it occurs as a whole.
SHORTEST = 4
#: Words in one automaton, which the driver builds; more test words make more automata.
AUTOMATON_WORDS = 500_000
#: Words in the automata that are sent to the tasks at once, at about 100 bytes a word; more test words take more passes over the documents.
PASS_WORDS = 3_000_000


@dataclass
class Automaton:
    """A generalised suffix automaton over word hashes, as it is built."""

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    starts: list[int] = field(default_factory=lambda: [0])

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, words: list[int]) -> None:
        """Adds one item; its places follow those of the items before."""
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
            else:
                new = self._state(self.length[last] + 1, {}, 0)
                p = last
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][word]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
                last = new
        self.starts.append(self.starts[-1] + len(words))

    def flat(self) -> FlatAutomaton:
        counts = np.array([len(x) for x in self.next], np.int64)
        words = np.fromiter((w for x in self.next for w in sorted(x)), U64, counts.sum())
        targets = np.fromiter((x[w] for x in self.next for w in sorted(x)), np.int32, counts.sum())
        return FlatAutomaton(np.r_[0, np.cumsum(counts)].astype(np.int32 if counts.sum() < 1 << 31 else np.int64), words, targets, np.array(self.link, np.int32), np.array(self.length, np.int32))


@dataclass
class FlatAutomaton:
    """The moves of state s are ``words[first[s]:first[s + 1]]``, ascending, and lead to the states in ``targets``."""

    first: np.ndarray
    words: np.ndarray
    targets: np.ndarray
    link: np.ndarray
    length: np.ndarray

    def move(self, state: int, word: np.uint64) -> int:
        """The state that a word leads to; -1 if there is no such move."""
        lo, hi = int(self.first[state]), int(self.first[state + 1])
        if hi - lo > 8:
            lo += int(np.searchsorted(self.words[lo:hi], word))
            return int(self.targets[lo]) if lo < hi and self.words[lo] == word else -1
        for k in range(lo, hi):
            if self.words[k] == word:
                return int(self.targets[k])
        return -1

    def matches(self, words: np.ndarray, least: int) -> list[tuple[int, int]]:
        """Maximal matches of at least ``least`` words: (first word, number of words)."""
        found = []
        state = length = 0
        for i in range(len(words) + 1):
            before = length
            onward = -1
            if i < len(words):
                while (onward := self.move(state, words[i])) < 0 and state:
                    state = int(self.link[state])
                    length = int(self.length[state])
            if onward >= 0:
                state, length = onward, length + 1
            elif i == len(words):
                length = -1
            if before >= least and length != before + 1:
                found.append((i - before, before))
        return found


@dataclass
class Shard:
    automaton: FlatAutomaton
    windows: np.ndarray  # hashes of all windows of seed words, ascending, as often as they occur
    places: np.ndarray  # where each of them starts in the concatenated items
    starts: np.ndarray  # where each item starts
    marks: np.ndarray  # by the windows' low 16 bits
    short: dict[int, np.ndarray]  # by number of words, the hashes of whole items of fewer words than a window, ascending


def _shards(benchmark: DataFrame, seed: int, most: int, shortest: int = SHORTEST) -> Iterator[tuple[int, Shard]]:
    """Number of words and automata of at most about ``most`` words each; items of fewer words than ``shortest`` add nothing."""
    automaton, windows, places, short, held = Automaton(), [], [], {}, 0

    def shard() -> Shard:
        all_windows, all_places = (np.concatenate(windows), np.concatenate(places)) if windows else (np.zeros(0, U64), np.zeros(0, np.int64))
        order = np.argsort(all_windows, kind="stable")
        all_windows, all_places = all_windows[order], all_places[order]
        marks = np.zeros(1 << 16, bool)
        marks[(all_windows & U64(0xFFFF)).astype(np.int64)] = True
        return Shard(automaton.flat(), all_windows, all_places, np.array(automaton.starts), marks, {n: np.unique(np.array(x, U64)) for n, x in short.items()})

    for row in benchmark.select("text").where("text IS NOT NULL").distinct().orderBy("text").toLocalIterator():
        buf, off = tokens.string_buffers(_lower_rows(pa.array([row.text], pa.large_string()))[0])
        starts, ends, first = tokens.word_runs(buf, off)
        if len(starts) < shortest:
            continue
        words = tokens.word_hashes(buf, starts, ends)
        if held and held + len(words) > most:
            yield held, shard()
            automaton, windows, places, short, held = Automaton(), [], [], {}, 0
        held += len(words)
        if len(words) < seed:
            short.setdefault(len(words), []).append(tokens.gram_hashes(words, first, len(words))[0][0])
            continue
        windows.append(tokens.gram_hashes(words, first, seed)[0])
        places.append(automaton.starts[-1] + np.arange(len(words) - seed + 1))
        automaton.add(words.tolist())
    if held:
        yield held, shard()


def covering(at: np.ndarray, hashes: np.ndarray, shard: Shard, seed: int, item_coverage: float) -> np.ndarray:
    """Of a document's windows (first word, hash) that items hold, those of an item that they cover ``item_coverage`` of.

    A match of ``seed`` words or more with an item is a run of windows, and counts for every item that holds it.
    """
    lo, hi = (np.searchsorted(shard.windows, hashes, side) for side in ("left", "right"))
    counts = hi - lo
    window = np.repeat(np.arange(len(at)), counts)
    place = shard.places[np.arange(counts.sum()) + np.repeat(lo - np.cumsum(counts) + counts, counts)]
    met = np.unique(place)
    # a window lies in one item, so the words it covers end where the next window starts, or with it
    words = np.minimum(np.diff(met, append=met[-1:] + seed), seed)
    items, row = np.unique(np.searchsorted(shard.starts, met, "right") - 1, return_inverse=True)
    whole = np.bincount(row, words) >= item_coverage * (shard.starts[items + 1] - shard.starts[items])
    return np.unique(at[window[whole[row[np.searchsorted(met, place)]]]])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def spans_of(words: np.ndarray, first: np.ndarray, shards: list[Shard], seed: int, max_length: int, item_coverage: float) -> tuple[dict[int, list[tuple[int, int]]], dict[int, int]]:
    """By row, ranges of words to remove (not merged), and the longest match; rows' words begin at ``first``."""
    spans: dict[int, list[tuple[int, int]]] = {}
    longest: dict[int, int] = {}
    counts = np.diff(first)

    def held(hashes: np.ndarray, begin: np.ndarray, known: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Rows with windows of ``n`` words that are known: their first words in the row, and hashes."""
        maybe = np.flatnonzero(known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes)
        row = np.searchsorted(begin, maybe, "right") - 1
        for r in np.unique(row):
            if counts[r] >= n:
                own = maybe[row == r]
                yield int(r), own - begin[r], hashes[own]

    windows, begin = tokens.gram_hashes(words, first, seed)
    for shard in shards:
        if len(shard.windows):
            maybe = np.flatnonzero(shard.marks[(windows & U64(0xFFFF)).astype(np.int64)])
            sub = np.searchsorted(maybe, begin)
            for r, at, hashes in held(windows[maybe], sub, shard.windows, seed):
                i = maybe[sub[r] + at] - begin[r]  # first words of windows, in the row
                for run in np.split(i, np.flatnonzero(np.diff(i) != 1) + 1):
                    a, b = int(run[0]), int(run[-1]) + seed
                    for x, n in shard.automaton.matches(words[first[r] + a : first[r] + b], seed):
                        longest[r] = max(longest.get(r, 0), n)
                        if n >= max_length:
                            spans.setdefault(r, []).append((a + x, a + x + n))
                spans.setdefault(r, []).extend((x, x + seed) for x in covering(i, hashes, shard, seed, item_coverage).tolist())
        for n, items in shard.short.items():
            hashes, at = tokens.gram_hashes(words, first, n)
            for r, i, _ in held(hashes, at, items, n):
                longest[r] = max(longest.get(r, 0), n)
                spans.setdefault(r, []).extend((x, x + n) for x in i.tolist())
    return spans, longest


def _lower_rows(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower case, and which rows keep every character's place in bytes."""
    import pyarrow.compute as pc

    low = pc.utf8_lower(text)
    return low, pc.equal(pc.binary_length(low), pc.binary_length(text)).fill_null(True).to_numpy(zero_copy_only=False)


def _cut(text: str, low: str, spans: list[tuple[int, int]], same: bool) -> str:
    """Removes byte ranges of ``low`` from ``text``."""
    if same:
        raw = text.encode()
        parts, at = [], 0
        for a, b in spans:
            parts.append(raw[at:a])
            at = b
        return b"".join([*parts, raw[at:]]).decode()
    # characters whose lower case has another length: go by characters
    ends = np.cumsum([len(c.encode()) for c in low])
    out, at = [], 0
    for a, b in spans:
        i, j = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends, b, "right"))
        out.append(text[at:i])
        at = j
    return "".join([*out, text[at:]])


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, seed: int = SEED, max_length: int = MAX_LENGTH, item_coverage: float = ITEM_COVERAGE, drop_coverage: float = DROP_COVERAGE, automaton_words: int = AUTOMATON_WORDS,
    report: bool = True, pass_words: int = PASS_WORDS,
) -> DataFrame:
    """The documents without the spans they share with test items.

    A maximal match of ``max_length`` words or more is removed; so is a shorter one of ``seed`` words or more if the
    document's matches with the item cover ``item_coverage`` of it; a match counts for every item that holds it. An item of
    fewer than ``seed`` words is removed where it occurs as a whole, if it has ``SHORTEST`` words at least. A document that
    loses ``drop_coverage`` of its words is dropped. With ``report``, columns are added: n_words, removed_words, longest_match
    (0: none) and spans (ranges of words removed); input columns of these names are replaced. ``n_chars``, where there, follows
    the text.

    Words are compared in lower case without punctuation; a match does not cross two items. Null and empty texts stay as
    they are with no words. Null, wordless and repeated items change nothing, nor does the items' order. Whole texts are
    searched, however long. Every row is judged on its own, repeated ones too; with no items, all documents stay. An empty
    table gives an empty result. The benchmark goes through the driver item by item.
    """
    if not 1 <= seed <= max_length:
        raise ValueError("seed must be at least 1 and at most max_length")
    names = ["n_words", "removed_words", "longest_match", "spans"]
    docs = without(docs, names) if report else docs
    context = docs.sparkSession.sparkContext
    passes: list[list] = [[]]
    room = pass_words
    for size, shard in _shards(benchmark, seed, automaton_words):
        if passes[-1] and size > room:
            passes.append([])
            room = pass_words
        passes[-1].append(context.broadcast(shard))
        room -= size
    out = docs
    for k, shards in enumerate(passes):
        out = _pass(out, shards, k > 0, k == len(passes) - 1, seed, max_length, item_coverage, drop_coverage, report)
    return out


_SPANS = "array<struct<first:int,end:int>>"
_HIDDEN = ["h_spans", "h_longest"]


def _pass(docs: DataFrame, shards: list, later: bool, last: bool, seed: int, max_length: int, item_coverage: float, drop_coverage: float, report: bool) -> DataFrame:
    """Finds the spans of some automata and hands them on in hidden columns; the last pass removes those of all."""
    span = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
    fields = [f for f in docs.schema.fields if not later or f.name not in _HIDDEN]
    added = f"h_spans {_SPANS}, h_longest int" if not last else f"n_words int, removed_words int, longest_match int, spans {_SPANS}" if report else ""
    schema = StructType([*fields, *(StructType.fromDDL(added).fields if added else [])])

    def as_spans(rows: list[list[tuple[int, int]]]) -> pa.Array:
        return pa.array([[{"first": a, "end": b} for a, b in s] for s in rows], span)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_shards = [x.value for x in shards]
        for batch in batches:
            n = batch.num_rows
            column = batch.column("text")
            low, same = _lower_rows(column.cast(pa.large_string()))
            buf, off = tokens.string_buffers(low)
            n_words, removed = np.zeros(n, np.int32), np.zeros(n, np.int32)
            longest = np.array(batch.column("h_longest")) if later else np.zeros(n, np.int32)
            spans = [[(x["first"], x["end"]) for x in s] for s in batch.column("h_spans").to_pylist()] if later else [[] for _ in range(n)]
            texts: dict[int, str] = {}
            keep = np.ones(n, bool)
            for lo, hi in tokens.chunks(off):
                own, at = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                starts, ends, first = tokens.word_runs(own, at)
                n_words[lo:hi] = np.diff(first)
                found, most = spans_of(tokens.word_hashes(own, starts, ends), first, own_shards, seed, max_length, item_coverage)
                for r, x in found.items():
                    spans[lo + r] = merged(spans[lo + r] + x)
                for r, x in most.items():
                    longest[lo + r] = max(longest[lo + r], x)
                for r in range(lo, hi) if last else ():
                    if spans[r]:
                        removed[r] = sum(b - a for a, b in spans[r])
                        keep[r] = removed[r] < drop_coverage * n_words[r]
                        cuts = [(int(starts[first[r - lo] + a] - at[r - lo]), int(ends[first[r - lo] + b - 1] - at[r - lo])) for a, b in spans[r]]
                        texts[r] = _cut(column[r].as_py(), low[r].as_py(), cuts, bool(same[r]))
            columns = {f.name: batch.column(k) for k, f in enumerate(batch.schema) if not later or f.name not in _HIDDEN}
            if texts:
                where = np.zeros(n, bool)
                where[list(texts)] = True
                columns["text"] = _replaced(columns["text"], where, [texts[x] for x in sorted(texts)])
                if "n_chars" in columns and pa.types.is_integer(columns["n_chars"].type):
                    columns["n_chars"] = _replaced(columns["n_chars"], where, [len(texts[x]) for x in sorted(texts)])
            more = [as_spans(spans), pa.array(longest)] if not last else [pa.array(n_words), pa.array(removed), pa.array(longest), as_spans(spans)] if report else []
            yield pa.RecordBatch.from_arrays([*columns.values(), *more], names=[f.name for f in schema]).filter(pa.array(keep))

    return docs.mapInArrow(run, schema)


def _replaced(column: pa.Array, where: np.ndarray, values: list) -> pa.Array:
    import pyarrow.compute as pc

    return pc.replace_with_mask(column, pa.array(where), pa.array(values, column.type))
