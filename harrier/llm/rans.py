"""Token ids, packed by a static range asymmetric numeral system (rANS).

One frequency table, counted over the whole corpus, is shared by all blocks. A block holds a fixed number of tokens of
consecutive documents, dealt to ``LANES`` interleaved coder states that write to one stream of 32-bit words. Checkpoints hold
the states and the stream's place at regular tokens, so parts of a block can be decoded in parallel, and checksums cover the
stream and the tokens. All lanes of many blocks advance together in numpy.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import tokens
from .common import batch_of, binary, lean, saved
from .tokens import U64

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LANES = 32
BLOCK_TOKENS = 1 << 16
CHECKPOINT_TOKENS = 1 << 14
SCALE_BITS = 20
LOW = 1 << 31
#: Blocks coded side by side.
TOGETHER = 64
#: Distinct chunks of text that a worker remembers.
REMEMBER = 1 << 20

BLOCK_SCHEMA = (
    "block_id long, doc_ids array<long>, doc_starts array<long>, doc_tokens array<long>, n_tokens long, states binary, words binary, "
    "checkpoints array<struct<token:long,word:long,states:binary>>, words_crc long, tokens_crc long"
)


# --- tokens


class Tokenizer:
    """Byte-level BPE of Arrow columns.

    White space after something else always starts a new piece, so texts are cut there, and each distinct chunk of at most 15
    bytes is encoded once per worker: chunks are looked up by their bytes, held in two 64-bit numbers, not by a hash.
    """

    _SPACE = np.zeros(256, bool)
    _SPACE[[9, 10, 11, 12, 13, 32]] = True
    _KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1] * 9, U64)

    def __init__(self, vocabulary: bytes) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.size = max(ranks.values()) + 1
        self.coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = {v: k for k, v in ranks.items()}
        self.reset()

    def reset(self) -> None:
        self.mask = 2 * REMEMBER - 1
        self.low, self.high = np.zeros(2 * REMEMBER, U64), np.zeros(2 * REMEMBER, U64)
        self.slot = np.full(2 * REMEMBER, -1, np.int32)
        self.long: dict[bytes, int] = {}
        self.known = 0
        self.flat, self.filled = np.zeros(1 << 20, np.uint32), 0
        self.at, self.count = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)

    def _learn(self, chunks: list[bytes]) -> int:
        """Encodes new chunks; gives the number of the first."""
        coded = [self.coder.encode_ordinary(c.decode()) for c in chunks]
        lengths = np.array([len(c) for c in coded], np.int64)
        total = int(lengths.sum())
        while self.filled + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.known + len(chunks) > len(self.at):
            self.at, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.count))
        self.flat[self.filled : self.filled + total] = np.fromiter((t for c in coded for t in c), np.uint32, total)
        self.at[self.known : self.known + len(chunks)] = self.filled + np.cumsum(lengths) - lengths
        self.count[self.known : self.known + len(chunks)] = lengths
        self.filled += total
        self.known += len(chunks)
        return self.known - len(chunks)

    def _find(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of known chunks (-1: new), and the slot where each search ended."""
        place = ((tokens.mix(low ^ (high * U64(0x9E3779B97F4A7C15)))) & U64(self.mask)).astype(np.int64)
        number = np.full(len(low), -1, np.int32)
        todo = np.arange(len(low))
        while len(todo):
            here = place[todo]
            got = self.slot[here]
            same = (got >= 0) & (self.low[here] == low[todo]) & (self.high[here] == high[todo])
            number[todo[same]] = got[same]
            todo = todo[(got >= 0) & ~same]
            place[todo] = (place[todo] + 1) & self.mask
        return number, place

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all rows one after the other, and each row's number of tokens; nulls have none."""
        buf, off = tokens.string_buffers(column)
        parts, counts = [np.zeros(0, np.uint32)], []
        for lo, hi in tokens.chunks(off):
            got, n = self._encode(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            parts.append(got)
            counts.append(n)
        return np.concatenate(parts), np.concatenate([np.zeros(0, np.int64), *counts])

    def _encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        if self.known > REMEMBER:
            self.reset()
        space = self._SPACE[buf]
        cut = np.zeros(len(buf) + 1, bool)
        cut[1:-1] = space[1:] & ~space[:-1]
        lead = np.flatnonzero((buf == 0xC2) | (buf == 0xE1) | (buf == 0xE2) | (buf == 0xE3))
        if len(lead):  # other white space: do not cut after it
            after = np.append(buf, np.zeros(2, np.uint8))
            a, b, c = buf[lead], after[lead + 1], after[lead + 2]
            two = lead[(a == 0xC2) & ((b == 0xA0) | (b == 0x85))]
            three = lead[((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))]
            cut[two + 2] = False
            cut[three + 3] = False
        cut[off] = True
        bounds = np.flatnonzero(cut)
        starts, lengths = bounds[:-1], np.diff(bounds)
        padded = np.concatenate([buf, np.zeros(16, np.uint8)])
        words = np.ndarray(len(buf) + 8, "<u8", padded, strides=(1,))
        short = lengths < 16
        n = np.minimum(lengths, 15)
        low = words[starts] & self._KEEP[n]
        high = (words[starts + 8] & self._KEEP[np.maximum(n - 8, 0)]) | (n.astype(U64) << U64(56))
        number = np.empty(len(starts), np.int64)
        if not short.all():
            texts = [buf[s : s + k].tobytes() for s, k in zip(starts[~short], lengths[~short])]
            new = [t for t in dict.fromkeys(texts) if t not in self.long]
            if new:
                first = self._learn(new)
                self.long.update(zip(new, range(first, first + len(new))))
            number[~short] = [self.long[t] for t in texts]
            low, high = low[short], high[short]
        found, place = self._find(low, high)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            pairs = np.empty(len(missing), [("l", U64), ("h", U64)])
            pairs["l"], pairs["h"] = low[missing], high[missing]
            order = np.lexsort((pairs["l"], pairs["h"]))
            ranked = pairs[order]
            new = np.r_[True, ranked[1:] != ranked[:-1]]
            which = np.empty(len(missing), np.int64)
            which[order] = np.cumsum(new) - 1
            unique = ranked[new]
            sizes = (unique["h"] >> U64(56)).astype(np.int64)
            raw = np.stack([unique["l"], unique["h"]], 1).tobytes()
            first = self._learn([raw[16 * k : 16 * k + s] for k, s in enumerate(sizes)])
            found[missing] = first + which
            spots = np.empty(len(unique), np.int64)
            spots[which] = place[missing]
            for k, spot in enumerate(spots.tolist()):
                while self.slot[spot] >= 0:
                    spot = (spot + 1) & self.mask
                self.slot[spot] = first + k
                self.low[spot], self.high[spot] = unique[k]
        number[short] = found
        counts = self.count[number]
        total = np.cumsum(counts)
        at = np.repeat(self.at[number] - (total - counts), counts) + np.arange(total[-1])
        row_first = np.searchsorted(starts, off)
        return self.flat[at], np.diff(np.concatenate([[0], total])[row_first])


_tokenizers: dict[int, Tokenizer] = {}


def tokenizer(vocabulary: bytes) -> Tokenizer:
    """One per worker process and vocabulary."""
    key = zlib.crc32(vocabulary)
    if key not in _tokenizers:
        _tokenizers[key] = Tokenizer(vocabulary)
    return _tokenizers[key]


def read_vocabulary(path: str) -> bytes:
    """The vocabulary's file, which only the driver needs to have; executors get its bytes (under a megabyte or two, whatever the corpus)."""
    with open(path, "rb") as file:
        return file.read()


# --- frequency table


def scaled(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies that sum to 2**bits, at least 1 for every symbol that occurs: largest remainders, ties to the lower symbol."""
    counts = np.asarray(counts, np.float64)
    have = counts > 0
    if have.sum() > 1 << bits:
        raise ValueError("more symbols than the scale has room for")
    out = np.zeros(len(counts), np.int64)
    if not have.any():
        return out
    free = (1 << bits) - int(have.sum())
    share = counts / counts.sum() * free
    out[have] = 1 + np.floor(share[have]).astype(np.int64)
    left = (1 << bits) - int(out.sum())
    order = np.lexsort((np.arange(len(counts)), -(share - np.floor(share)), ~have))
    out[order[:left]] += 1
    return out


class Table:
    def __init__(self, frequencies: np.ndarray, bits: int = SCALE_BITS) -> None:
        self.bits = bits
        self.frequency = frequencies.astype(U64)
        self.start = (np.cumsum(frequencies) - frequencies).astype(U64)

    def symbols(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.frequency), dtype=np.uint32), self.frequency.astype(np.int64))


# --- coder


def encode_blocks(blocks: list[np.ndarray], table: Table, lanes: int = LANES, checkpoint: int = CHECKPOINT_TOKENS) -> list[tuple[bytes, bytes, list[tuple[int, int, bytes]]]]:
    """(states, words, checkpoints) of blocks of equal length, coded side by side. A checkpoint is (token, word, states)."""
    n, many = len(blocks[0]), len(blocks)
    steps = -(-n // lanes)
    symbols = np.zeros((many, steps * lanes), np.uint32)
    for k, block in enumerate(blocks):
        symbols[k, :n] = block
    symbols = symbols.reshape(many, steps, lanes)
    live = np.arange(steps * lanes).reshape(steps, lanes) < n
    x = np.full((many, lanes), LOW, U64)
    bits, limit = U64(table.bits), U64(63 - table.bits)
    out, sent = np.zeros((steps, many, lanes), np.uint32), np.zeros((steps, many, lanes), bool)
    every, marks = checkpoint // lanes, {}
    for t in range(steps - 1, -1, -1):
        own = symbols[:, t, :]
        f, c = table.frequency[own], table.start[own]
        whole = t < steps - 1 or bool(live[t].all())
        if not whole:
            f = np.where(live[t], f, U64(1))
        full = x >= f << limit
        if not whole:
            full &= live[t]
        out[t], sent[t] = x.astype(np.uint32), full
        y = np.where(full, x >> U64(32), x)
        quotient = y // f
        y = (quotient << bits) + (y - quotient * f) + c
        x = y if whole else np.where(live[t], y, x)
        if t and t % every == 0:
            marks[t] = x
    words_at = np.concatenate([np.zeros((1, many), np.int64), np.cumsum(sent.sum(axis=2), axis=0)])
    return [(x[k].tobytes(), out[:, k, :][sent[:, k, :]].tobytes(), [(t * lanes, int(words_at[t, k]), marks[t][k].tobytes()) for t in sorted(marks)]) for k in range(many)]


def decode(states: bytes, words: bytes, table: Table, tokens_: int, symbols: np.ndarray | None = None, lanes: int = LANES) -> np.ndarray:
    """``tokens_`` tokens from the given states and stream on; from a checkpoint as well as from a block's start."""
    x = np.frombuffer(states, U64).copy()
    stream = np.frombuffer(words, np.uint32)
    symbols = table.symbols() if symbols is None else symbols
    out = np.zeros(-(-tokens_ // lanes) * lanes, np.uint32)
    at = 0
    for t in range(0, tokens_, lanes):
        n = min(lanes, tokens_ - t)
        slot = x[:n] & U64((1 << table.bits) - 1)
        s = symbols[slot.astype(np.int64)]
        out[t : t + n] = s
        x[:n] = table.frequency[s] * (x[:n] >> U64(table.bits)) + slot - table.start[s]
        need = np.flatnonzero(x[:n] < U64(LOW))
        x[need] = (x[need] << U64(32)) | stream[at : at + len(need)].astype(U64)
        at += len(need)
    return out[:tokens_]


# --- operator


def tokenized(docs: DataFrame, vocabulary: bytes, order: Sequence[F.Column] = ()) -> DataFrame:
    """(doc_id, tokens, o0, o1, ..., place): token ids as packed little-endian integers of 16 bits, or 32 if the vocabulary needs them; the values of ``order``; place ascends with the order of the input."""

    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(shared.value)
        kind = np.uint16 if own.size <= 65536 else np.uint32
        context = TaskContext.get()
        place = (context.partitionId() if context else 0) << 40
        for batch in batches:
            ids, counts = own.encode(batch.column("text"))
            raw = memoryview(ids.astype(kind).tobytes())
            ends = np.cumsum(counts) * kind().itemsize
            coded = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
            yield batch_of(doc_id=batch.column("doc_id"), tokens=coded, **{x: batch.column(x) for x in keys}, place=np.arange(place, place + batch.num_rows))
            place += batch.num_rows

    keys = [f"o{k}" for k in range(len(order))]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[c.alias(x) for c, x in zip(order, keys)])
    return own.mapInArrow(run, StructType([*StructType.fromDDL("doc_id long, tokens binary").fields, *own.schema.fields[2:], *StructType.fromDDL("place long").fields]))


def _kind(vocabulary: bytes) -> str:
    return "<u2" if max(int(line.split()[1]) for line in vocabulary.splitlines()) < 65536 else "<u4"


def token_counts(coded: DataFrame, kind: str) -> DataFrame:
    """(token, n) over all documents; each task sends one row per token it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                own = np.bincount(np.frombuffer(b"".join(x.as_buffer() for x in batch.column("tokens").slice(lo, 1000)), kind))
                if len(own) > len(counts):
                    own[: len(counts)] += counts
                    counts = own
                else:
                    counts[: len(own)] += own
        met = np.flatnonzero(counts)
        yield batch_of(token=met, n=counts[met])

    return coded.select("tokens").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def blocks(coded: DataFrame, frequencies: np.ndarray, kind: str, block_tokens: int = BLOCK_TOKENS, lanes: int = LANES, checkpoint: int = CHECKPOINT_TOKENS) -> DataFrame:
    shared = coded.sparkSession.sparkContext.broadcast(frequencies)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(shared.value)
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        ready: list[tuple[np.ndarray, list[tuple]]] = []
        open_: list[np.ndarray] = []
        spans: list[tuple] = []
        held = 0

        def flush(some: list[tuple[np.ndarray, list[tuple]]]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            if not some:
                return
            coded_ = encode_blocks([b for b, _ in some], table, lanes, checkpoint)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(number, number + len(some)), pa.int64()),
                    *(pa.array([[s[k] for s in own] for _, own in some], pa.list_(pa.int64())) for k in range(3)),
                    pa.array([len(b) for b, _ in some], pa.int64()),
                    binary(c[0] for c in coded_),
                    binary(c[1] for c in coded_),
                    pa.array([[{"token": t, "word": w, "states": s} for t, w, s in c[2]] for c in coded_], pa.list_(pa.struct([("token", pa.int64()), ("word", pa.int64()), ("states", pa.binary())]))),
                    pa.array([zlib.crc32(c[1], zlib.crc32(c[0])) for c in coded_], pa.int64()),
                    pa.array([zlib.crc32(b.astype("<u4").tobytes()) for b, _ in some], pa.int64()),
                ],
                names=["block_id", "doc_ids", "doc_starts", "doc_tokens", "n_tokens", "states", "words", "checkpoints", "words_crc", "tokens_crc"],
            )
            number += len(some)

        for batch in batches:
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("tokens")):
                own = np.frombuffer(raw.as_buffer(), kind)
                at = 0
                while True:
                    take = min(len(own) - at, block_tokens - held)
                    spans.append((doc, at, take))
                    open_.append(own[at : at + take])
                    held += take
                    at += take
                    if held == block_tokens:
                        ready.append((np.concatenate(open_), spans))
                        open_, spans, held = [], [], 0
                        if len(ready) == TOGETHER:
                            yield from flush(ready)
                            ready = []
                    if at == len(own):
                        break
        yield from flush(ready)
        if spans:
            yield from flush([(np.concatenate(open_), spans)])

    return coded.mapInArrow(run, BLOCK_SCHEMA)


def pack(docs: DataFrame, path: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS, lanes: int = LANES, checkpoint: int = CHECKPOINT_TOKENS, order: Sequence[F.Column] = ()) -> DataFrame:
    """Blocks of rANS-coded tokens of all documents, and one row (block_id -1) with the shared frequency table.

    A block names the parts of documents it holds: doc_ids, the first token of each part in its document (doc_starts) and its
    number of tokens (doc_tokens). The table's row has the frequencies of all symbols as 32-bit numbers in ``words``.
    ``unpack`` is the inverse. Blocks in order of block_id have the documents in the order of the columns ``order``, and of the
    input where those tie or are not given; the high half of block_id is the partition. The order of a table that was read from
    several files is the one Spark happens to read them in.

    Null and empty texts have no tokens and stand in a block with 0 of them; a null doc_id stays null; repeated rows are
    packed as often as they come; a document longer than a block goes on in the next. An empty table gives the table's row
    alone, with no symbols. Other columns are ignored. doc_id must be a number, or text that reads as one, or null.
    """
    if block_tokens % lanes or checkpoint % lanes:
        raise ValueError("a block and the distance of checkpoints must be multiples of the lanes")
    vocabulary = read_vocabulary(path)
    kind = _kind(vocabulary)
    coded = saved(tokenized(docs, vocabulary, order))
    # one row per entry of the vocabulary, whatever the corpus
    rows = token_counts(coded, kind).collect()
    counts = np.zeros(max((r.token for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        counts[r.token] = r.n
    frequencies = scaled(counts)
    # files come back in another order than they were written in
    ordered = coded.orderBy(*[f"o{k}" for k in range(len(order))], "place").select("doc_id", "tokens")
    head = [(-1, [], [], [], int(counts.sum()), None, bytearray(frequencies.astype("<u4").tobytes()), [], zlib.crc32(frequencies.astype("<u4").tobytes()), None)]
    return docs.sparkSession.createDataFrame(head, BLOCK_SCHEMA).unionByName(blocks(ordered, frequencies, kind, block_tokens, lanes, checkpoint))


def unpack(packed: DataFrame, lanes: int = LANES) -> DataFrame:
    """(doc_id, start, tokens): the parts of documents in the blocks of ``pack``; raises if a checksum is wrong."""
    head = packed.where("block_id = -1").first()
    if zlib.crc32(head.words) != head.words_crc:
        raise ValueError("the frequency table's checksum is wrong")
    shared = packed.sparkSession.sparkContext.broadcast(np.frombuffer(bytes(head.words), "<u4").astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(shared.value)
        symbols = table.symbols()
        for batch in batches:
            for row in batch.to_pylist():
                if zlib.crc32(row["words"], zlib.crc32(row["states"])) != row["words_crc"]:
                    raise ValueError(f"block {row['block_id']}: the stream's checksum is wrong")
                ids = decode(row["states"], row["words"], table, row["n_tokens"], symbols, lanes)
                if zlib.crc32(ids.astype("<u4").tobytes()) != row["tokens_crc"]:
                    raise ValueError(f"block {row['block_id']}: the tokens' checksum is wrong")
                ends = np.cumsum(row["doc_tokens"])
                yield batch_of(doc_id=pa.array(row["doc_ids"], pa.int64()), start=pa.array(row["doc_starts"], pa.int64()), tokens=pa.array([ids[b - n : b].astype(np.int32) for b, n in zip(ends, row["doc_tokens"])], pa.list_(pa.int32())))

    return packed.where("block_id >= 0").mapInArrow(run, "doc_id long, start long, tokens array<int>")
