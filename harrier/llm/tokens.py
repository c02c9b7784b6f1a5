"""Word runs and n-gram hashes of a whole Arrow string column at once, in numpy.

A word is a maximal run of lower-case ASCII letters, digits and characters from U+00C0 up, without the punctuation blocks
U+2000-U+207F and U+3000-U+303F; ``WORD`` is the same as a regular expression, for Spark and for SQL. Texts are expected in
lower case (``pyspark.sql.functions.lower``), so that both see the same folding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD = r"[0-9a-z\x{C0}-\x{1FFF}\x{2080}-\x{2FFF}\x{3040}-\x{10FFFF}]+"
CHUNK_BYTES = 1 << 19

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_MULT = U64(0x9E3779B97F4A7C15)
_MULT_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, m in enumerate((_MULT, _MULT_INV)):
            steps = np.full(max(n, CHUNK_BYTES + 1), m, U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_binary():
        column = column.cast(pa.large_string()).cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n, (_, offsets, data) = len(column), column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer row comes alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def word_runs(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and each row's first word (one entry more than rows)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = _IS_WORD[buf]
    lead = np.flatnonzero((buf == 0xC2) | (buf == 0xE2) | (buf == 0xE3))
    if len(lead):
        after = np.append(buf, np.zeros(2, np.uint8))
        two = lead[buf[lead] == 0xC2]
        three = lead[((buf[lead] == 0xE2) & ((after[lead + 1] | 1) == 0x81)) | ((buf[lead] == 0xE3) & (after[lead + 1] == 0x80))]
        word[two] = False
        word[np.minimum(two + 1, len(buf) - 1)] = False
        for k in range(3):
            word[np.minimum(three + k, len(buf) - 1)] = False
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every word."""
    if not len(starts):
        return np.zeros(0, U64)
    up, down = _power_tables(len(buf) + 1)
    sums = np.empty(len(buf) + 1, U64)
    sums[0] = 0
    np.cumsum(BYTE_VALUE[buf] * up[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def gram_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside a row, and each row's first gram. A row of fewer words, but at least one, has one gram: all it has."""
    counts = np.diff(first)
    grams = np.where(counts > 0, np.maximum(counts - n + 1, 1), 0)
    out_first = np.concatenate([[0], np.cumsum(grams)])
    padded = np.concatenate([words, np.zeros(n, U64)])
    factor = [mix(np.array([k + 1], U64) * _MULT)[0] | U64(1) for k in range(n)]
    total = np.zeros(len(words), U64)
    for k in range(n):
        total += padded[k : k + len(words)] * factor[k]
    short = np.flatnonzero((counts > 0) & (counts < n))
    at = np.repeat(first[:-1] - out_first[:-1], grams) + np.arange(out_first[-1])
    for row in short:
        own = words[first[row] : first[row + 1]]
        total[first[row]] = np.sum(own * np.array(factor[: len(own)], U64), dtype=U64) + U64(len(own))
    return mix(total[at]), out_first


def hash_word(word: str) -> int:
    buf = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(buf, np.array([0]), np.array([len(buf)]))[0])
