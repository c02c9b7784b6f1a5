"""N-gram Jaccard join by vertical partitioning.

A document is the set of its word n-grams. Grams are first counted by hash range, so their document frequencies are exact.
Grams of one document only cannot overlap and stay where they were counted. What is left is gathered per document, put in the
global order (rarest first, then by hash) and cut to the prefix that any partner must share a gram with. Documents that share
a prefix gram, and whose sizes and places of that gram leave room for a partner in its list, form blocks. ``ngram_join`` cuts the
global order into fragments: in a block, the overlaps of every pair are counted in each fragment separately and summed per pair.
Classes and numbers of links need no list of pairs, which grows with the square of a class: there a block's documents are cut into
slabs, the overlaps of two slabs are counted in full at one place, and only sums per document and a spanning forest leave it.

Documents with the same word sequence are one node throughout, so a thousand copies cost as much as one. Word sequences are
told apart by a 64-bit hash, and grams by 40 bits and the number of their hash range: of 10 billion different texts, about 3
pairs would be taken for copies of each other by chance; a gram is taken for a certain other one with a chance of 1 in
2**40 times the number of ranges.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import tokens
from .common import batch_of, binary, by_bucket, components, exchange, lean, numbers, release, saved
from .tokens import U64

GRAM = 3
THRESHOLD = 0.5
#: Grams that one fragment should hold; the number of fragments follows the corpus.
FRAGMENT_GRAMS = 8_000_000
#: Grams that a task packs before it sends them.
PACK_GRAMS = 1_000_000
#: Fragments in which a block's overlaps are counted separately, at least, and grams in a fragment of a larger block.
BLOCK_FRAGMENTS = 2
BLOCK_GRAMS = 4_000_000
#: Grams of a slab, documents of a block that are compared with those of each other slab: a block has up to SLABS slabs of about
#: SLAB_GRAMS, for the sake of all cores, and more only where a slab would exceed SLAB_MOST.
SLAB_GRAMS = 400_000
SLAB_MOST = 1_500_000
SLABS = 12
#: Low bits of a gram's hash that travel; the fragment supplies the rest.
LOW_BITS = 40
LOW_BYTES = LOW_BITS // 8
#: Bits of a gram's place in its fragment, beside the low bits of its hash in one 64-bit number.
PLACE_BITS = 64 - LOW_BITS
#: Pairs held at once while a fragment or two slabs count.
COUNT_PAIRS = 1_000_000


def hashed(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk of rows: their range, word hashes, first words, and a key of each row's word sequence (0: no words)."""
    import pyarrow.compute as pc

    buf, off = tokens.string_buffers(pc.utf8_lower(batch.column("text").cast(pa.large_string())))
    for lo, hi in tokens.chunks(off):
        own, at = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        starts, ends, first = tokens.word_runs(own, at)
        words = tokens.word_hashes(own, starts, ends)
        counts = np.diff(first)
        place = np.arange(len(words)) - np.repeat(first[:-1], counts)
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(tokens.mix(words + place.astype(U64) * U64(0x9E3779B97F4A7C15)), dtype=U64)])
        keys = tokens.mix((sums[first[1:]] - sums[first[:-1]]) ^ (counts.astype(U64) << U64(40)))
        yield lo, hi, words, first, np.where(counts > 0, keys | U64(1), U64(0))


def document_keys(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, key, grams): the key of the word sequence and the number of n-grams with repeats; documents without words are left out."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, first, keys in hashed(batch):
                have = pa.array(keys > 0)
                counts = np.maximum(np.diff(first) - n + 1, 1)
                yield batch_of(doc_id=batch.column("doc_id").slice(lo, hi - lo), key=keys.view(np.int64), grams=counts).filter(have)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, key long, grams long")


def _fragments(docs: DataFrame, n: int, fragments: int) -> DataFrame:
    """Packed per fragment: keys, set sizes, number of grams and the grams' low bits."""
    bits = U64(64 - 22)

    def pack(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate([k for k, _, _ in parts])
        counts = np.concatenate([c for _, c, _ in parts])
        grams = np.concatenate([g for _, _, g in parts])
        row = np.repeat(np.arange(len(keys), dtype=np.uint32), counts)
        order = np.argsort(grams)
        order = order[np.argsort(row[order].astype(np.uint16) if len(keys) < 65536 else row[order], kind="stable")]
        grams, row = grams[order], row[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
        grams, row = grams[new], row[new]
        sizes = np.bincount(row, minlength=len(keys)).astype(np.uint32)
        frag = ((grams >> bits) * U64(fragments) >> U64(22)).astype(np.uint32)
        order = np.argsort(frag.astype(np.uint16) if fragments < 65536 else frag, kind="stable")
        grams, row, frag = grams[order], row[order], frag[order]
        low = grams.view(np.uint8).reshape(-1, 8)[:, :LOW_BYTES]
        cuts = np.flatnonzero(np.diff(frag)) + 1
        out: dict[str, list] = {"bucket": [], "keys": [], "counts": [], "grams": [], "all_keys": [], "all_sizes": []}
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(frag)]):
            here = row[lo:hi]
            begin = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
            out["bucket"].append(int(frag[lo]))
            out["keys"].append(keys[here[begin]].tobytes())
            out["counts"].append(_short(np.diff(np.r_[begin, hi - lo])))
            out["grams"].append(low[lo:hi].tobytes())
            out["all_keys"].append(b"")
            out["all_sizes"].append(b"")
        one = int(keys[0] % U64(len(out["bucket"])))  # set sizes travel once, with any fragment
        out["all_keys"][one], out["all_sizes"][one] = keys.tobytes(), sizes.tobytes()
        yield batch_of(bucket=pa.array(out.pop("bucket"), pa.int32()), **{k: binary(v) for k, v in out.items()})

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        held = 0
        for batch in batches:
            for _, _, words, first, keys in hashed(batch):
                grams, at = tokens.gram_hashes(words, first, n)
                _, once = np.unique(keys, return_index=True)
                once = np.sort(once[keys[once] > 0])
                if len(once) < len(keys):
                    take = np.zeros(len(keys), bool)
                    take[once] = True
                    grams = grams[np.repeat(take, np.diff(at))]
                parts.append((keys[once], np.diff(at)[once], grams))
                held += len(grams)
                if held >= PACK_GRAMS:
                    yield from pack(parts)
                    parts, held = [], 0
        if held:
            yield from pack(parts)

    return docs.select("text").mapInArrow(run, "bucket int, keys binary, counts binary, grams binary, all_keys binary, all_sizes binary")


def _short(counts: np.ndarray) -> bytes:
    """16-bit numbers, or 32-bit ones if a count needs them; see ``_counts``."""
    return counts.astype("<u2" if counts.max(initial=0) < 65536 else "<u4").tobytes()


def _counts(counts: pa.ChunkedArray, keys: pa.ChunkedArray) -> np.ndarray:
    parts = [np.frombuffer(c.as_buffer(), "<u2" if len(c.as_buffer()) * 4 == len(k.as_buffer()) else "<u4") for c, k in zip(counts, keys)]
    return np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64)


def _unpack(packed: pa.ChunkedArray | pa.Array, width: int = LOW_BYTES) -> np.ndarray:
    """Grams from their low ``width`` bytes."""
    parts = [np.frombuffer(x.as_buffer(), np.uint8) for x in packed]
    wide = np.zeros((sum(len(x) for x in parts) // width, 8), np.uint8)
    at = 0
    for x in parts:
        n = len(x) // width
        wide[at : at + n, :width] = x.reshape(n, width)
        at += n
    return wide.reshape(-1).view(U64)


def _low(grams: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bytes of each gram; the inverse of ``_unpack``."""
    return np.ascontiguousarray(np.ascontiguousarray(grams).view(np.uint8).reshape(-1, 8)[:, :width])


def _width(fragments: int) -> int:
    """Bytes of a gram with its fragment's number."""
    return LOW_BYTES + -(-max(fragments - 1, 1).bit_length() // 8)


def _rarity(frequency: np.ndarray) -> np.ndarray:
    """Document frequencies on a logarithmic scale of one byte: the global order needs to be the same everywhere, not fine."""
    return np.minimum(np.rint(8 * np.log2(frequency)), 255).astype(np.uint8)


def _shared_grams(fragments: DataFrame, buckets: int) -> DataFrame:
    """Of each fragment, the grams of two documents at least with their document frequency, packed by bucket of the document's key."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fragment, rows in by_bucket(batches):
            all_keys, all_sizes = numbers(rows["all_keys"], "<u8")[0], numbers(rows["all_sizes"], "<u4")[0]
            home = ((all_keys >> U64(20)) % U64(buckets)).astype(np.int32)
            for k in np.unique(home):
                yield _packed(k, -1, all_keys=all_keys[home == k].tobytes(), all_sizes=all_sizes[home == k].tobytes())
            keys, counts, grams = numbers(rows["keys"], "<u8")[0], _counts(rows["counts"], rows["keys"]), _unpack(rows["grams"])
            del rows
            _, once = np.unique(keys, return_index=True)
            if len(once) < len(keys):  # copies that different tasks read
                take = np.zeros(len(keys), bool)
                take[once] = True
                grams = grams[np.repeat(take, counts)]
                keys, counts = keys[take], counts[take]
            if len(grams) < 1 << PLACE_BITS:  # the gram and its place fit in 64 bits: sort them in place
                grams_at = grams << U64(PLACE_BITS)
                grams_at |= np.arange(len(grams), dtype=U64)
                grams_at.sort()
                order = (grams_at & U64((1 << PLACE_BITS) - 1)).astype(np.int32)
                grams_at >>= U64(PLACE_BITS)
            else:
                order = np.argsort(grams)
                grams_at = grams[order]
            begin = np.flatnonzero(np.r_[True, grams_at[1:] != grams_at[:-1]]).astype(np.int32)
            del grams_at
            run_lengths = np.diff(np.r_[begin, len(grams)])
            frequency = np.empty(len(grams), np.uint8)
            frequency[order] = np.repeat(_rarity(run_lengths), run_lengths)
            del order, begin, run_lengths
            shared = frequency > 0
            row = np.repeat(np.arange(len(keys), dtype=np.int32), counts)[shared]
            grams, frequency = grams[shared], frequency[shared]
            bucket = (keys >> U64(20)) % U64(buckets)
            order = np.argsort(bucket[row].astype(np.uint16 if buckets < 65536 else np.uint32), kind="stable")
            row, grams, frequency = row[order], grams[order], frequency[order]
            bucket = bucket[row].astype(np.int32)
            low = _low(grams, LOW_BYTES)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(bucket)]) if len(bucket) else ():
                here = row[lo:hi]
                begin = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
                yield _packed(bucket[lo], fragment, keys=keys[here[begin]].tobytes(), counts=_short(np.diff(np.r_[begin, hi - lo])), grams=low[lo:hi].tobytes(), frequency=frequency[lo:hi].tobytes())

    return fragments.mapInArrow(run, "bucket int, fragment int, " + ", ".join(f"{x} binary" for x in _PARTS))


_PARTS = ("keys", "counts", "grams", "frequency", "all_keys", "all_sizes")


def _packed(bucket: int, fragment: int, **parts: bytes) -> pa.RecordBatch:
    return batch_of(bucket=pa.array([bucket], pa.int32()), fragment=pa.array([fragment], pa.int32()), **{x: binary([parts.get(x, b"")]) for x in _PARTS})


def _least_overlap(size: np.ndarray, threshold: float) -> np.ndarray:
    return np.maximum(np.ceil(threshold * size - 1e-9), 1).astype(np.int64)


def _survivors(shared: DataFrame, threshold: float, width: int) -> DataFrame:
    """Documents that share enough grams to have a partner: (key, size, prefix, have, grams, rarity), the grams (``have`` of them) rarest first; the first ``prefix`` of them are the part that a partner must meet."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_bucket(batches):
            keys, per_row = numbers(rows["keys"], "<u8")
            counts = _counts(rows["counts"], rows["keys"])
            all_keys, at = np.unique(numbers(rows["all_keys"], "<u8")[0], return_index=True)
            all_sizes = numbers(rows["all_sizes"], "<u4")[0][at].astype(np.int64)
            nodes, inverse = np.unique(keys, return_inverse=True)
            sizes, have = all_sizes[np.searchsorted(all_keys, nodes)], np.bincount(inverse, weights=counts, minlength=len(nodes)).astype(np.int64)
            least = _least_overlap(sizes, threshold)
            alive = have >= least
            fragment = np.repeat(np.maximum(rows["fragment"].to_numpy(), 0).astype(U64), per_row)
            grams = _unpack(rows["grams"]) | np.repeat(fragment << U64(LOW_BITS), counts)
            frequency = numbers(rows["frequency"], np.uint8)[0]
            node = np.repeat(inverse, counts)
            take = alive[node]
            node, grams, frequency = node[take], grams[take], frequency[take]
            order = np.argsort(grams)
            order = order[np.argsort(frequency[order], kind="stable")]
            order = order[np.argsort(node[order].astype(np.uint16) if len(nodes) < 65536 else node[order], kind="stable")]
            grams, frequency = _low(grams[order], width).reshape(-1), frequency[order]
            ends = np.cumsum(have[alive])
            begins = ends - have[alive]
            yield batch_of(
                key=nodes[alive].view(np.int64), size=sizes[alive].astype(np.int32), prefix=(have - least + 1)[alive].astype(np.int32), have=have[alive].astype(np.int32),
                grams=binary(grams[a * width : b * width].tobytes() for a, b in zip(begins, ends)), rarity=binary(frequency[a:b].tobytes() for a, b in zip(begins, ends)),
            )

    return shared.mapInArrow(run, "key long, size int, prefix int, have int, grams binary, rarity binary")


def _prefix_edges(survivors: DataFrame, threshold: float, partitions: int, width: int) -> DataFrame:
    """Edges (a, b) that connect all documents that may be near: each prefix gram's list in the order of size, cut where no pair can reach across."""

    @lean
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, counts = _unpack(batch.column("grams"), width), batch.column("have").to_numpy()
            if not len(grams):
                continue
            place = np.arange(len(grams)) - np.repeat(np.cumsum(counts) - counts, counts)
            prefix = place < np.repeat(batch.column("prefix").to_numpy(), counts)
            keys, sizes, rest = (np.repeat(x, counts)[prefix] for x in (batch.column("key").to_numpy(), batch.column("size").to_numpy(), counts))
            grams, rest = grams[prefix], (rest - place[prefix]).astype(np.int32)
            bucket = (tokens.mix(grams.copy()) % U64(partitions)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, keys, sizes, rest, low = bucket[order], keys[order], sizes[order], rest[order], _low(grams[order], width)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            spans = list(zip(np.r_[0, cuts], np.r_[cuts, len(bucket)]))
            yield batch_of(bucket=bucket[[a for a, _ in spans]], **{k: binary(x[a:b].tobytes() for a, b in spans) for k, x in (("keys", keys), ("sizes", sizes), ("rest", rest), ("grams", low))})

    @lean
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_bucket(batches):
            pairs = _linked(numbers(rows["keys"], "<i8")[0], _unpack(rows["grams"], width), numbers(rows["sizes"], "<i4")[0], numbers(rows["rest"], "<i4")[0], threshold)
            if len(pairs):
                yield batch_of(a=pairs[:, 0].copy(), b=pairs[:, 1].copy())

    packed = survivors.mapInArrow(pack, "bucket int, keys binary, sizes binary, rest binary, grams binary")
    return exchange(packed, partitions).mapInArrow(link, "a long, b long")


def _linked(keys: np.ndarray, grams: np.ndarray, sizes: np.ndarray, rest: np.ndarray, threshold: float) -> np.ndarray:
    """Edges (least key, key) of the documents of each gram that may be near; ``rest``: a document's grams from this one on.

    Two near documents share no more than the lesser ``rest`` at the first gram they share, which bounds the size of a partner by
    rest * (1 + threshold) / threshold - size. So no pair is lost, if its first gram's list, in the order of size, is only cut
    where nobody before the cut can have a partner as large as the next.
    """
    order = np.lexsort((keys, sizes, grams))
    keys, grams, sizes = keys[order], grams[order], sizes[order].astype(np.float64)
    most = rest[order] * ((1 + threshold) / threshold) - sizes + 1e-6
    for _ in range(2):  # without those for whom even the least of the list is too large
        begin = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]][: len(grams)])
        length = np.diff(np.r_[begin, len(grams)])
        stay = (most >= np.repeat(sizes[begin], length)) & np.repeat(length > 1, length)
        keys, grams, sizes, most = keys[stay], grams[stay], sizes[stay], most[stay]
    if not len(keys):
        return np.zeros((0, 2), np.int64)
    same = grams[1:] == grams[:-1]
    # beyond any size: one running maximum for all lists; in whole numbers, as floats of many lists would round the sizes
    apart = np.cumsum(np.r_[False, ~same]) << 33
    reach = np.minimum(np.minimum(most, sizes / threshold + 1e-6) + 1e-3, float(1 << 32)).astype(np.int64)
    reach = np.maximum.accumulate(reach + apart) - apart
    begin = np.flatnonzero(np.r_[True, ~(same & (reach[:-1] >= sizes[1:].astype(np.int64)))])
    least = np.repeat(np.minimum.reduceat(keys, begin), np.diff(np.r_[begin, len(keys)]))
    return np.unique(np.stack([least, keys], 1)[least != keys], axis=0)


def _count(node: np.ndarray, sizes: np.ndarray, have: np.ndarray, gram: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, overlap) of all pairs of nodes that share a gram here; ``gram`` tells blocks apart, ``node`` ascends.

    Left out are pairs that cannot reach the threshold: by their sizes, or even if all of the shared grams (``have``) that the
    smaller one has in other fragments were common. Pairs are counted by ranges of their lower node, so that no sum is ever
    open and only ``COUNT_PAIRS`` of them, or those of one node, are held.
    """
    order = np.argsort(gram, kind="stable")
    node, gram = node[order], gram[order]
    del order
    begin = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else np.zeros(0, np.int64)
    length = np.diff(np.r_[begin, len(gram)])
    del gram
    elsewhere = have - np.bincount(node, minlength=len(sizes))
    # the occurrences that others of the same list follow, by node
    after = np.repeat((begin + length).astype(np.int32), length) - np.arange(len(node), dtype=np.int32) - 1
    left = np.flatnonzero(after).astype(np.int32)
    left = left[np.argsort(node[left], kind="stable")]
    after = after[left]
    ends = np.cumsum(after, dtype=np.int64)
    last = np.flatnonzero(np.r_[node[left][1:] != node[left][:-1], True]) if len(left) else np.zeros(0, np.int64)
    lo = k = 0
    while lo < len(left):
        k = max(int(np.searchsorted(ends[last], (ends[lo - 1] if lo else 0) + COUNT_PAIRS, "right")), k + 1)
        hi = int(last[k - 1]) + 1
        n = after[lo:hi]
        a = np.repeat(left[lo:hi], n)
        b = a + 1 + (np.arange(len(a), dtype=np.int64) - np.repeat(np.cumsum(n, dtype=np.int64) - n, n)).astype(np.int32)
        a, b = node[a], node[b]
        fits = np.minimum(sizes[a], sizes[b]) >= threshold * np.maximum(sizes[a], sizes[b]) - 1e-9
        pair, times = np.unique(a[fits].astype(np.int64) * len(sizes) + b[fits], return_counts=True)
        del a, b, fits
        a, b = pair // len(sizes), pair % len(sizes)
        enough = times + np.minimum(elsewhere[a], elsewhere[b]) >= threshold / (1 + threshold) * (sizes[a] + sizes[b]) - 1e-6
        if enough.any():
            yield a[enough], b[enough], times[enough]
        lo = hi


def _order(rows: DataFrame) -> DataFrame:
    """(component, levels): of each component, how many grams there are of each of the 256 degrees of rarity, as 64-bit numbers."""

    @lean
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            components_, of = np.unique(batch.column("component").to_numpy(), return_inverse=True)
            rarity, counts = numbers(batch.column("rarity"), np.uint8)
            cells, n = np.unique(np.repeat(of, counts) * 256 + rarity, return_counts=True)
            yield batch_of(component=components_[cells // 256], rarity=(cells % 256).astype(np.int32), n=n)

    counted = rows.select("component", "rarity").mapInArrow(run, "component long, rarity int, n long").groupBy("component", "rarity").agg(F.sum("n").alias("n"))
    by = F.map_from_entries(F.collect_list(F.struct("rarity", "n")))
    return counted.groupBy("component").agg(by.alias("by")).select("component", F.transform(F.sequence(F.lit(0), F.lit(255)), lambda k: F.coalesce(F.try_element_at("by", k), F.lit(0))).alias("levels"))


def _fragment(grams: np.ndarray, rarity: np.ndarray, levels: np.ndarray, parts: int, span: float) -> np.ndarray:
    """The fragments of the grams of a block, whose global order is cut into ``parts`` of about the same number of grams: by rarity, and inside one degree by hash."""
    ends = np.cumsum(levels)
    rank = (ends - levels)[rarity] + levels[rarity] * (grams / span)
    return np.minimum(rank * (parts / max(ends[-1], 1)), parts - 1).astype(np.int64)


def _pairs(survivors: DataFrame, blocks: DataFrame, threshold: float, partitions: int, width: int, fragments: int) -> DataFrame:
    """(a, b, jaccard) of the keys of all pairs at the threshold."""
    buckets = max(BLOCK_FRAGMENTS, partitions)
    span = float(fragments << LOW_BITS)

    @lean
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, counts = _unpack(batch.column("grams"), width), batch.column("have").to_numpy()
            if not len(grams):
                continue
            rarity = numbers(batch.column("rarity"), np.uint8)[0]
            row = np.repeat(np.arange(len(counts)), counts)
            keys, size, block, parts = (batch.column(x).to_numpy() for x in ("key", "size", "component", "parts"))
            fragment, at = np.empty(len(grams), np.int64), 0
            levels = [None if x is None else np.array(x) for x in batch.column("levels").to_pylist()]
            for k, n in enumerate(counts):
                fragment[at : at + n] = _fragment(grams[at : at + n], rarity[at : at + n], even if levels[k] is None else levels[k], parts[k], span)
                at += n
            home = tokens.mix(block.astype(np.int64).view(U64).copy())[row]
            bucket = ((home + fragment.astype(U64)) % U64(buckets)).astype(np.int64)
            order = np.lexsort((fragment, row, bucket))
            bucket, row, grams, fragment = bucket[order], row[order], grams[order], fragment[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(bucket)]):
                here = row[lo:hi]
                begin = np.flatnonzero(np.r_[True, (here[1:] != here[:-1]) | (fragment[lo + 1 : hi] != fragment[lo : hi - 1])])
                own = here[begin]
                yield batch_of(
                    bucket=pa.array([bucket[lo]], pa.int32()), keys=binary([keys[own].astype("<i8").tobytes()]), sizes=binary([size[own].astype("<i4").tobytes()]), have=binary([counts[own].astype("<i4").tobytes()]), blocks=binary([block[own].astype("<i8").tobytes()]),
                    counts=binary([np.diff(np.r_[begin, hi - lo]).astype("<u4").tobytes()]), grams=binary([_low(grams[lo:hi], width).tobytes()]),
                )

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_bucket(batches):
            counts = numbers(rows["counts"], "<u4")[0]
            nodes, node = np.unique(numbers(rows["keys"], "<i8")[0], return_inverse=True)
            sizes, have = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
            sizes[node], have[node] = numbers(rows["sizes"], "<i4")[0], numbers(rows["have"], "<i4")[0]
            # a gram in two blocks is two grams
            grams = tokens.mix(_unpack(rows["grams"], width) ^ np.repeat(tokens.mix(numbers(rows["blocks"], "<i8")[0].view(U64).copy()), counts))
            del rows
            node = np.repeat(node.astype(np.int32), counts)
            order = np.argsort(node, kind="stable")
            for a, b, overlap in _count(node[order], sizes, have, grams[order], threshold):
                yield batch_of(a=nodes[a], b=nodes[b], sizes=sizes[a] + sizes[b], overlap=overlap)

    home = blocks.withColumnRenamed("node", "key")
    # blocks of over BLOCK_FRAGMENTS * BLOCK_GRAMS grams are cut by their own order, the others by that of them all
    large = survivors.select("key", "have").join(home, "key").groupBy("component").agg((F.sum("have") / BLOCK_GRAMS).alias("parts")).where(F.col("parts") > BLOCK_FRAGMENTS)
    large = saved(large.select("component", F.ceil("parts").cast("int").alias("parts")))
    levels = saved(_order(survivors.join(home, "key").join(large.select("component"), "component", "left_semi")))
    even = _order(survivors.select(F.lit(0).cast("long").alias("component"), "rarity")).first()  # one row of 256 numbers
    even = np.array(even.levels if even else [0] * 256)
    home = saved(home.join(large, "component", "left").join(levels, "component", "left").select("key", "component", F.coalesce("parts", F.lit(BLOCK_FRAGMENTS)).alias("parts"), "levels"))
    release(survivors.sparkSession)
    placed = survivors.join(home, "key").select("key", "size", "have", "component", "parts", "levels", "grams", "rarity")
    partial = exchange(placed.mapInArrow(split, "bucket int, keys binary, sizes binary, have binary, blocks binary, counts binary, grams binary"), buckets).mapInArrow(count, "a long, b long, sizes long, overlap long")
    total = partial.groupBy("a", "b").agg(F.sum("overlap").alias("overlap"), F.first("sizes").alias("sizes"))
    return total.select("a", "b", (F.col("overlap") / (F.col("sizes") - F.col("overlap"))).alias("jaccard")).where(F.col("jaccard") >= threshold)


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of a[k] and b[k] in ``root``, where each node points at its tree's least node."""
    while True:
        a, b = root[a], root[b]
        differ = a != b
        if not differ.any():
            return
        a, b = a[differ], b[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def _compare(unit: np.ndarray, side: np.ndarray, sizes: np.ndarray, node: np.ndarray, gram: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The near pairs (a, b) of nodes of the same unit, some at a time; nodes are in the order of unit and side.

    ``node`` and ``gram``: the grams of all nodes, by node; a gram in two units is two grams. A node of side 0 meets all others of its
    unit, one of side 1 those of side 2. Overlaps are counted in full, for some nodes with all that they may meet at once.
    """
    first = np.searchsorted(unit, unit)
    widths = np.searchsorted(unit, unit, "right") - first
    order = np.argsort(gram, kind="stable")
    node, gram = node[order], gram[order]
    begin = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]][: len(gram)])
    length = np.diff(np.r_[begin, len(gram)])
    del gram, order
    if not len(begin):
        return
    sides = side[node]
    lower = np.add.reduceat(sides != 2, begin)
    end = np.repeat(begin + length, length)
    start = np.where(sides == 0, np.arange(1, len(node) + 1), np.where(sides == 1, np.repeat(begin + lower, length), end))
    left = np.flatnonzero(end > start)
    left = left[np.argsort(node[left], kind="stable")]
    start, after, owner = start[left], (end - start)[left], node[left]
    del end, sides, left
    last = np.flatnonzero(np.r_[owner[1:] != owner[:-1], True][: len(owner)])
    pairs, cells = np.cumsum(after), np.cumsum(widths[owner[last]])
    k = lo = 0
    while k < len(last):
        k_from, k = k, max(k + 1, min(int(np.searchsorted(x, (x[at - 1] if at else 0) + COUNT_PAIRS, "right")) for x, at in ((pairs[last], k), (cells, k))))
        hi = int(last[k - 1]) + 1
        own = owner[last[k_from:k]]
        base = np.cumsum(widths[own]) - widths[own]
        n = after[lo:hi]
        met = node[np.arange(int(n.sum())) + np.repeat(start[lo:hi] - (np.cumsum(n) - n), n)]
        times = np.bincount(np.repeat((base - first[own])[np.searchsorted(own, owner[lo:hi])], n) + met, minlength=int(widths[own].sum()))
        cell = np.flatnonzero(times)
        at = np.searchsorted(base, cell, "right") - 1
        a, b, overlap = own[at], cell - base[at] + first[own[at]], times[cell]
        near = overlap / (sizes[a] + sizes[b] - overlap) >= threshold
        if near.any():
            yield a[near], b[near]
        lo = hi


def _links(survivors: DataFrame, blocks: DataFrame, threshold: float, partitions: int, width: int) -> DataFrame:
    """Rows (key, root, links), for a key as often as its block has slabs: near documents met in a slab, and one that it is connected with there (or itself)."""

    def counting(buckets: int) -> tuple:
        @lean
        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys, sizes, block, parts, other = (batch.column(x).to_numpy() for x in ("key", "size", "component", "parts", "other"))
                slab = (tokens.mix(keys.view(U64).copy()) % parts.astype(U64)).astype(np.int64)
                side = np.where(slab == other, 0, np.where(slab < other, 1, 2)).astype(np.uint8)
                unit = tokens.mix(block.view(U64) + tokens.mix((np.minimum(slab, other) << 32 | np.maximum(slab, other)).view(U64)))
                bucket = (unit % U64(buckets)).astype(np.int32)
                grams = [x.as_buffer() for x in batch.column("grams")]
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order])) + 1
                spans = [order[a:b] for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(order)])]
                counts = np.array([len(x) // width for x in grams], "<u4")
                fixed = (("keys", keys), ("sizes", sizes), ("units", unit), ("sides", side), ("counts", counts))
                yield batch_of(bucket=bucket[[x[0] for x in spans]], **{k: binary(v[x].tobytes() for x in spans) for k, v in fixed}, grams=binary(b"".join(grams[i] for i in x) for x in spans))

        @lean
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, rows in by_bucket(batches):
                keys, sizes, unit, side = (numbers(rows[k], kind)[0] for k, kind in (("keys", "<i8"), ("sizes", "<i4"), ("units", "<u8"), ("sides", np.uint8)))
                counts, grams = numbers(rows["counts"], "<u4")[0], _unpack(rows["grams"], width)
                del rows
                grams = tokens.mix(grams ^ np.repeat(tokens.mix(unit.copy()), counts))
                order = np.lexsort((keys, side, unit))
                keys, sizes, unit, side = keys[order], sizes[order].astype(np.int64), unit[order], side[order]
                place = np.empty(len(order), np.int32)
                place[order] = np.arange(len(order))
                node = np.repeat(place, counts)
                order = np.argsort(node, kind="stable")
                node, grams = node[order], grams[order]
                root, links = np.arange(len(keys)), np.zeros(len(keys), np.int64)
                for a, b in _compare(unit, side, sizes, node, grams, threshold):
                    links += np.bincount(a, minlength=len(keys)) + np.bincount(b, minlength=len(keys))
                    _unite(root, a, b)
                found = np.flatnonzero(links)
                if len(found):
                    yield batch_of(key=keys[found], root=keys[root[found]], links=links[found])

        return split, count

    home = blocks.withColumnRenamed("node", "key")
    sums = survivors.select("key", "have").join(home, "key").groupBy("component").agg(F.sum("have").alias("total"))
    parts = F.greatest(F.ceil(F.col("total") / SLAB_MOST), F.least(F.ceil(F.col("total") / SLAB_GRAMS), F.lit(SLABS)))
    sums = saved(sums.select("component", "total", parts.cast("int").alias("parts")))
    moved = sums.agg(F.sum(F.col("total") * F.col("parts"))).first()[0] or 0
    buckets = max(partitions, math.ceil(moved / SLAB_GRAMS))
    split, count = counting(buckets)
    placed = survivors.join(saved(home.join(sums.select("component", "parts"), "component")), "key").select("key", "size", "component", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"), "grams")
    return exchange(placed.mapInArrow(split, "bucket int, keys binary, sizes binary, units binary, sides binary, counts binary, grams binary"), min(buckets, partitions * 4)).mapInArrow(count, "key long, root long, links long")


def _partitions(df: DataFrame, fragments: int) -> int:
    return min(fragments, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1) * 4)


def _blocks(docs: DataFrame, n: int, threshold: float) -> tuple:
    """(doc_id, key) of all documents with words, those that may have partners, the blocks (node, component) they form, and the numbers of partitions, of bytes a gram and of fragments."""
    spark = docs.sparkSession
    keys = saved(document_keys(docs, n))
    total = keys.agg(F.sum("grams")).first()[0] or 0
    fragments = min(max(math.ceil(total / FRAGMENT_GRAMS), spark.sparkContext.defaultParallelism, 1), 1 << 22)
    partitions, width = _partitions(docs, fragments), _width(fragments)

    def gather() -> DataFrame:
        shared = _shared_grams(exchange(_fragments(docs, n, fragments), partitions), fragments)
        return saved(_survivors(exchange(shared, partitions), threshold, width))

    survivors = gather()
    release(spark)
    return keys.select("doc_id", "key"), survivors, components(_prefix_edges(survivors, threshold, partitions, width)), partitions, width, fragments


def key_pairs(docs: DataFrame, n: int = GRAM, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) of all documents with words, and the pairs (a, b, jaccard) of different keys at the threshold."""
    keys, survivors, blocks, partitions, width, fragments = _blocks(docs, n, threshold)
    return keys, saved(_pairs(survivors, blocks, threshold, partitions, width, fragments))


def key_classes(docs: DataFrame, n: int = GRAM, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, key) of all documents with words; of the keys in a pair at the threshold, their class (node, component) and in how many pairs they are (key, links). The pairs are not listed."""
    keys, survivors, blocks, partitions, width, _ = _blocks(docs, n, threshold)
    found = saved(_links(survivors, blocks, threshold, partitions, width))
    release(docs.sparkSession)
    return keys, components(found.select(F.col("root").alias("a"), F.col("key").alias("b"))), found.groupBy("key").agg(F.sum("links").alias("links"))


def _check(n: int, threshold: float) -> None:
    if not 0 < threshold <= 1 or n < 1:
        raise ValueError("threshold must be in (0, 1] and n at least 1")


def ngram_join(docs: DataFrame, n: int = GRAM, threshold: float = THRESHOLD) -> DataFrame:
    """Near-duplicate pairs (doc_a, doc_b, jaccard), doc_a < doc_b, with jaccard >= threshold.

    Documents with the same word sequence are represented by the least doc_id among them: each other one comes once, paired
    with it at jaccard 1. Pairs between different word sequences come once, between the representatives. So every pair of
    documents follows from the rows, whose number does not grow with the square of the number of exact copies.

    A text of fewer than ``n`` words is the set of one gram, all its words. Null texts and texts without words, and null
    doc_ids, are in no pair. Rows that repeat a doc_id count as one document if their texts agree, else the rows' texts are
    compared like those of different documents and a pair of a doc_id with itself is left out. Other columns are ignored.
    An empty table gives an empty result. Ties in the gram order are broken by hash and never change the result.
    """
    _check(n, threshold)
    keys, pairs = key_pairs(docs.where("doc_id IS NOT NULL"), n, threshold)
    least = saved(keys.groupBy("key").agg(F.min("doc_id").alias("rep")))
    copies = keys.distinct().join(least, "key").where("doc_id > rep").select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    left, right = (least.select(F.col("key").alias(k), F.col("rep").alias(r)) for k, r in (("a", "ra"), ("b", "rb")))
    near = pairs.join(left, "a").join(right, "b").where("ra <> rb").select(F.least("ra", "rb").alias("doc_a"), F.greatest("ra", "rb").alias("doc_b"), "jaccard")
    return copies.unionByName(near)


def near_duplicates(docs: DataFrame, n: int = GRAM, threshold: float = THRESHOLD) -> DataFrame:
    """Near-duplicate classes: one row (doc_id, class_id, copies, links) per document.

    class_id is the least doc_id of those that are connected by links, that is by the pairs of ``ngram_join``: documents with
    the same words, or with different words at jaccard >= threshold. copies is the number of documents with the same words,
    itself included; links is the number of different texts that its text is near. So the rows are as many as the documents,
    and no link between two texts is left out.

    Documents without words (null or empty texts) are alone, as one copy without links. Null doc_ids are left out. A doc_id
    with several texts has a row for each of them that differs in its words. Texts of fewer than ``n`` words, ties and empty
    tables are as in ``ngram_join``; other columns are ignored. doc_id must be a number, or text that reads as one.
    """
    _check(n, threshold)
    docs = docs.where("doc_id IS NOT NULL")
    keys, classes, links = key_classes(docs, n, threshold)
    documents_ = saved(keys.distinct())
    texts = documents_.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    near = saved(texts.join(classes.withColumnRenamed("node", "key"), "key").join(links, "key"))
    least = near.groupBy("component").agg(F.min("rep").alias("class_id"))
    near = near.join(least, "component").select("key", "class_id", "links")
    judged = texts.join(near, "key", "left").select("key", F.coalesce("class_id", "rep").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    worded = documents_.join(judged, "key").select("doc_id", "class_id", "copies", "links")
    bare = _with_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "h_key").where("h_key = 0").select("doc_id").distinct()
    return worded.unionByName(bare.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("links")))


def _with_key(docs: DataFrame, name: str) -> DataFrame:
    """Adds the key of each row's word sequence (0: no words)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.concatenate([np.zeros(0, U64)] + [x[-1] for x in hashed(batch)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.view(np.int64))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *StructType.fromDDL(f"{name} long").fields]))


def deduplicate(docs: DataFrame, n: int = GRAM, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with one of each group of near duplicates: the one with the least doc_id in its connected component of ``ngram_join``.

    Rows of one doc_id with different words are different documents; of those that are near duplicates of each other, one
    stays. So it is for rows with a null doc_id, which stay only if their component has no doc_id. Of rows that repeat a doc_id
    (or null) with the same words, one stays. Documents without words all stay. Columns are those of the input. An empty table
    gives an empty result. doc_id must be a number, or text that reads as one, or null.
    """
    keys, groups, _ = key_classes(docs, n, threshold)
    grouped = keys.join(groups.withColumnRenamed("node", "key"), "key", "left").select("doc_id", "key", F.coalesce("component", "key").alias("component"))
    # a document that goes: not the least of its component; so few that the texts need not be moved to find them
    own = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    gone = grouped.join(grouped.groupBy("component").agg(F.min(own).alias("rep")), "component").where(own != F.col("rep"))
    repeated = saved(docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).count().where("count > 1 OR doc_id IS NULL").select("doc_id"))
    if repeated.isEmpty():
        return docs.join(saved(gone.select("doc_id").distinct()), "doc_id", "left_anti").select(*docs.columns)
    gone = saved(gone.select("doc_id", "key").distinct())
    once = docs.where("doc_id IS NOT NULL").join(repeated, "doc_id", "left_anti").join(gone, "doc_id", "left_anti").select(*docs.columns)
    # a doc_id does not tell these rows apart: they go by their words, too
    more = docs.where("doc_id IS NULL").unionByName(docs.join(repeated, "doc_id", "left_semi").select(*docs.columns))
    more = _with_key(more, "h_key")
    worded = more.where("h_key <> 0").dropDuplicates(["doc_id", "h_key"])
    left = gone.select(F.col("doc_id").alias("h_id"), F.col("key").alias("h_gone"))
    worded = worded.join(left, F.col("doc_id").cast("long").eqNullSafe(F.col("h_id")) & (F.col("h_key") == F.col("h_gone")), "left_anti")
    return once.unionByName(worded.select(*docs.columns)).unionByName(more.where("h_key = 0").select(*docs.columns))
