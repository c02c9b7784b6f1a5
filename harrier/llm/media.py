"""Media columns of baseline JPEG images.

Markers are parsed per image; the entropy-coded scans (restart intervals) of all images of a batch are then Huffman-decoded
side by side in numpy, one DC code or a few AC codes of each per step. AC coefficients are only skipped: a block's DC
coefficient is its mean, so the luminance DCs are the picture at an eighth of its size.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import binary, lean, without

#: Coded bytes of the images that are decoded side by side; a larger image is decoded alone.
TOGETHER_BYTES = 4 << 20
#: Images of a batch that are read at a time.
TOGETHER = 2048
#: Intervals left at which they are decoded one after the other.
FEW = 40
HASH_SIDE = 8

OUT_SCHEMA = "media_status string, media_width int, media_height int, media_components int, thumb_width int, thumb_height int, thumbnail binary, thumb_hash string"


@dataclass
class Header:
    status: str = "ok"
    width: int | None = None
    height: int | None = None
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantisation table
    quant: dict[int, int] = field(default_factory=dict)  # table: DC step
    huff: dict[tuple[int, int], bytes] = field(default_factory=dict)  # (class, id): the 16 counts and the symbols
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component's place, DC table, AC table
    restart: int = 0
    data: np.ndarray | None = None  # entropy-coded bytes without stuffing
    restarts: np.ndarray | None = None  # where, in those, each restart interval begins


def parse(raw: bytes | None) -> Header:
    """The markers up to the first scan that holds luminance. ``status`` says why an image cannot be decoded."""
    head = Header()

    def bad(why: str) -> Header:
        head.status = why
        return head

    if raw is None:
        return bad("null")
    if not raw:
        return bad("empty")
    if raw[:2] != b"\xff\xd8":
        return bad("not a JPEG")
    at = 2
    while True:
        while at < len(raw) and raw[at] != 0xFF:
            at += 1
        while at < len(raw) and raw[at] == 0xFF:
            at += 1
        if at >= len(raw):
            return bad("truncated: no scan")
        marker = raw[at]
        at += 1
        if marker == 0xD9:
            return bad("truncated: no scan")
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:
            continue
        if at + 2 > len(raw):
            return bad("truncated: segment")
        size = int.from_bytes(raw[at : at + 2], "big")
        body = raw[at + 2 : at + size]
        if size < 2 or len(body) < size - 2:
            return bad("truncated: segment")
        at += size
        try:
            if marker == 0xDB:
                k = 0
                while k < len(body):
                    wide, number = body[k] >> 4, body[k] & 15
                    head.quant[number] = int.from_bytes(body[k + 1 : k + 3], "big") if wide else body[k + 1]
                    k += 1 + 64 * (2 if wide else 1)
            elif marker == 0xC4:
                k = 0
                while k < len(body):
                    n = sum(body[k + 1 : k + 17])
                    head.huff[body[k] >> 4, body[k] & 15] = bytes(body[k + 1 : k + 17 + n])
                    k += 17 + n
            elif marker == 0xDD:
                head.restart = int.from_bytes(body[:2], "big")
            elif marker in (0xC0, 0xC1):
                if body[0] != 8:
                    return bad("unsupported: not 8 bits")
                head.height, head.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                head.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
                if not head.width or not head.height or not head.components or any(not 1 <= x <= 4 for c in head.components for x in c[1:3]):
                    return bad("corrupt: frame")
            elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
                head.height, head.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                return bad("unsupported: not baseline")
            elif marker == 0xDA:
                ids = [c[0] for c in head.components]
                head.scan = [(ids.index(body[1 + 2 * k]), body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
                if not head.components:
                    return bad("corrupt: scan before frame")
                if all(c != 0 for c, _, _ in head.scan):
                    continue  # a scan of colour only
                if any((0, d) not in head.huff or (1, a) not in head.huff for _, d, a in head.scan) or head.components[0][3] not in head.quant:
                    return bad("corrupt: a table is missing")
                break
        except (IndexError, ValueError):
            return bad("corrupt: segment")
    coded = np.frombuffer(raw, np.uint8)[at:]
    ff = np.flatnonzero(coded[:-1] == 0xFF) if len(coded) else np.zeros(0, np.int64)
    after = coded[ff + 1]
    stops = ff[(after != 0) & ~((after >= 0xD0) & (after <= 0xD7)) & (after != 0xFF)]
    end = int(stops[0]) if len(stops) else len(coded)
    ff, after = ff[ff < end], after[ff < end]
    keep = np.ones(end, bool)
    keep[ff[after == 0] + 1 - (ff[after == 0] + 1 >= end)] = False
    marks = ff[(after >= 0xD0) & (after <= 0xD7)]
    keep[marks] = False
    keep[np.minimum(marks + 1, end - 1)] = False
    head.data = coded[:end][keep]
    head.restarts = np.concatenate([[0], np.cumsum(keep)[marks]]) if end else np.zeros(1, np.int64)
    return head


_tables: dict[bytes, tuple] = {}


def _codes_table(spec: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For every 16 bits that may follow: the code's length (0: no code) and its symbol."""
    length, symbol, at, k = np.zeros(65536, np.int64), np.zeros(65536, np.int64), 0, 16
    for bits in range(1, 17):
        for _ in range(spec[bits - 1]):
            if k < len(spec) and at < 65536:
                length[at : at + (1 << (16 - bits))] = bits
                symbol[at : at + (1 << (16 - bits))] = spec[k]
            at += 1 << (16 - bits)
            k += 1
    return length, symbol


#: Fields of an AC table's entry: bits to pass, coefficients to pass, and whether the block ends. 0: no code.
_ADVANCE, _ENDS = 8, 1 << 16


def _dc_table(spec: bytes) -> tuple[np.ndarray, array]:
    """Length << 8 | bits of the difference; 0 where there is no code."""
    if (key := b"d" + spec) not in _tables:
        length, symbol = _codes_table(spec)
        table = np.where((length > 0) & (symbol <= 11), length << 8 | symbol, 0)
        _remember(key, (table, array("l", table.tolist())))
    return _tables[key]


def _ac_table(spec: bytes) -> tuple[np.ndarray, array]:
    """Two tables, one after the other: what the next code does, and what all codes do that lie in the 16 bits as a whole."""
    if (key := b"a" + spec) not in _tables:
        length, symbol = _codes_table(spec)
        run, size = symbol >> 4, symbol & 15
        bits = np.where(length > 0, length + size, 0)
        moves = np.where(size > 0, run + 1, np.where(run == 15, 16, 0))
        ends = (length > 0) & (size == 0) & (run != 15)
        single = np.where(length > 0, bits | moves << _ADVANCE | np.where(ends, _ENDS, 0), 0)
        total, far, over = bits.copy(), moves.copy(), ends.copy()
        peek = np.arange(65536)
        for _ in range(7):
            after = (peek << np.minimum(total, 16)) & 0xFFFF
            more = (length > 0) & ~over & (total < 16) & (length[after] > 0) & (length[after] <= 16 - total)
            far = np.where(more, far + moves[after], far)
            over |= more & ends[after]
            total = np.where(more, total + bits[after], total)
        multi = np.where(length > 0, total | far << _ADVANCE | np.where(over, _ENDS, 0), 0)
        table = np.concatenate([single, multi])
        _remember(key, (table, array("l", table.tolist())))
    return _tables[key]


def _remember(key: bytes, made: tuple) -> None:
    if len(_tables) > 64:
        _tables.clear()
    _tables[key] = made


@dataclass
class Plan:
    """How an image's scan is laid out."""

    slots: list[int]  # per block of a unit, the component's place in the scan
    units: int
    across: int
    down: int
    luma: int
    shape: tuple[int, int]  # luminance blocks of a unit: across, down

    @property
    def blocks(self) -> int:
        return self.units * len(self.slots)


def plan(head: Header) -> Plan:
    hs, vs = max(c[1] for c in head.components), max(c[2] for c in head.components)
    luma = next(k for k, (c, _, _) in enumerate(head.scan) if c == 0)
    if len(head.scan) == 1:  # blocks of one component in plain order
        _, h, v, _ = head.components[0]
        across, down = -(-(-(-head.width * h // hs)) // 8), -(-(-(-head.height * v // vs)) // 8)
        return Plan([0], across * down, across, down, luma, (1, 1))
    across, down = -(-head.width // (8 * hs)), -(-head.height // (8 * vs))
    slots = [k for k, (c, _, _) in enumerate(head.scan) for _ in range(head.components[c][1] * head.components[c][2])]
    return Plan(slots, across * down, across, down, luma, head.components[0][1:3])


def decode_dc(heads: list[Header]) -> list[np.ndarray | None]:
    """Luminance DC coefficients (rows by columns of blocks) of parsed images; None where the scan breaks off or has a code that is not in its table.

    Restart intervals are decoded side by side, whatever image they are of. When few of them are left, as of one large
    picture, they are decoded one after the other.
    """
    plans = [plan(h) for h in heads]
    out_at = np.cumsum([0] + [p.units * p.shape[0] * p.shape[1] for p in plans])
    out = np.zeros(out_at[-1], np.int32)
    failed = np.zeros(len(heads), bool)
    dc_specs: dict[bytes, int] = {}
    ac_specs: dict[bytes, int] = {}
    width, most = max(len(h.scan) for h in heads), max(len(p.slots) for p in plans)
    slots = np.zeros((len(heads), most), np.int64)
    dc_of, ac_of = np.zeros((len(heads), width), np.int64), np.zeros((len(heads), width), np.int64)
    base = np.cumsum([0] + [len(h.data) for h in heads])
    lanes: list[tuple[int, int, int, int, int]] = []  # image, first bit, last bit, blocks, place in the output
    for k, (head, p) in enumerate(zip(heads, plans)):
        slots[k, : len(p.slots)] = p.slots
        for j, (_, d, a) in enumerate(head.scan):
            dc_of[k, j] = dc_specs.setdefault(head.huff[0, d], len(dc_specs))
            ac_of[k, j] = ac_specs.setdefault(head.huff[1, a], len(ac_specs))
        every = head.restart or p.units
        intervals = -(-p.units // every)
        starts = head.restarts[:intervals] if head.restart else np.zeros(1, np.int64)
        if len(starts) < intervals:
            failed[k] = True
            continue
        ends = np.append(starts[1:], len(head.data) if intervals == len(head.restarts) or not head.restart else head.restarts[intervals])
        luma = p.shape[0] * p.shape[1]
        lanes += [(k, 8 * int(base[k] + a), 8 * int(base[k] + b), min(every, p.units - j * every) * len(p.slots), int(out_at[k]) + j * every * luma) for j, (a, b) in enumerate(zip(starts, ends))]
    if lanes:
        own = np.array(lanes, np.int64)
        stream = np.concatenate([*(h.data for h in heads), np.zeros(16, np.uint8)])
        tables = np.concatenate([_dc_table(s)[0] for s in dc_specs] + [_ac_table(s)[0] for s in ac_specs])
        scalar = [_dc_table(s)[1] for s in dc_specs], [_ac_table(s)[1] for s in ac_specs]
        _decode_lanes(own, stream, tables, scalar, slots, np.array([len(p.slots) for p in plans]), np.array([p.luma for p in plans]), dc_of, ac_of, out, failed)
    pictures: list[np.ndarray | None] = []
    for k, p in enumerate(plans):
        h, v = p.shape
        pictures.append(None if failed[k] else out[out_at[k] : out_at[k + 1]].reshape(p.down, p.across, v, h).transpose(0, 2, 1, 3).reshape(p.down * v, p.across * h))
    return pictures


def _decode_lanes(
    lanes: np.ndarray, stream: np.ndarray, tables: np.ndarray, scalar: tuple[list[array], list[array]], slots: np.ndarray, per_unit: np.ndarray, luma_of: np.ndarray, dc_of: np.ndarray, ac_of: np.ndarray, out: np.ndarray, failed: np.ndarray
) -> None:
    words = np.ndarray(len(stream) - 8, ">u8", stream, strides=(1,))  # the 8 bytes from each place on
    image, place, ends, todo, written = (lanes[:, k].copy() for k in range(5))
    block, coefficient = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64)
    before = np.zeros((len(lanes), dc_of.shape[1]), np.int64)
    ac_at = 65536 * len(scalar[0])
    live = np.flatnonzero((todo > 0) & ~failed[image])
    while len(live) > FEW:
        at = place[live]
        word = words[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)
        peek = (word >> np.uint64(48)).astype(np.int64)
        own, start = image[live], coefficient[live]
        component = slots[own, block[live] % per_unit[own]]
        first = start == 0
        table = ac_at + 131072 * ac_of[own, component]
        many = tables[table + 65536 + peek]
        code = np.where(first, tables[65536 * dc_of[own, component] + peek], np.where(start + (many >> _ADVANCE & 255) < 64, many, tables[table + peek]))
        wrong = code == 0
        # the first coefficient: its value is the difference to the block before
        f = np.flatnonzero(first & ~wrong)
        length, size = code[f] >> 8, code[f] & 255
        value = ((word[f] << length.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
        value = np.where((size > 0) & (value < (1 << np.maximum(size - 1, 0))), value - (1 << size) + 1, value)
        here, comp = live[f], component[f]
        before[here, comp] += value
        luma = comp == luma_of[own[f]]
        out[written[here[luma]]] = before[here[luma], comp[luma]]
        written[here[luma]] += 1
        bits = np.where(first, (code >> 8) + (code & 255), code & 255)
        onward = np.where(first, 1, start + (code >> _ADVANCE & 255))
        done = ~first & ((code & _ENDS > 0) | (onward == 64))
        at = at + bits
        wrong |= (at > ends[live]) | (onward > 64)
        place[live] = at
        coefficient[live] = np.where(done, 0, onward)
        block[live] += done
        if wrong.any() or done.any():
            failed[own[wrong]] = True
            live = live[~failed[own] & (block[live] < todo[live])]
    for lane in live.tolist():
        k = int(image[lane])
        if not failed[k]:
            state = int(place[lane]), int(ends[lane]), int(block[lane]), int(todo[lane]), int(coefficient[lane]), before[lane].tolist()
            n = int(per_unit[k])
            failed[k] = not _decode_one(stream, *state, slots[k, :n].tolist(), int(luma_of[k]), [scalar[0][x] for x in dc_of[k]], [scalar[1][x] for x in ac_of[k]], out, int(written[lane]))


def _decode_one(stream: np.ndarray, place: int, end: int, block: int, todo: int, coefficient: int, before: list[int], slots: list[int], luma: int, dc: list[array], ac: list[array], out: np.ndarray, written: int) -> bool:
    """One interval from a given state on; whether it could be decoded."""
    raw = memoryview(stream[: (end >> 3) + 16])
    word_of, found, n = int.from_bytes, [], len(slots)
    while block < todo:
        component = slots[block % n]
        if not coefficient:
            word = word_of(raw[place >> 3 : (place >> 3) + 6], "big") << (place & 7) & 0xFFFFFFFFFFFF
            code = dc[component][word >> 32]
            if not code:
                return False
            length, size = code >> 8, code & 255
            if size:
                value = word >> (48 - length - size) & ((1 << size) - 1)
                before[component] += value if value >> (size - 1) else value - (1 << size) + 1
            place += length + size
            if component == luma:
                found.append(before[component])
            coefficient = 1
        table = ac[component]
        while True:
            peek = word_of(raw[place >> 3 : (place >> 3) + 3], "big") << (place & 7) >> 8 & 0xFFFF
            code = table[65536 + peek]
            if coefficient + (code >> 8 & 255) >= 64:
                code = table[peek]
            if not code:
                return False
            place += code & 255
            coefficient += code >> 8 & 255
            if code & 65536 or coefficient >= 64:
                break
            if place > end:
                return False
        if coefficient > 64 or place > end:
            return False
        coefficient = 0
        block += 1
    out[written : written + len(found)] = found
    return True


def thumbnails(raws: list[bytes | None]) -> list[tuple]:
    """(status, width, height, components, thumb width, thumb height, thumbnail, hash) of each image. The thumbnail has a byte of luminance per 8 x 8 block, by rows."""
    heads = [parse(r) for r in raws]
    for head in heads:
        # a block takes two codes of a bit at least: more blocks than that are claimed, not there
        if head.status == "ok" and plan(head).blocks > 4 * len(head.data):
            head.status = "corrupt: scan"
    out: list[tuple] = [(h.status, h.width, h.height, len(h.components) or None, None, None, None, None) for h in heads]
    some: list[int] = []
    held = 0
    for k, head in [*enumerate(heads), (-1, None)]:
        if some and (head is None or head.status == "ok" and held + len(head.data) > TOGETHER_BYTES):
            for j, dc in zip(some, decode_dc([heads[x] for x in some])):
                out[j] = _row(heads[j], dc)
                heads[j].data = None
            some, held = [], 0
        if head is not None and head.status == "ok":
            some.append(k)
            held += len(head.data)
    return out


def _row(head: Header, dc: np.ndarray | None) -> tuple:
    if dc is None:
        return "corrupt: scan", head.width, head.height, len(head.components), None, None, None, None
    hs, vs = max(c[1] for c in head.components), max(c[2] for c in head.components)
    _, h, v, q = head.components[0]
    wide, high = -(-(-(-head.width * h // hs)) // 8), -(-(-(-head.height * v // vs)) // 8)
    light = np.clip(np.rint(dc[:high, :wide] * head.quant[q] / 8 + 128), 0, 255).astype(np.uint8)
    return "ok", head.width, head.height, len(head.components), wide, high, light.tobytes(), thumbnail_hash(light)


def thumbnail_hash(light: np.ndarray) -> str:
    """64 bits in hexadecimal: the thumbnail averaged to 8 x 8, each cell against the mean of all."""
    high, wide = light.shape
    sums = np.zeros((high + 1, wide + 1))
    sums[1:, 1:] = light.astype(np.float64).cumsum(0).cumsum(1)
    y0, x0 = np.arange(HASH_SIDE) * high // HASH_SIDE, np.arange(HASH_SIDE) * wide // HASH_SIDE
    y1, x1 = np.maximum((np.arange(HASH_SIDE) + 1) * high // HASH_SIDE, y0 + 1), np.maximum((np.arange(HASH_SIDE) + 1) * wide // HASH_SIDE, x0 + 1)
    cells = (sums[y1][:, x1] - sums[y0][:, x1] - sums[y1][:, x0] + sums[y0][:, x0]) / ((y1 - y0)[:, None] * (x1 - x0))
    return np.packbits(cells > cells.mean() + 1e-9).tobytes().hex()


def media_columns(images: DataFrame, column: str = "image") -> DataFrame:
    """Adds media_status, media_width, media_height, media_components, thumb_width, thumb_height, thumbnail and thumb_hash to a table with a binary column of JPEG files, and drops that column.

    media_status is "ok" or says why there is no thumbnail: null, empty, not a JPEG, truncated, corrupt, or unsupported (not
    baseline, not 8 bits); the dimensions are given as far as they could be read. An image that claims more blocks than its
    bytes can hold is corrupt; memory follows the bytes that are there, and no image is too large. Equal images have equal
    results; every row is decoded on its own, repeated ones too, and other columns stay. Input columns of the added names are
    replaced; an empty table gives an empty result.
    """
    added = StructType.fromDDL(OUT_SCHEMA)
    images = without(images, added.names)
    kept = [c for c in images.columns if c != column]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(lo, TOGETHER)
                rows = thumbnails(part.column(column).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=[*kept, *added.names])

    return images.mapInArrow(run, StructType([*(f for f in images.schema.fields if f.name != column), *added.fields]))


# --- pictures of pages


_ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, (k % 8 if (k // 8 + k % 8) % 2 == 0 else k // 8))))
_QUANT = np.array([16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99])
_DC_SPEC = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, *range(12)])
#: The usual AC table for luminance (ITU T.81, table K.5).
_AC_SYMBOLS = bytes.fromhex("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa")
_AC_SPEC = bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 0x7D]) + _AC_SYMBOLS
_BASIS = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def _codes(spec: bytes) -> dict[int, tuple[int, int]]:
    out, code, k = {}, 0, 16
    for length in range(1, 17):
        for _ in range(spec[length - 1]):
            out[spec[k]] = code, length
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _arrays(spec: bytes) -> tuple[np.ndarray, np.ndarray]:
    codes, lengths = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for symbol, (code, length) in _codes(spec).items():
        codes[symbol], lengths[symbol] = code, length
    return codes, lengths


_DC_CODES, _AC_CODES = _arrays(_DC_SPEC), _arrays(_AC_SPEC)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(x).astype(np.float64))[1]


def encode_grey(pictures: list[np.ndarray], restart: int = 0) -> list[bytes]:
    """Grey baseline JPEGs of pictures (rows by columns of pixels), for test data; with a restart marker every ``restart`` blocks."""
    if not pictures:
        return []
    parts = []
    for pixels in pictures:
        high, wide = pixels.shape
        padded = np.pad(pixels, ((0, -high % 8), (0, -wide % 8)), mode="edge").astype(np.float64) - 128
        parts.append(padded.reshape(padded.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8))
    counts = np.array([len(p) for p in parts])
    levels = np.rint((_BASIS @ np.concatenate(parts) @ _BASIS.T).reshape(-1, 64) / _QUANT).astype(np.int64)[:, _ZIGZAG]
    within = np.arange(len(levels)) - np.repeat(np.cumsum(counts) - counts, counts)
    fresh = within % restart == 0 if restart else within == 0  # blocks that begin an interval
    interval = np.cumsum(fresh) - 1
    # tokens: (block, order in the block), the bits and how many they are
    step = np.where(fresh, levels[:, 0], levels[:, 0] - np.r_[0, levels[:-1, 0]])
    size = _bit_length(step)
    blocks, orders = [np.arange(len(levels))], [np.zeros(len(levels), np.int64)]
    bits, sizes = [_DC_CODES[0][size] << size | np.where(step > 0, step, step + (1 << size) - 1) * (size > 0)], [_DC_CODES[1][size] + size]
    block, at = np.nonzero(levels[:, 1:])
    value = levels[block, at + 1]
    gap = at - np.where(np.r_[True, block[1:] != block[:-1]], -1, np.r_[-1, at[:-1]]) - 1
    size = _bit_length(value)
    symbol = (gap & 15) << 4 | size
    blocks.append(block)
    orders.append(2 * at + 3)
    bits.append(_AC_CODES[0][symbol] << size | np.where(value > 0, value, value + (1 << size) - 1))
    sizes.append(_AC_CODES[1][symbol] + size)
    far = gap >> 4
    blocks.append(np.repeat(block, far))
    orders.append(np.repeat(2 * at + 2, far))
    bits.append(np.full(far.sum(), _AC_CODES[0][0xF0]))
    sizes.append(np.full(far.sum(), _AC_CODES[1][0xF0]))
    short = np.flatnonzero(levels[:, 63] == 0)
    blocks.append(short)
    orders.append(np.full(len(short), 255))
    bits.append(np.full(len(short), _AC_CODES[0][0]))
    sizes.append(np.full(len(short), _AC_CODES[1][0]))
    blocks_, bits_, sizes_ = np.concatenate(blocks), np.concatenate(bits), np.concatenate(sizes)
    order = np.argsort(blocks_ * 256 + np.concatenate(orders), kind="stable")
    blocks_, bits_, sizes_ = blocks_[order], bits_[order], sizes_[order]
    # every interval starts on a byte and is filled up with ones
    total = np.bincount(interval[blocks_], sizes_, interval[-1] + 1).astype(np.int64)
    starts = np.cumsum(-(-total // 8)) - -(-total // 8)
    ends = np.cumsum(sizes_)
    place = ends - sizes_ - np.repeat(np.cumsum(total) - total, np.bincount(interval[blocks_])) + 8 * starts[interval[blocks_]]
    flat = np.ones(8 * int(starts[-1] + -(-total[-1] // 8)), np.uint8)
    k = np.arange(int(sizes_.sum())) - np.repeat(ends - sizes_, sizes_)
    flat[np.repeat(place, sizes_) + k] = np.repeat(bits_, sizes_) >> (np.repeat(sizes_, sizes_) - 1 - k) & 1
    packed = np.packbits(flat).tobytes()
    firsts = interval[np.cumsum(counts) - counts]
    lasts = np.r_[firsts[1:], interval[-1] + 1]
    bounds = np.r_[starts, len(packed)]
    tables = _segment(0xC4, b"\0" + _DC_SPEC) + _segment(0xC4, b"\x10" + _AC_SPEC) + (_segment(0xDD, restart.to_bytes(2, "big")) if restart else b"") + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    lead = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0") + _segment(0xDB, b"\0" + bytes(_QUANT[_ZIGZAG].astype(np.uint8)))
    out = []
    for pixels, a, b in zip(pictures, firsts, lasts):
        scan = b"".join((bytes([0xFF, 0xD0 + (j - a - 1) % 8]) if j > a else b"") + packed[bounds[j] : bounds[j + 1]].replace(b"\xff", b"\xff\0") for j in range(a, b))
        frame = _segment(0xC0, bytes([8]) + pixels.shape[0].to_bytes(2, "big") + pixels.shape[1].to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))
        out.append(lead + frame + tables + scan + b"\xff\xd9")
    return out


def page_pictures(pages: DataFrame) -> DataFrame:
    """(page_id, image): a grey baseline JPEG of every page, since the tables have no images: a pixel for each of the page's bytes, in about a square. Pages without bytes have a null image."""

    def picture(html: str) -> np.ndarray:
        raw = np.frombuffer(html.encode(), np.uint8)
        wide = 8 * -(-math.isqrt(len(raw)) // 8) or 8
        return np.concatenate([raw, np.full(-len(raw) % wide, raw[-1])]).reshape(-1, wide)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                part = batch.slice(lo, 100)
                pages_ = part.column("html").to_pylist()
                made = iter(encode_grey([picture(x) for x in pages_ if x]))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), binary(next(made) if x else None for x in pages_)], names=["page_id", "image"])

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, "page_id long, image binary")
