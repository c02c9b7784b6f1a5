"""WARC transactions.

A capture is kept as separate records: the response, the request that asked for it, metadata about it. Records name each other
by WARC-Concurrent-To, in either direction and perhaps through others. ``assemble`` finds the transaction every record belongs
to on the identifiers alone and moves each payload once, to its capture's row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, components, lean, saved

RECORD_SCHEMA = "record_id string, record_type string, concurrent_to array<string>, target_uri string, date string, content_type string, http_head string, payload binary, block_digest string, truncated boolean"
CAPTURE_SCHEMA = (
    "capture_id string, target_uri string, date string, "
    "request struct<record_id:string,method:string,head:string,payload:binary>, "
    "response struct<record_id:string,status:int,content_type:string,head:string,payload:binary,digest:string,truncated:boolean>, "
    "metadata array<struct<record_id:string,content_type:string,fields:map<string,string>>>, n_records int"
)


def page_records(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` as WARC bytes, three records a page: column ``warc``.

    A null url or html is an empty one.
    """

    def crlf(*lines: F.Column | str) -> F.Column:
        return F.concat(*[F.concat(F.lit(x) if isinstance(x, str) else x, F.lit("\r\n")) for x in lines])

    url, html = F.coalesce(F.col("url"), F.lit("")), F.coalesce(F.col("html"), F.lit(""))
    host = F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1)
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))

    def identity(kind: str) -> F.Column:
        h = F.md5(F.concat_ws("/", F.lit(kind), name, url))
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))

    date = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce(F.col("page_id"), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")

    def record(kind: str, content_type: str, block: F.Column, to: F.Column | None) -> F.Column:
        lines = ["WARC/1.0", F.concat(F.lit("WARC-Type: "), F.lit(kind)), F.concat(F.lit("WARC-Record-ID: "), identity(kind)), F.concat(F.lit("WARC-Date: "), date), F.concat(F.lit("WARC-Target-URI: "), url)]
        if to is not None:
            lines.append(F.concat(F.lit("WARC-Concurrent-To: "), to))
        lines += [f"Content-Type: {content_type}", F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")), ""]
        return F.concat(crlf(*lines), block, F.lit("\r\n\r\n"))

    asked = crlf(F.concat(F.lit("GET "), F.coalesce(F.nullif(F.regexp_replace(url, r"^[a-z]+://[^/?#]*|#.*$", ""), F.lit("")), F.lit("/")), F.lit(" HTTP/1.1")), F.concat(F.lit("Host: "), host), "Accept: text/html", "")
    answered = F.concat(crlf("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", F.concat(F.lit("Content-Length: "), F.octet_length(html).cast("string")), ""), html)
    said = crlf(F.concat(F.lit("fetchTimeMs: "), F.pmod(F.xxhash64(name), F.lit(900)).cast("string")), F.concat(F.lit("pageId: "), name))
    warc = F.concat(
        record("request", "application/http; msgtype=request", asked, identity("response")),
        record("response", "application/http; msgtype=response", answered, None),
        record("metadata", "application/warc-fields", said, identity("request")),
    )
    return pages.select(F.encode(warc, "utf-8").alias("warc"))


#: Bytes of a gzip member that are opened at a time.
GZIP_STEP = 1 << 16


def _opened(data: bytes) -> list[bytes]:
    """The contents of gzip members, in stretches that are whole: a member that breaks off ends one, and opening goes on at the next member."""
    stretches: list[list[bytes]] = [[]]
    at = 0
    while (at := data.find(b"\x1f\x8b\x08", at)) >= 0:
        member, place = zlib.decompressobj(31), at
        try:
            while place < len(data) and not member.eof:
                stretches[-1].append(member.decompress(data[place : place + GZIP_STEP]))
                place = min(place + GZIP_STEP, len(data))
        except zlib.error:
            stretches.append([])
            at += 3
            continue
        at = place - len(member.unused_data)
    return [b"".join(x) for x in stretches]


def _split(data: bytes) -> Iterator[dict]:
    """The records of WARC bytes; gzip members are opened. What follows a record that cannot be read is passed over up to the next."""
    for stretch in _opened(data) if data[:2] == b"\x1f\x8b" else [data]:
        yield from _records(stretch)


def _records(data: bytes) -> Iterator[dict]:
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        if at and data[at - 1 : at] != b"\n":
            at += 5
            continue
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        fields: list[tuple[str, str]] = []
        for line in data[at:end].split(b"\r\n")[1:]:
            name, colon, value = line.decode("utf-8", "replace").partition(":")
            if line[:1] in b" \t" and fields:
                fields[-1] = fields[-1][0], f"{fields[-1][1]} {name}{colon}{value}".strip()
            elif colon:
                fields.append((name.strip().lower(), value.strip()))
        head = dict(reversed(fields))
        length = head.get("content-length", "")
        if not length.isdigit():
            at = end
            continue
        block = data[end + 4 : end + 4 + int(length)]
        at = end + 4 + int(length)
        http, payload = "", block
        if head.get("content-type", "").startswith("application/http"):
            top, gap, payload = block.partition(b"\r\n\r\n")
            http = top.decode("utf-8", "replace")
            if not gap:
                payload = b""
        yield {
            "record_id": head.get("warc-record-id"), "record_type": head.get("warc-type"), "concurrent_to": [v for n, v in fields if n == "warc-concurrent-to"], "target_uri": head.get("warc-target-uri"),
            "date": head.get("warc-date"), "content_type": head.get("content-type"), "http_head": http, "payload": payload, "block_digest": head.get("warc-block-digest"), "truncated": len(block) < int(length) or "warc-truncated" in head,
        }


def parse(files: DataFrame) -> DataFrame:
    """All records in the binary column ``warc``: null, empty and unreadable bytes have none. Other columns are ignored.

    A cell is a whole file or a part that starts with a record, up to Spark's 2 GB of a cell. ``truncated`` tells a record that
    ends before its length, or says itself that it was cut; of a gzip member that breaks off, what could be opened is kept.
    """
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"concurrent_to": pa.list_(pa.string()), "payload": pa.binary(), "truncated": pa.bool_()}
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                rows = [r for raw in batch.column("warc").slice(lo, 500).to_pylist() if raw for r in _split(raw)]
                yield batch_of(**{n: pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names})

    return files.select("warc").mapInArrow(run, RECORD_SCHEMA)


def transactions(records: DataFrame) -> DataFrame:
    """(record_id, capture_id): the nearest response that a record is linked to by concurrent_to, in either direction and through any number of links.

    Only identifiers move. Links go through ids whose records are missing, too. A record with several nearest responses goes
    to the least of their ids. Records that are linked to each other, but to no response, are the capture of the least of
    their ids. Identifiers are written to the shared folder at every link. ``records`` are read a few times: give a table.
    """
    ids = records.where("record_id IS NOT NULL").select("record_id", "record_type", "concurrent_to")
    edges = ids.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b"))
    edges = saved(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    nearest = ids.where("record_type IN ('response', 'revisit', 'resource')").select(F.col("record_id").alias("a"), F.col("record_id").alias("capture_id")).distinct()
    reached = frontier = saved(nearest)
    # breadth first: a record takes the capture of its least neighbour that was reached a link before
    while not frontier.isEmpty():
        onward = edges.join(frontier, "a").groupBy(F.col("b").alias("a")).agg(F.min("capture_id").alias("capture_id"))
        frontier = saved(onward.join(reached.select("a"), "a", "left_anti"))
        reached = reached.unionByName(frontier)
    rest = saved(edges.join(reached.select("a"), "a", "left_anti"))
    if not rest.isEmpty():
        parts = ids.select(F.col("record_id").alias("node")).distinct().join(components(rest), "node")
        least = parts.groupBy("component").agg(F.min("node").alias("capture_id"))
        reached = reached.unionByName(parts.join(least, "component").select(F.col("node").alias("a"), "capture_id"))
    return ids.select(F.col("record_id").alias("a")).distinct().join(reached, "a", "left").select(F.col("a").alias("record_id"), F.coalesce("capture_id", "a").alias("capture_id"))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture (``transactions``): request, response and metadata.

    Of several requests (or responses) of a capture the one with the least record_id counts; metadata are all kept, in order of
    record_id. What is missing is null, or an empty array. Repeated records count once. Records without an id or type, and
    types that are no part of a capture (warcinfo), are left out. The capture's uri and date are the response's, or else those
    of its least record. Of a metadata field that occurs more than once the first value counts. An empty table gives an empty
    result; other columns are ignored. Records are parsed once and written to the shared folder, payloads too.
    """
    own = saved(records.where("record_id IS NOT NULL AND record_type IN ('request', 'response', 'metadata', 'revisit', 'resource')"))
    # a response is its own capture: only the others, that have little payload, look theirs up
    main = F.col("record_type").isin("response", "revisit", "resource")
    linked = own.where(main).withColumn("capture_id", F.col("record_id")).unionByName(own.where(~main).join(transactions(own), "record_id"))
    kind = F.col("record_type")
    request = F.when(kind == "request", F.struct("record_id", F.regexp_extract("http_head", r"^([A-Z]+) ", 1).alias("method"), F.col("http_head").alias("head"), "payload"))
    response = F.when(
        kind.isin("response", "revisit", "resource"), F.struct("record_id", F.expr("try_cast(nullif(regexp_extract(http_head, '^HTTP/[0-9.]+ ([0-9]{3})', 1), '') AS int)").alias("status"), "content_type", F.col("http_head").alias("head"), "payload", F.coalesce("block_digest", F.sha1("payload")).alias("digest"), "truncated")
    )
    fields = F.map_from_entries(
        F.transform(
            F.array_distinct(F.transform(F.regexp_extract_all(F.decode("payload", "utf-8"), F.lit(r"(?m)^([^:\r\n]+):"), F.lit(1)), F.trim)),
            lambda name: F.struct(name.alias("key"), F.trim(F.regexp_replace(F.element_at(F.filter(F.split(F.decode("payload", "utf-8"), "\r?\n"), lambda line: F.startswith(line, F.concat(name, F.lit(":")))), 1), r"^[^:]*:", "")).alias("value")),
        )
    )
    metadata = F.when(kind == "metadata", F.struct("record_id", "content_type", fields.alias("fields")))
    rank = F.struct(F.when(response.isNotNull(), 0).otherwise(1).alias("k"), F.col("record_id"), F.col("target_uri"), F.col("date"))
    grouped = linked.groupBy("capture_id").agg(
        F.min(rank).alias("first"), F.min_by(request, F.when(kind == "request", F.col("record_id"))).alias("request"), F.min_by(response, F.when(response.isNotNull(), F.col("record_id"))).alias("response"),
        F.array_sort(F.collect_list(metadata), lambda x, y: F.when(x.record_id < y.record_id, -1).when(x.record_id > y.record_id, 1).otherwise(0)).alias("metadata"), F.size(F.collect_set("record_id")).alias("n_records"),
    )
    once = F.filter("metadata", lambda x, i: (i == 0) | (x.record_id != F.try_element_at("metadata", i).record_id))
    return grouped.withColumn("metadata", once).select("capture_id", F.col("first.target_uri").alias("target_uri"), F.col("first.date").alias("date"), "request", "response", "metadata", "n_records")
