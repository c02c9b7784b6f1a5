"""Known-bad indicators in texts and binaries.

Tokens that look like urls, hosts and addresses are taken from every line as narrow rows (file, line, kind, key) and joined with
the indicator set; texts do not move. Only the few lines that hit are looked at again, for the exact place and for what rules a
token out, and only their files for the lines around.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import text
from ..functions.address import canonical_ip
from ..functions.allow import QUAD
from . import detectors

#: Lines around a hit that are reported.
CONTEXT_LINES = 3
#: Bytes of the shortest printable run in a binary, and bytes in which a binary is told.
STRING_BYTES, SNIFF_BYTES = 6, 8192
LINE_BYTES = 200
#: A longer line with fewer than 1 in 50 blanks was made by a machine.
MINIFIED_BYTES, MINIFIED_BLANKS = 2000, 50
#: Bytes up to which an indicator set is sent to all tasks; beyond, lookups are a join by key.
BROADCAST_BYTES = 64 << 20
#: Bytes of an indicator set's row, at most, that is sent: its key, kind and number.
ROW_BYTES = 200

URL = r"""(?i)\bhttps?://[^\s'"`<>)\]}\\]+"""
DOMAIN = r"(?i)\b(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}\b"
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
IPV6 = r"(?i)\b[0-9a-f:]{4,45}\b"
HOST = r"(?i)^https?://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)(?::\d*)?(?:[/?#]|\z)"

NOISY = (".svg", ".map", ".min.js", ".min.mjs", ".min.cjs", ".min.css")
DOCUMENTS = (".md", ".markdown", ".mdx", ".mkd", ".mdown")
TEST_FOLDERS = ("test", "tests", "__tests__", "__fixtures__", "fixtures", "spec", "__mocks__")
EXAMPLE_FOLDERS = ("example", "examples", "sample", "samples", "demo", "demos")
BUNDLES = (".min.js", ".min.mjs", ".min.cjs", ".min.css")
OWN_SOURCE = "source:registry"


def _path(path: Column) -> Column:
    return F.concat(F.lit("/"), F.lower(F.replace(path, F.lit("\\"), F.lit("/"))))


def _ends(value: Column, ends: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for x in ends:
        out = out | F.endswith(value, F.lit(x))
    return out


def _under(value: Column, folders: tuple[str, ...]) -> Column:
    return F.rlike(value, F.lit(f"/({'|'.join(folders)})/"))


def file_tier(path: Column) -> Column:
    """"suppress" for source maps, "demote" for tests, examples and bundles, "keep" for everything else."""
    p = _path(path)
    base = F.substring_index(p, "/", -1)
    test = _under(p, TEST_FOLDERS) | F.contains(base, F.lit(".test.")) | F.contains(base, F.lit(".spec.")) | _ends(base, ("_test.go", ".snap")) | (base == "conftest.py")
    return F.when(F.endswith(p, F.lit(".map")), "suppress").when(test | _under(p, EXAMPLE_FOLDERS) | F.contains(p, F.lit("/dist/")) | _ends(p, BUNDLES), "demote").otherwise("keep")


def is_document(path: Column) -> Column:
    """Documents that nothing runs."""
    return _ends(F.lower(path), DOCUMENTS)


def is_noisy(path: Column) -> Column:
    """Files whose numbers look like addresses."""
    return _ends(F.lower(path), NOISY)


def is_minified(line: Column) -> Column:
    blanks = F.octet_length(line) - F.octet_length(F.translate(line, " \t", ""))
    return (F.octet_length(line) >= MINIFIED_BYTES) & (blanks * MINIFIED_BLANKS < F.octet_length(line))


def is_binary(content: Column) -> Column:
    """Of bytes: the magic of an executable, or a zero among the first bytes."""
    return (F.substring(content, 1, 4) == F.lit(b"\x7fELF")) | (F.instr(F.decode(F.substring(content, 1, SNIFF_BYTES), "ISO-8859-1"), "\0") > 0)


def strings(content: Column) -> Column:
    """Array of (value, offset): the printable runs of bytes."""
    latin = F.decode(content, "ISO-8859-1")
    pattern = "[\\x20-\\x7e]{%d,}" % STRING_BYTES
    runs, gaps = F.regexp_extract_all(latin, F.lit(pattern), F.lit(0)), F.split(latin, pattern, -1)
    sizes = F.zip_with(gaps, runs, lambda g, r: F.struct(F.length(g).cast("long").alias("gap"), F.coalesce(F.length(r), F.lit(0)).cast("long").alias("run"), r.alias("value")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<value:string,offset:bigint>>)").alias("out"))
    return F.aggregate(
        sizes, start, lambda acc, x: F.struct((acc["at"] + x.gap + x.run).alias("at"), F.when(x.value.isNotNull(), F.concat(acc.out, F.array(F.struct(x.value.alias("value"), (acc["at"] + x.gap).alias("offset"))))).otherwise(acc.out).alias("out")), lambda acc: acc.out
    )


def lines_of(content: Column) -> Column:
    return F.transform(text.lines(content), lambda x: F.regexp_replace(x, "\r\\z", ""))


def _tokens(value: Column, pattern: str) -> Column:
    from ..functions.regex import to_java

    return F.regexp_extract_all(value, F.lit(to_java(pattern)), F.lit(0))


def url_host(url: Column) -> Column:
    """The host of a url; empty if it has none or its port is no number."""
    return F.regexp_replace(F.regexp_extract(url, HOST, 1), r"^\[|\]$", "")


def _candidates(line: Column, without_ipv4: Column, kinds: set[str]) -> Column:
    """Array of (kind, key): what may be an indicator in a line, each once; more than is one in the end. Only of ``kinds``, for the others are not looked up."""
    urls = F.when(F.contains(line, F.lit("://")), _tokens(line, URL))
    some = F.array().cast("array<struct<kind:string,key:string>>")

    def of(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("key")))

    dotted = F.contains(line, F.lit("."))
    parts = [
        ("url", lambda: of("url", F.transform(urls, F.lower))), ("domain", lambda: of("domain", F.filter(F.transform(urls, lambda u: F.regexp_replace(F.lower(url_host(u)), r"\.\z", "")), lambda h: h != ""))), ("domain", lambda: F.when(dotted, of("domain", F.transform(_tokens(line, DOMAIN), F.lower)))),
        ("ip", lambda: F.when(dotted & ~without_ipv4, of("ip", F.filter(_tokens(line, IPV4), lambda v: F.rlike(v, F.lit(QUAD)))))),
        ("ip6", lambda: F.when(F.rlike(line, F.lit("(?i)(?:^|[^0-9a-z_]|[0-9a-f]):[0-9a-f]*:|[0-9a-f]:")), of("ip6", F.filter(F.transform(_tokens(line, IPV6), F.lower), lambda v: F.length(v) - F.length(F.replace(v, F.lit(":"), F.lit(""))) >= 2)))),
    ]
    return F.array_distinct(F.concat(some, *[F.coalesce(part(), some) for kind, part in parts if kind in kinds]))


_GEOMETRY = re.compile(r"(?:^|[ \t])(?:d|points|transform)=(?:\\\"|[\"'])[^\"']*\Z")
_COMPARED = re.compile(r"(?:[><~^]|[=><~!^]=|(?<![A-Za-z0-9_])[vV])\Z")
_PATTERNS = {k: re.compile(p, re.A) for k, p in (("url", URL), ("domain", DOMAIN), ("ipv4", IPV4), ("ipv6", IPV6))}
_URL_HOST = re.compile(HOST.replace(r"\z", r"\Z"))
_PLACE = StructType([StructField("kind", StringType()), StructField("value", StringType()), StructField("at", IntegerType())])


def _address_at(line: str, start: int, end: int) -> bool:
    """Whether a quad is used as an address: not as a part of more numbers, a version, or a coordinate."""
    around = line[start - 1 : start] + line[end : end + 1]
    if any(c in ".+-" or c in "0123456789" for c in around):
        return False
    if start >= 2 and line[start - 1] == "/" and line[start - 2].isascii() and line[start - 2].isalpha():
        return False
    return not _GEOMETRY.search(line[:start]) and not _COMPARED.search(line[:start].rstrip(" \t")[-3:])


def find(line: str, kind: str, key: str) -> tuple[str, str, int] | None:
    """(kind, value, first byte) of the first token in a line that is the indicator ``key``; None if what looked like it is something else."""
    if kind == "url":
        for m in _PATTERNS["url"].finditer(line):
            if m[0].lower() == key:
                return "url", m[0], len(line[: m.start()].encode())
    if kind == "domain":
        for m in _PATTERNS["url"].finditer(line):
            own = _URL_HOST.match(m[0])
            host = own[1].strip("[]") if own else ""
            if host and host.lower().removesuffix(".") == key:
                return "domain", host, len(line[: m.start() + m[0].lower().index(host.lower())].encode())
        for m in _PATTERNS["domain"].finditer(line):
            if m[0].lower() == key:
                return "domain", m[0], len(line[: m.start()].encode())
    if kind == "ip":
        for m in _PATTERNS["ipv4"].finditer(line):
            if m[0] == key and _address_at(line, m.start(), m.end()):
                return "ipv4", m[0], len(line[: m.start()].encode())
    if kind == "ip6":
        for m in _PATTERNS["ipv6"].finditer(line):
            if m[0].lower() == key:
                return "ipv6", m[0], len(line[: m.start()].encode())
    return None


@F.pandas_udf(_PLACE)
def _places(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for lines, kinds, keys in batches:
        yield pd.DataFrame([find(*x) or (None, None, None) for x in zip(lines, kinds, keys)], columns=["kind", "value", "at"]).astype({"at": "Int32"})


def held(indicators: DataFrame) -> tuple[set[str], bool]:
    """Kinds of candidates that the set may know (``ip6`` if an address in it is one of IPv6), and whether its keys may be sent to all tasks: counted, not guessed."""
    rows = indicators.groupBy("kind", F.contains("key", F.lit(":")).alias("colon")).agg(F.count(F.lit(1)).alias("n")).collect()
    return {"ip6" if r.kind == "ip" and r.colon else r.kind for r in rows}, sum(r.n for r in rows) * ROW_BYTES <= BROADCAST_BYTES


def _once(indicators: DataFrame) -> DataFrame:
    """The set, computed once: in the session's checkpoint folder, or with the executors where there is none."""
    return indicators.checkpoint() if indicators.sparkSession.sparkContext.getCheckpointDir() else indicators.localCheckpoint()


def small(indicators: DataFrame) -> bool:
    """Whether the set's keys may be sent to all tasks: counted, not guessed."""
    return held(indicators)[1]


def _hits(rows: DataFrame, keys: list[str], line: str, indicators: DataFrame) -> DataFrame:
    """(keys, m_at, kind, value, at, i): the indicators in each row's line, once each; ``m_at`` tells the lines of a file apart."""
    kinds, few = held(indicators)
    narrow = rows.select(*keys, "m_at", F.explode(_candidates(F.col(line), F.col("m_no4"), kinds)).alias("c")).select(*keys, "m_at", F.col("c.kind").alias("m_kind"), F.col("c.key").alias("m_key"))
    looked = narrow.withColumn("m_look", F.col("m_key"))
    if "ip6" in kinds:
        # IPv6 keys are put in canonical form; a mapped IPv4 address is none
        six = narrow.where("m_kind = 'ip6'").withColumn("m_look", canonical_ip(F.col("m_key"))).where(F.contains("m_look", F.lit(":")))
        looked = looked.where("m_kind <> 'ip6'").unionByName(six)
    known = indicators.select(F.col("kind").alias("i_kind"), F.col("key").alias("i_key"))
    known = F.broadcast(known) if few else known
    met = looked.join(known, (F.when(F.col("m_kind") == "ip6", "ip").otherwise(F.col("m_kind")) == F.col("i_kind")) & (F.col("m_look") == F.col("i_key")), "left_semi")
    return met


def match_text(files: DataFrame, keys: list[str], content: str, indicators: DataFrame, path: str | None = None, context: int = CONTEXT_LINES) -> DataFrame:
    """Evidence of indicators in texts: the keys, type, value, class, line_number, col_start, col_end, matched_line, context_before, context_after, name, labels.

    ``indicators`` is an ``indicator_set``. ``path`` names a column with the file's path: source maps have no evidence; in
    tests, examples, bundles, minified lines and comments it is context only, and so is a host or address that only the set's
    own registry names. Lines count from 1, columns are bytes from 0. Null and empty texts have no evidence. Rows need unique
    keys; a token counts once in a line, where it is first.
    """
    context = context if context > 0 else CONTEXT_LINES
    indicators = _once(indicators)
    p = F.col(path) if path else F.lit("")
    own = files.where(F.col(content) != "").where(file_tier(p) != "suppress")
    lines = own.select(*keys, is_noisy(p).alias("m_noisy"), F.posexplode(lines_of(F.col(content))).alias("m_at", "m_line"))
    lines = lines.where(F.contains("m_line", F.lit(".")) | F.contains("m_line", F.lit(":"))).withColumn("m_no4", F.col("m_noisy") | is_minified(F.col("m_line")))
    met = _hits(lines, keys, "m_line", indicators).groupBy(*keys).agg(F.collect_set(F.struct("m_at", "m_kind", "m_key", "m_look")).alias("m_met"))
    # hits are few: their files are read again rather than carried along
    joined = own.select(*keys, file_tier(p).alias("m_tier"), lines_of(F.col(content)).alias("m_lines")).join(met, keys)
    each = joined.select(*keys, "m_tier", "m_lines", F.explode("m_met").alias("m")).select(
        *keys, "m_tier", "m.*", F.element_at("m_lines", F.col("m.m_at") + 1).alias("m_line"), _slice("m_lines", F.greatest(F.col("m.m_at") - context, F.lit(0)), F.col("m.m_at")).alias("context_before"),
        _slice("m_lines", F.col("m.m_at") + 1, F.least(F.col("m.m_at") + 1 + context, F.size("m_lines"))).alias("context_after"),
    )
    weak = (F.col("m_tier") == "demote") | is_minified(F.col("m_line")) | text.is_comment(F.col("m_line"))
    found = _placed(each, keys, indicators, weak)
    return found.select(
        *keys, "type", "value", "class", (F.col("m_at") + 1).alias("line_number"), F.col("at").alias("col_start"), (F.col("at") + F.octet_length("value")).alias("col_end"), F.col("m_line").alias("matched_line"), "context_before", "context_after", "name", "labels"
    )


def _slice(lines: str, start: Column, end: Column) -> Column:
    return F.slice(lines, start + 1, F.greatest(end - start, F.lit(0)))


def _placed(each: DataFrame, keys: list[str], indicators: DataFrame, weak: Column) -> DataFrame:
    """Adds type, value, at, class, name and labels to hits whose tokens are what they look like."""
    each = each.withColumn("m_place", _places("m_line", "m_kind", "m_key")).where("m_place.kind IS NOT NULL")
    facts = indicators.select(F.col("kind").alias("i_kind"), F.col("key").alias("i_key"), F.col("name"), F.col("labels"))
    each = each.join(facts, (F.when(F.col("m_kind") == "ip6", "ip").otherwise(F.col("m_kind")) == F.col("i_kind")) & (F.col("m_look") == F.col("i_key")))
    own = F.exists(F.coalesce("labels", F.array().cast("array<string>")), lambda x: F.lower(text.trim(x)) == OWN_SOURCE) & (F.col("m_place.kind") != "url")
    return each.select("*", F.col("m_place.kind").alias("type"), F.col("m_place.value").alias("value"), F.col("m_place.at").alias("at"), F.when(weak | own, "context").otherwise("evidence").alias("class"))


def match_binary(files: DataFrame, keys: list[str], content: str, indicators: DataFrame, path: str | None = None) -> DataFrame:
    """Evidence of indicators in binaries: the keys, type, value, class, byte_offset, matched_line, name, labels; an indicator counts once in a file, where it is first.

    Indicators are looked for in printable runs. Null and empty files have no evidence. Rows need unique keys.
    """
    p = F.col(path) if path else F.lit("")
    own = files.where(F.length(content) > 0).where(file_tier(p) != "suppress")
    runs = own.select(*keys, file_tier(p).alias("m_tier"), F.explode(strings(F.col(content))).alias("m")).select(*keys, "m_tier", F.col("m.offset").alias("m_at"), F.col("m.value").alias("m_line"), F.lit(False).alias("m_no4"))
    met = _hits(runs, keys, "m_line", indicators)
    each = runs.join(met, [*keys, "m_at"])
    found = _placed(each, keys, indicators, F.col("m_tier") == "demote")
    first = found.groupBy(*keys, "type", F.lower("value").alias("m_low")).agg(F.min_by(F.struct("value", "class", (F.col("m_at") + F.col("at")).alias("byte_offset"), "m_line", "name", "labels"), F.struct("m_at", "at")).alias("f"))
    cut = F.when(F.length("f.m_line") > LINE_BYTES, F.concat(F.substring("f.m_line", 1, LINE_BYTES), F.lit("…"))).otherwise(F.col("f.m_line"))
    return first.select(*keys, "type", "f.value", "f.class", "f.byte_offset", cut.alias("matched_line"), "f.name", "f.labels")


def as_findings(evidence: DataFrame, keys: list[str], path: str | None = None) -> DataFrame:
    """Evidence as findings like those of ``detect``."""
    where = F.concat(F.lit(" in "), F.col(path)) if path else F.lit("")
    why = F.when(F.coalesce("name", F.lit("")) != "", F.concat("name", where)).otherwise(F.concat(F.lit("known bad "), "type", F.lit(" "), "value", where))
    return evidence.select(*keys, F.lit("IOC-STIX-MATCH").alias("id"), F.lit("ioc").alias("category"), "class", F.lit(detectors.cwe("IOC-STIX-MATCH")).alias("cwe"), F.lit(0).alias("points"), why.alias("description"), F.coalesce(F.nullif("matched_line", F.lit("")), "value").alias("matched_line"))


def malicious(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, malicious): whether some evidence is more than context."""
    return evidence.groupBy(*keys).agg(F.bool_or(F.col("class") != "context").alias("malicious"))
