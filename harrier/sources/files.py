"""Files in a folder, as the scan for indicators reads them."""

from __future__ import annotations

import os
import platform
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matcher

MAX_BYTES = 10 << 20
SKIPPED = (".git", ".hg", ".svn", "node_modules", "vendor")
EVIDENCE = "path string, is_binary boolean, type string, value string, class string, line_number int, col_start int, col_end int, byte_offset bigint, matched_line string, context_before array<string>, context_after array<string>, name string, labels array<string>"


@dataclass(frozen=True)
class Options:
    """``depth`` 0 is any; ``skipped`` None is ``SKIPPED``; extensions with or without dot, those to leave out come first."""

    depth: int = 0
    max_bytes: int = MAX_BYTES
    include: Iterable[str] = ()
    exclude: Iterable[str] = ()
    skipped: Iterable[str] | None = None
    binaries: bool = False
    context: int = matcher.CONTEXT_LINES


def _extensions(values: Iterable[str]) -> list[str]:
    return [x if x.startswith(".") else f".{x}" for x in (v.strip().lower() for v in values) if x]


def extension(path: Column) -> Column:
    """The last extension in lower case, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.[^./]*$", 0))


def listed(spark: SparkSession, root: str, options: Options = Options()) -> DataFrame:
    """(path, length, content): the files under a folder that the options let through, paths relative to it.

    Sizes and folders are judged before contents are read. The folder itself is never skipped, whatever its name. Spark lists no
    empty files; they could have no evidence.
    """
    base = root.rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*").load(base).where(F.col("length") <= (options.max_bytes if options.max_bytes > 0 else MAX_BYTES))
    place = F.regexp_replace("path", "^[a-z]+:/*(?=/)", "")
    at = F.locate(f"{base}/", place)
    rows = rows.withColumn("path", F.when(at > 0, F.substr(place, at + F.lit(len(base) + 1))).otherwise(F.substring_index(place, "/", -1)))
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    skipped = list(SKIPPED if options.skipped is None else options.skipped)
    if skipped:
        rows = rows.where(~F.exists(folders, lambda x: x.isin(*skipped)))
    if options.depth > 0:
        rows = rows.where(F.size(folders) < options.depth)
    if out := _extensions(options.exclude):
        rows = rows.where(~extension(F.col("path")).isin(*out))
    if only := _extensions(options.include):
        rows = rows.where(extension(F.col("path")).isin(*only))
    return rows.select("path", "length", "content")


def judged(files: DataFrame, binaries: bool = False) -> DataFrame:
    """Adds is_binary and scanned: documents are not scanned, and binaries only if asked for."""
    kind = F.coalesce(matcher.is_binary(F.col("content")) & (F.length("content") > 0), F.lit(False))
    return files.withColumn("is_binary", kind).withColumn("scanned", (F.length("content") == 0) | (~matcher.is_document(F.col("path")) & (~F.col("is_binary") | F.lit(binaries))))


def evidence(files: DataFrame, indicators: DataFrame, options: Options = Options()) -> DataFrame:
    """Evidence in ``judged`` files, one row each."""
    own = files.where("scanned AND length > 0")
    texts = own.where("NOT is_binary").select("path", F.decode("content", "utf-8").alias("m_text"))
    found = matcher.match_text(texts, ["path"], "m_text", indicators, "path", options.context).withColumn("is_binary", F.lit(False)).withColumn("byte_offset", F.lit(None).cast("long"))
    columns = [x.split()[0] for x in EVIDENCE.split(", ")]
    if options.binaries:
        more = matcher.match_binary(own.where("is_binary").select("path", "content"), ["path"], "content", indicators, "path").withColumn("is_binary", F.lit(True))
        for c, kind in (("line_number", "int"), ("col_start", "int"), ("col_end", "int"), ("context_before", "array<string>"), ("context_after", "array<string>")):
            more = more.withColumn(c, F.lit(None).cast(kind))
        found = found.unionByName(more)
    return found.select(*columns)


@dataclass
class Report:
    """A scan: where and when, the number of indicators and files, and tables of evidence and findings."""

    root: str
    host: dict
    indicators: int
    files: int
    evidence: DataFrame
    warnings: list[dict] = field(default_factory=list)

    def findings(self) -> DataFrame:
        return matcher.as_findings(self.evidence, ["path"], "path")

    def malicious(self) -> bool:
        return not self.evidence.where("class <> 'context'").isEmpty()


def scan(spark: SparkSession, root: str, indicators: DataFrame, options: Options = Options(), now: datetime | None = None, warnings: Iterable[dict] = ()) -> Report:
    """Scans a folder for an ``indicator_set``; ``now`` is the time that the report is given."""
    own = judged(listed(spark, root, options), options.binaries)
    host = {"hostname": platform.node(), "os": platform.system().lower(), "arch": platform.machine(), "pid": os.getpid(), "scan_time": (now or datetime.now(timezone.utc)).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")}
    return Report(root, host, indicators.count(), own.where("scanned").count(), evidence(own, indicators, options), list(warnings))
