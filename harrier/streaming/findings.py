"""Findings of a stream of texts, and how many there are in a stretch of time."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rules


def findings(stream: DataFrame, keys: list[str], content: str, sections: Iterable[str] = ("recipe", "hook", "source", "binaries"), hook: bool = False) -> DataFrame:
    """Findings of the rules in a streaming (or any) table, as ``operators.rules.scan`` has them. Rows are judged one by one, so nothing is kept between batches."""
    return rules.scan(stream, keys, content, sections, hook)


def evidence_counts(found: DataFrame, time: str, window: str = "1 hour", late: str = "10 minutes", by: tuple[str, ...] = ("category",)) -> DataFrame:
    """(start, by, evidence, context): findings in stretches of time. What comes later than ``late`` behind the newest is left out, and what is kept of a stretch goes when it is over."""
    n = lambda kind: F.count(F.when(F.col("class") == kind, 1)).alias(kind)
    return found.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *by).agg(n("evidence"), n("context")).select(F.col("w.start").alias("start"), *by, "evidence", "context")
