"""Functions for SQL: a session's own, and the rule scan as a view."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

from .functions import address, text
from .functions.catalogue import rules
from .functions.literals import plan
from .operators.rules import scan


@F.pandas_udf(StringType())
def _canonical(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else address.canonical(v.strip()))


@F.pandas_udf(BooleanType())
def _reserved(values: pd.Series) -> pd.Series:
    import ipaddress

    def one(v: str | None) -> bool | None:
        own = None if v is None else address.canonical(v.strip())
        return None if own is None else not ipaddress.ip_address(own).is_global

    return values.map(one)


@F.pandas_udf(ArrayType(StringType()))
def _needed(values: pd.Series) -> pd.Series:
    names = [r.id for r in rules()]
    exact, _, _ = plan(tuple(r.pattern for r in rules()))
    return values.map(lambda v: None if v is None else sorted({names[k] for literal, own in exact.items() if literal in v for k in own}))


def register(spark: SparkSession) -> list[str]:
    """Registers byte_entropy, ip_canonical, ip_is_reserved and rule_candidates; gives their names."""
    own = {"byte_entropy": text.entropy, "ip_canonical": _canonical, "ip_is_reserved": _reserved, "rule_candidates": _needed}
    for name, function in own.items():
        spark.udf.register(name, function)
    return sorted(own)


def findings_view(spark: SparkSession, table: str, keys: list[str], content: str, name: str = "findings", sections: tuple[str, ...] = ("recipe", "hook", "source", "binaries"), hook: bool = False) -> None:
    """Makes the findings in a table's texts a temporary view."""
    scan(spark.table(table), keys, content, sections, hook).createOrReplaceTempView(name)
