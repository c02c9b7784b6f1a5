"""Addresses in canonical form, by Arrow batches: once per distinct text, and one node of a plan."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import trim


def canonical(value: str) -> str | None:
    """An address as it is usually written, a mapped IPv4 address as such; None for what is no address. Leading zeros are refused in IPv4."""
    if "%" in value or not value or not value.isascii():
        return None
    try:
        ip = ipaddress.ip_address(value)
    except ValueError:
        return None
    return str(getattr(ip, "ipv4_mapped", None) or ip)


def host(value: str) -> str | None:
    """The canonical address of a token with brackets or a prefix; None if the prefix leaves more than one host."""
    ip, slash, bits = value.strip("[]").partition("/")
    if slash and bits != ("128" if ":" in ip else "32"):
        return None
    return canonical(ip)


def _each(one: Callable[[str], str | None], values: pd.Series) -> pd.Series:
    seen = {v: one(v) for v in values.dropna().unique()}
    return values.map(seen).astype(object).where(values.notna(), None)


@F.pandas_udf(StringType())
def _canonical(values: pd.Series) -> pd.Series:
    return _each(canonical, values)


@F.pandas_udf(StringType())
def _host(values: pd.Series) -> pd.Series:
    return _each(host, values)


def canonical_ip(value: Column) -> Column:
    return _canonical(trim(value))


def host_address(value: Column) -> Column:
    return _host(trim(value))
