"""Predicates on hosts and addresses that are no indicators of anything."""

from __future__ import annotations

import ipaddress
import re
from functools import cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .text import constants, host_of, norm_host, trim

_NETS4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "192.88.99.0/24",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)
_NETS6 = ("::/128", "::1/128", "2001:db8::/32", "fc00::/7", "fe80::/10", "ff00::/8")
_RESERVED_ENDS = ("corp", "example", "example.com", "home", "internal", "invalid", "lan", "local", "localhost", "test")
_BENIGN_ENDS = ("docs.npmjs.com", "spec.whatwg.org")
_DOCS = ("apidocs", "devdocs", "doc", "docs", "documentation", "readthedocs")
_CODE_ENDS = ("email", "global", "group", "top", "xyz")
QUAD = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"


@cache
def known(section: str) -> tuple[str, ...]:
    """A list of ``known_good.txt``."""
    out, now = [], ""
    for line in Path(__file__).with_name("known_good.txt").read_text().splitlines():
        if line.startswith("["):
            now = line[1:-1]
        elif now == section:
            head, colon, rest = line.partition(": ")
            if not colon:
                out += line.split()
            elif section == "addresses":
                out += [f"{head}.{x}" for x in rest.split()]
            else:
                out += [f"{x}.{head}" for x in rest.split(" ")] if head else rest.split()
    return tuple(out)


@cache
def _hosts() -> tuple[str, ...]:
    return tuple(sorted({*known("examples"), *known("services"), "localhost"}))


def ipv4_number(ip: Column) -> Column:
    """An IPv4 address as a number; null if it is none (leading zeros are refused)."""
    v = trim(ip)
    parts = F.split(v, r"\.")
    return F.when(F.rlike(v, F.lit(QUAD)), sum((parts[k].cast("long") * (1 << (8 * (3 - k))) for k in range(1, 4)), parts[0].cast("long") * (1 << 24)))


@F.pandas_udf(BooleanType())
def _ipv6_reserved(values: pd.Series) -> pd.Series:
    """Whether an IPv6 address is reserved, once per distinct text; null if it is no IPv6 address."""
    nets = [ipaddress.ip_network(x) for x in _NETS6]

    def one(v: str | None) -> bool | None:
        try:
            ip = ipaddress.IPv6Address(v)
        except ValueError:
            return None
        if ip.ipv4_mapped:
            inner = ip.ipv4_mapped
            return any(inner in ipaddress.ip_network(n) for n in _NETS4) or len(set(inner.packed)) == 1
        return any(ip in n for n in nets)

    seen = {v: one(v) for v in values.dropna().unique()}
    return values.map(seen).astype(object)


def oid_like(ip: Column) -> Column:
    return ipv4_number(ip).isNotNull() & F.startswith(trim(ip), F.lit("2.5."))


def benign_ipv4(ip: Column) -> Column:
    """Placeholder, reserved, all-equal or OID-like address. False for what is no IPv4 address; null for null."""
    v, n = trim(ip), ipv4_number(ip)
    nets = [ipaddress.ip_network(x) for x in _NETS4]
    ends = [constants(str(int(net[k])) for net in nets).cast("array<bigint>") for k in (0, -1)]
    inside = F.exists(F.arrays_zip(ends[0].alias("lo"), ends[1].alias("hi")), lambda net: n.between(net["lo"], net["hi"]))
    same = F.rlike(v, F.lit(r"^(\d+)\.\1\.\1\.\1$"))
    return F.array_contains(constants(known("addresses")), v) | F.coalesce(inside | same | F.startswith(v, F.lit("2.5.")), F.lit(False))


def benign_ip(ip: Column) -> Column:
    return F.when(F.contains(ip, F.lit(":")), F.coalesce(_ipv6_reserved(trim(ip)), F.lit(False))).otherwise(benign_ipv4(ip))


def version_like(ip: Column) -> Column:
    """Whether an IPv4 address reads like a version or an object identifier."""
    v = trim(ip)
    low = F.forall(F.split(v, r"\."), lambda x: x.cast("int") <= 31)
    return ipv4_number(ip).isNotNull() & (F.rlike(v, F.lit(r"^2\.5\.(29|4)\.")) | F.rlike(v, F.lit(r"^\d+\.0\.0\.0$")) | low)


def _ends_with_any(host: Column, names: tuple[str, ...]) -> Column:
    """Whether the host is one of the names or below one: its suffixes are looked up, whatever the number of names."""
    # each is a label before the suffix found last; the host is in the expression once, so that plans stay small
    suffixes = F.aggregate(F.reverse(F.split(host, r"\.")), F.expr("cast(array() as array<string>)"), lambda acc, x: F.array_append(acc, F.concat_ws(".", x, F.try_element_at(acc, F.lit(-1)))))
    return F.arrays_overlap(suffixes, constants(names))


_BENIGN_HOST = rf"^(({'|'.join(_DOCS)})\..+\..*)?$|\.({'|'.join(re.escape(x) for x in (*_RESERVED_ENDS, *_BENIGN_ENDS))})\z"


def benign_domain(host: Column) -> Column:
    """Example, documentation and well-known service hosts; an empty host too. Null for null."""
    h = norm_host(host)
    return F.rlike(h, F.lit(_BENIGN_HOST)) | _ends_with_any(h, _hosts())


def benign_url(url: Column) -> Column:
    return benign_domain(host_of(url))


def benign_doc_url(url: Column) -> Column:
    """A benign host that cannot serve a stranger's payload."""
    h = host_of(url)
    return (h != "") & ~F.array_contains(constants(known("payload")), h) & benign_domain(h)


def code_token(host: Column) -> Column:
    """Whether a domain is more likely an attribute access in code."""
    labels = F.split(norm_host(host), r"\.")
    name = F.try_element_at(labels, F.lit(-2))
    return F.coalesce(F.element_at(labels, -1).isin(*_CODE_ENDS) & (name != "") & ((F.octet_length(name) <= 3) | F.array_contains(constants(known("identifiers")), name)), F.lit(False))


def benign(kind: Column, value: Column) -> Column:
    k = F.lower(trim(kind))
    return F.when(k.isin("ipv4", "ipv6", "ip"), benign_ip(value)).when(k.isin("domain", "hostname", "fqdn"), benign_domain(value)).when(k == "email", benign_domain(host_of(value))).otherwise(False)
