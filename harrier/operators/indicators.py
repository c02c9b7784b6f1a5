"""Indicator sets: STIX bundles, blocklists, and the keys that indicators are looked up by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import allow, text
from ..functions.address import canonical_ip

BUNDLE = "struct<objects:array<struct<type:string,pattern:string,name:string,description:string,labels:array<string>,external_references:array<struct<source_name:string,external_id:string,url:string>>,valid_from:string>>>"
OBSERVABLE = r"\[(domain-name|ipv4-addr|ipv6-addr|url):value\s*=\s*'([^']*)'\]"
FILE_HASH = r"\[file:hashes\.(?:'[^']*'|[A-Za-z0-9._-]+)\s*=\s*'([0-9a-fA-F]+)'\]"
KINDS = {"domain-name": "domain", "ipv4-addr": "ipv4", "ipv6-addr": "ipv6", "url": "url"}
COLUMNS = "type value name description severity ecosystem labels refs valid_from".split()


def label(labels: Column, key: str) -> Column:
    """The value of the first label ``key:value``, whatever the case of the key; empty if there is none."""
    first = F.try_element_at(F.filter(F.coalesce(labels, F.array().cast("array<string>")), lambda x: F.startswith(F.lower(x), F.lit(f"{key}:"))), F.lit(1))
    return F.coalesce(F.substr(first, F.lit(len(key) + 2)), F.lit(""))


def _objects(bundles: DataFrame, column: str) -> DataFrame:
    """(feed_seq, object_seq, o): the indicator objects of bundles; text that is no JSON has none."""
    rows = bundles.select(F.col("feed_seq") if "feed_seq" in bundles.columns else F.lit(0).alias("feed_seq"), F.from_json(F.col(column), BUNDLE).alias("b"))
    return rows.select("feed_seq", F.posexplode("b.objects").alias("object_seq", "o")).where("o.type = 'indicator'")


def parse_bundles(bundles: DataFrame, column: str = "content") -> DataFrame:
    """(feed_seq, object_seq, type, value, name, description, severity, ecosystem, labels, refs, valid_from) of STIX bundles in a text column.

    Objects whose pattern compares no domain, address or url are passed over; of a pattern with several the first counts.
    ``feed_seq`` of the input, if there is one, says which bundle comes first.
    """
    o = _objects(bundles, column)
    kind, value = F.regexp_extract("o.pattern", OBSERVABLE, 1), text.trim(F.regexp_extract("o.pattern", OBSERVABLE, 2))
    named = F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), F.nullif(kind, F.lit("")))
    text_of = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c.split(".")[1])
    return o.select(
        "feed_seq", "object_seq", named.alias("type"), value.alias("value"), text_of("o.name"), text_of("o.description"), label(F.col("o.labels"), "severity").alias("severity"), label(F.col("o.labels"), "ecosystem").alias("ecosystem"),
        F.coalesce("o.labels", F.array().cast("array<string>")).alias("labels"), F.col("o.external_references").alias("refs"), text_of("o.valid_from"),
    ).where("type IS NOT NULL AND value <> ''")


def parse_hashes(bundles: DataFrame, column: str = "content") -> DataFrame:
    """(hash): file hashes of the objects that are no observables themselves."""
    o = _objects(bundles, column).where(~F.rlike("o.pattern", F.lit(OBSERVABLE)) | F.rlike("o.pattern", F.lit(OBSERVABLE.replace("[^']*", r"\s*"))))
    return o.select(F.nullif(F.regexp_extract("o.pattern", FILE_HASH, 1), F.lit("")).alias("hash")).where("hash IS NOT NULL")


def key_of(kind: Column, value: Column) -> Column:
    """What an indicator is looked up by: a domain in lower case without root dot, an address in canonical form, a whole url in lower case."""
    low = F.lower(text.trim(value))
    address = F.when(kind.isin("ipv4", "ipv6"), value)
    return F.when(kind == "domain", F.regexp_replace(low, r"\.\z", "")).when(kind.isin("ipv4", "ipv6"), F.coalesce(canonical_ip(address), low)).otherwise(F.lower(value))


def group_of(kind: Column) -> Column:
    """Addresses of both versions share one set."""
    return F.when(kind.isin("ipv4", "ipv6"), "ip").otherwise(kind)


def indicator_set(indicators: DataFrame) -> DataFrame:
    """(kind, key, and the indicator's columns): what may be matched, one row per key.

    Left out are benign values, domains that read like code, addresses that read like versions, and urls on hosts that only
    hold documents. Of several indicators with one key the first by (feed_seq, object_seq) counts.
    """
    t, v = F.col("type"), F.col("value")
    wrong = F.when(t == "domain", allow.code_token(v)).when(t.isin("ipv4", "ipv6"), allow.version_like(v)).when(t == "url", allow.benign_doc_url(v)).otherwise(True)
    good = indicators.where("value <> ''").where(~F.coalesce(allow.benign(t, v), F.lit(False)) & ~F.coalesce(wrong, F.lit(False)))
    keyed = good.select(group_of(t).alias("kind"), key_of(t, v).alias("key"), F.struct("feed_seq", "object_seq").alias("order"), F.struct(*COLUMNS).alias("i"))
    # only the least of each key is kept while they are gathered, so a key with any number of indicators is no burden
    return keyed.groupBy("kind", "key").agg(F.min_by("i", "order").alias("i")).select("kind", "key", "i.*")


def of_blocklist(blocklist: DataFrame, feed_seq: int = 1 << 30) -> DataFrame:
    """A blocklist(kind, value) as indicators that come after those of feeds; mail addresses are none."""
    rows = blocklist.where("kind IN ('ipv4', 'ipv6', 'domain')")
    none = F.lit("")
    return rows.select(
        F.lit(feed_seq).alias("feed_seq"), F.lit(0).alias("object_seq"), F.col("kind").alias("type"), "value", F.lit("host on a blocklist").alias("name"), F.lit("on a public list of bad hosts").alias("description"), none.alias("severity"), none.alias("ecosystem"),
        F.array(F.lit("malicious-activity"), F.lit("source:threat-intel-blocklist")).alias("labels"), F.lit(None).cast("array<struct<source_name:string,external_id:string,url:string>>").alias("refs"), none.alias("valid_from"),
    )
