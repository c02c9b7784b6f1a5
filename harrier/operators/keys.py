"""Signing keys and identities of platforms, which say nothing about who wrote a commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

SCHEMA = "owner string, kind string, fingerprint string, key_id string, ssh_key string, email string"
KNOWN = [
    ("GitHub web-flow", "gpg", "5DE3E0509C47EA3CF04A42D34AEE18F83AFDEB23", "4AEE18F83AFDEB23", None, "noreply@github.com"),
    ("GitHub Actions", "gpg", None, None, None, "41898282+github-actions[bot]@users.noreply.github.com"),
    ("GitHub Dependabot", "gpg", None, None, None, "49699333+dependabot[bot]@users.noreply.github.com"),
    ("GitLab web commits", "gpg", None, None, None, "gitlab@gitlab.com"),
]


def known(spark: SparkSession) -> DataFrame:
    """The built-in keys; others are added by ``unionByName``."""
    return spark.createDataFrame(KNOWN, SCHEMA)


def _hex(value: Column) -> Column:
    h = F.regexp_replace(F.regexp_replace(F.upper(text.trim(value)), "^0X", ""), "[ \t:]", "")
    return F.when(F.rlike(h, F.lit("^([0-9A-F]{8}|[0-9A-F]{16}|[0-9A-F]{40})$")), h)


def _ssh_print(value: Column) -> Column:
    v = text.trim(value)
    return F.when(F.startswith(F.upper(v), F.lit("SHA256:")), F.concat(F.lit("SHA256:"), text.trim(F.substr(v, F.lit(8)))))


def _ssh_body(value: Column) -> Column:
    return F.nullif(F.regexp_extract(value, r"(?:^|[\s\x0B\x85\p{Z}])(AAAA[^\s\x0B\x85\p{Z}]{56,})", 1), F.lit(""))


def _hex_tokens(h: Column) -> list[Column]:
    """A key's number and the shorter ones at its end."""
    return [h, F.when(F.length(h) >= 16, F.right(h, F.lit(16))), F.when(h.isNotNull(), F.right(h, F.lit(8)))]


def query_tokens(value: Column) -> Column:
    """What a key, fingerprint or public key may be known by, most specific first."""
    return F.array_distinct(F.array_compact(F.array(*_hex_tokens(_hex(value)), _ssh_print(value), _ssh_body(value))))


def key_tokens(entries: DataFrame) -> DataFrame:
    """(token, owner) of all keys; of keys with the same token the first by owner counts."""
    print_, key_id = _hex(F.col("fingerprint")), _hex(F.col("key_id"))
    tokens = F.array_distinct(F.array_compact(F.array(*_hex_tokens(print_), F.when(print_.isNull(), _ssh_print(F.col("fingerprint"))), key_id, F.when(key_id.isNotNull(), F.right(key_id, F.lit(8))), _ssh_body(F.col("ssh_key")))))
    return entries.select("owner", F.explode(tokens).alias("token")).groupBy("token").agg(F.min("owner").alias("owner"))


def normal_email(value: Column) -> Column:
    e = F.regexp_replace(F.lower(text.trim(value)), "^[<>\"' ]+|[<>\"' ]+$", "")
    return F.when(F.contains(e, F.lit("@")), e)


def known_good(df: DataFrame, keys: list[str], token: str, entries: DataFrame) -> DataFrame:
    """(keys, token, owner): the rows whose key, fingerprint, public key or mail address is known; the most specific token counts."""
    own = df.select(*keys, token, F.posexplode(F.concat(query_tokens(F.col(token)), F.array_compact(F.array(normal_email(F.col(token)))))).alias("k_at", "k_token"))
    mails = entries.select(normal_email(F.col("email")).alias("token"), "owner").where("token IS NOT NULL").groupBy("token").agg(F.min("owner").alias("owner"))
    hit = own.join(key_tokens(entries).unionByName(mails).withColumnRenamed("token", "k_token"), "k_token")
    return hit.groupBy(*keys, token).agg(F.min_by("owner", "k_at").alias("owner"))


def unattributed(df: DataFrame, token: str, entries: DataFrame) -> DataFrame:
    """The rows whose key or identity is not known to be a platform's: those that may be attributed to an actor."""
    hit = known_good(df.select(F.col(token).alias("k_value")).where("k_value IS NOT NULL").distinct(), [], "k_value", entries)
    return df.join(hit.select(F.col("k_value").alias(token)), token, "left_anti").select(*df.columns)
