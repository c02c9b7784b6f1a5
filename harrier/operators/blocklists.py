"""Blocklists of bad hosts: parsers of seven feed formats, and sets of (kind, value).

A feed is a row (feed, format, body). Tokens are taken from its lines by expressions and exploded; what is benign, a network
rather than a host, or malformed is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import allow, text
from ..functions.address import canonical_ip, host_address
from ..functions.regex import to_java

FORMATS = ("iplist", "netset", "hosts", "rss", "emails", "mixed", "misp")
KINDS = ("ipv4", "ipv6", "domain", "email")
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}(?:/\d{1,2})?\b"
IPV6 = r"(?i)\b(?:[0-9a-f]{0,4}:){2,7}[0-9a-f]{0,4}(?:/\d{1,3})?\b"
_HOST = r"(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}"
DOMAIN = rf"(?i)\b{_HOST}\b"
EMAIL = rf"(?i)\b[a-z0-9._%+\-]+@{_HOST}\b"
MISP = "struct<Event:struct<Attribute:array<struct<type:string,value:string,to_ids:boolean,comment:string,Tag:array<struct<name:string>>>>>>"
_MAILS = ("email-src", "email-dst", "target-email", "whois-registrant-email")
_ADDRESSES = ("ip-src", "ip-dst", "ip-src|port", "ip-dst|port")
TOKEN = "array<struct<kind:string,token:string>>"
_BLANKS = r"[\s\x0B\x85\p{Z}]+"


def _all(value: Column, pattern: str) -> Column:
    return F.regexp_extract_all(value, F.lit(to_java(pattern)), F.lit(0))


def _of(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("token")))


def _addresses(value: Column) -> Column:
    return F.concat(_of("4", _all(value, IPV4)), _of("6", _all(value, IPV6)))


def first_token(line: Column) -> Column:
    """The first field of a line; empty for blank lines and comments."""
    s = text.trim(line)
    return F.when(F.rlike(s, F.lit("^[#;]")), "").otherwise(F.regexp_extract(s, "^[^ \t,;#]+", 0))


def _plain(body: Column) -> Column:
    """The text of a feed in XML."""
    s = F.regexp_replace(F.regexp_replace(body, r"<!\[CDATA\[(.*?)\]\]>", " $1 "), "<[^>]+>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def _host_fields(line: Column) -> Column:
    """The names of a line of a hosts file, without the address in front."""
    fields = F.filter(F.split(line, _BLANKS), lambda x: x != "")
    ip = F.try_element_at(fields, F.lit(1))
    address = F.rlike(ip, F.lit(allow.QUAD)) | (F.contains(ip, F.lit(":")) & F.rlike(ip, F.lit(r"(?i)^[0-9a-f:.]*:[0-9a-f:.]*$")))
    return F.when((F.size(fields) >= 2) & address, F.slice(fields, 2, F.size(fields))).otherwise(fields)


def tokens(kind: Column, body: Column) -> Column:
    """Array of (kind, token) that a feed's body may hold, by its format: 4 and 6 for addresses, d for names, e for mail addresses."""
    lines = F.split(F.replace(body, F.lit("\r\n"), F.lit("\n")), "\n", -1)
    plain = F.split(F.replace(_plain(body), F.lit("\r\n"), F.lit("\n")), "\n", -1)
    mixed = lambda rows: F.flatten(F.transform(rows, lambda x: F.concat(_addresses(x), _of("d", _all(x, DOMAIN)))))
    benign = lambda a: F.contains(F.lower(F.coalesce(a.comment, F.lit(""))), F.lit("reputation: benign")) | F.exists(F.coalesce(a.Tag, F.array().cast("array<struct<name:string>>")), lambda t: F.lower(t["name"]) == "reputation:benign")

    def attribute(a: Column) -> Column:
        t, v = F.lower(text.trim(F.coalesce(a.type, F.lit("")))), text.trim(F.coalesce(a.value, F.lit("")))
        names = _of("d", _all(v, DOMAIN))
        return F.when(t.isin(*_ADDRESSES), _addresses(v)).when(t == "domain|ip", F.concat(_addresses(v), names)).when(t.isin(*_MAILS), _of("e", _all(v, EMAIL))).otherwise(names).cast(TOKEN)

    events = F.filter(F.coalesce(F.from_json(body, MISP).Event.Attribute, F.array().cast("array<struct<type:string,value:string,to_ids:boolean,comment:string,Tag:array<struct<name:string>>>>")), lambda a: F.coalesce(a.to_ids, F.lit(True)) & ~benign(a))
    return (
        F.when(kind == "misp", F.flatten(F.transform(events, attribute)))
        .when(kind == "emails", F.flatten(F.transform(lines, lambda x: _of("e", _all(x, EMAIL)))))
        .when(kind == "hosts", F.flatten(F.transform(lines, lambda x: _of("d", _host_fields(x)))))
        .when(kind == "rss", mixed(plain))
        .when(kind == "mixed", mixed(lines))
        .when(kind.isin("iplist", "netset"), F.flatten(F.transform(lines, lambda x: _addresses(first_token(x)))))
    ).cast(TOKEN)


def _domain(token: Column) -> Column:
    d = F.regexp_replace(F.lower(text.trim(token)), r"\.\z", "")
    return F.when(F.rlike(d, F.lit(f"^{_HOST}$")) & ~F.rlike(d, F.lit(allow.QUAD)) & ~allow.benign_domain(d), d)


def _email(token: Column) -> Column:
    e = F.lower(text.trim(token))
    return F.when(F.rlike(e, F.lit(rf"^[a-z0-9_][a-z0-9._%+\-]*@{_HOST}$|^[a-z0-9._%+\-]*[a-z0-9_][a-z0-9._%+\-]*@{_HOST}$")) & ~allow.benign_domain(F.substring_index(e, "@", -1)), e)


def classified(rows: DataFrame, kind: str, token: str, *keep: str) -> DataFrame:
    """(keep, kind, value): tokens in the form that sets hold; those that are no host, or a benign one, are left out."""
    k, t = F.col(kind), F.col(token)
    own = rows.select(*keep, k.alias("b_kind"), t.alias("b_token"), host_address(F.when(k.isin("4", "6"), t)).alias("b_ip"))
    k, t, ip = F.col("b_kind"), F.col("b_token"), F.col("b_ip")
    own = own.select(*keep, "b_kind", F.when(k == "d", _domain(t)).when(k == "e", _email(t)).otherwise(F.when(~allow.benign_ip(ip), ip)).alias("value"))
    six = F.contains("value", F.lit(":"))
    own = own.where(F.col("value").isNotNull() & ~((F.col("b_kind") == "4") & six) & ~((F.col("b_kind") == "6") & ~six))
    return own.select(*keep, F.when(F.col("b_kind") == "d", "domain").when(F.col("b_kind") == "e", "email").when(six, "ipv6").otherwise("ipv4").alias("kind"), "value")


def parse(feeds: DataFrame) -> DataFrame:
    """(feed, kind, value), each once, of feeds(feed, format, body). A body that is null, or no JSON where it should be, holds nothing."""
    found = feeds.select("feed", F.explode(tokens(F.col("format"), F.col("body"))).alias("t")).select("feed", F.col("t.kind").alias("t_kind"), F.col("t.token").alias("t_token"))
    return classified(found, "t_kind", "t_token", "feed").distinct()


def counts(parsed: DataFrame, feeds: DataFrame) -> DataFrame:
    """(feed, ok, ipv4, ipv6, domains, emails): what each feed holds; a feed without a body is not ok."""
    n = lambda kind, name: F.count(F.when(F.col("kind") == kind, 1)).alias(name)
    by = parsed.groupBy("feed").agg(n("ipv4", "ipv4"), n("ipv6", "ipv6"), n("domain", "domains"), n("email", "emails"))
    names = ("ipv4", "ipv6", "domains", "emails")
    return feeds.select("feed", (F.length("body") > 0).alias("f_ok")).join(by, "feed", "left").select("feed", F.coalesce("f_ok", F.lit(False)).alias("ok"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names])


def of_tokens(rows: DataFrame, column: str = "value") -> DataFrame:
    """(kind, value), each once, of single tokens: a mail address has an @, an address reads as one, everything else is a name."""
    t = text.trim(F.col(column))
    bare = F.regexp_replace(t, r"^[\[\]]+|[\[\]]+$", "")
    own = rows.where(t != "").select(bare.alias("t_token"), F.contains(t, F.lit("@")).alias("t_mail"), canonical_ip(bare).alias("t_ip"))
    kind = F.when(F.col("t_mail"), "e").when(F.contains("t_ip", F.lit(":")), "6").when(F.col("t_ip").isNotNull(), "4").otherwise("d")
    return classified(own.select(kind.alias("t_kind"), F.coalesce(F.when(~F.col("t_mail"), F.col("t_ip")), F.col("t_token")).alias("t_token")), "t_kind", "t_token").distinct()


def of_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(kind, value) of the lines of list files: the first token of each, comments left out."""
    token = F.regexp_extract(text.trim(F.col(column)), "^[^ \t,#]+", 0)
    return of_tokens(lines.select(token.alias("value")).where("value <> ''"))


def merge(*sets: DataFrame) -> DataFrame:
    out = sets[0].select("kind", "value")
    for other in sets[1:]:
        out = out.unionByName(other.select("kind", "value"))
    return out.distinct()


def members(df: DataFrame, column: str, blocklist: DataFrame, *kinds: str) -> DataFrame:
    """The rows whose value is in the set, whatever its form: addresses are compared in canonical form, names and mail addresses without case."""
    kinds = kinds or KINDS
    low = F.regexp_replace(F.lower(text.trim(F.col(column))), r"\.\z", "")
    key = F.coalesce(canonical_ip(F.regexp_replace(F.col(column), r"^\s*[\[\]]+|[\[\]]+\s*$", "")), low)
    return df.withColumn("b_key", key).join(blocklist.where(F.col("kind").isin(*kinds)).select(F.col("value").alias("b_key")).distinct(), "b_key", "left_semi").select(*df.columns)
