"""Indicators of compromise and artifact hashes taken from package texts; known-bad hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import allow, text
from ..functions.regex import to_java

#: Indicators kept of one package, in order of extraction.
CAP = 60
IPV4 = r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
URL = r"https?://[^\s'\")\\]+"
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
INSTALL = r"\b(?:bun|npm|pip3?|pnpm|yarn)\s+(?:install|add|i)\b[^\n;&|]*"
WALLETS = (("monero", r"\b4[0-9AB][1-9A-HJ-NP-Za-km-z]{93}\b"), ("ethereum", r"\b0x[a-fA-F0-9]{40}\b"), ("bitcoin", r"\b(?:bc1[a-z0-9]{25,87}|[13][a-km-zA-HJ-NP-Z1-9]{25,34})\b"))
SUMS = r"(?ms)^(?:b2|md5|sha1|sha224|sha256|sha384|sha512)sums(?:_[a-zA-Z0-9_]+)?\s*=\s*\((.*?)\)"
HASH64 = r"\b[a-fA-F0-9]{64}\b"
EXFIL = (
    "0x0.st", "api.telegram.org/bot", "bit.ly/", "ddns.net", "discord.com/api/webhooks", "discordapp.com/api/webhooks", "duckdns.org", "dynu.com", "hastebin.com", "is.gd/", "ix.io", "ngrok-free.app",
    "ngrok.io", "no-ip.com", "paste.ee", "pastebin.com", "ptpb.pw", "requestbin", "short.io/", "t.co/", "termbin.com", "tinyurl.com/", "transfer.sh", "v.gd/", "webhook.site",
)


def _all(value: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(value, F.lit(to_java(pattern)), F.lit(group))


def added_lines(diff: Column) -> Column:
    """Lines that a unified diff adds."""
    plus = F.filter(text.lines(F.coalesce(diff, F.lit(""))), lambda x: F.startswith(x, F.lit("+")) & ~F.startswith(x, F.lit("+++")))
    return F.transform(plus, lambda x: F.substr(x, F.lit(2)))


def is_checksums(line: Column) -> Column:
    """Whether a line holds nothing but quoted hashes and SKIP."""
    bare = F.regexp_replace(F.regexp_replace(text.trim(line), r"^[()]+|[()]+\z", ""), "['\"]", " ")
    words = F.filter(F.split(bare, r"[\s\x0B\x85\p{Z}]+"), lambda x: x != "")
    return (F.size(words) > 0) & F.forall(words, lambda x: (x == "SKIP") | (F.rlike(x, F.lit("^[a-fA-F0-9]+$")) & (F.octet_length(x) >= 32)))


def _diff_hashes(diff: Column) -> Column:
    free = F.filter(added_lines(diff), lambda x: ~F.contains(F.lower(x), F.lit("sums")) & ~is_checksums(x))
    return F.flatten(F.transform(free, lambda x: _all(x, HASH64)))


def candidates(content: Column, diff: Column | None = None) -> Column:
    """Array of (type, value, ecosystem) in order of extraction, benign ones, repeats and the cap not yet considered."""

    def items(kind: str, values: Column, ecosystem: Column | str = "") -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), text.trim(F.regexp_replace(v, "^[\"'<>]+|[\"'<>]+\\z", "")).alias("value"), (F.lit(ecosystem) if isinstance(ecosystem, str) else ecosystem(v)).alias("ecosystem")))

    lower_marks = lambda u: F.exists(text.constants(EXFIL), lambda m: F.contains(F.lower(u), m))
    squeezed = F.transform(_all(content, INSTALL), lambda x: text.trim(F.regexp_replace(x, r"[\s\x0B\x85\p{Z}]+", " ")))
    quads = F.array_distinct(_all(content, IPV4))
    none = F.array().cast("array<struct<type:string,value:string,ecosystem:string>>")
    # an expression runs only on texts with a literal that it needs
    holds = lambda x: F.contains(content, F.lit(x))
    parts = [(holds("://"), items("exfil-endpoint", F.filter(_all(content, URL), lower_marks))), (F.rlike(content, F.lit(r"\d\.\d")), items("ipv4", F.filter(quads, lambda ip: ~ip.isin("127.0.0.1", "0.0.0.0") & ~allow.version_like(ip))))]
    needs = {"monero": F.rlike(content, F.lit("4[0-9AB][1-9A-HJ-NP-Za-km-z]{20}")), "ethereum": holds("0x"), "bitcoin": F.rlike(content, F.lit("(?:bc1|[13])[a-zA-Z0-9]{25}"))}
    parts += [(needs[name], items("wallet", F.array_distinct(_all(content, pattern)), name)) for name, pattern in WALLETS]
    installs = F.rlike(content, F.lit("bun|npm|pip|pnpm|yarn"))
    parts += [(installs, items("install-command", squeezed, lambda v: F.when(F.startswith(F.lower(v), F.lit("pip")), "pypi").otherwise("npm"))), (holds("@"), items("email", F.array_distinct(_all(content, EMAIL))))]
    if diff is not None:
        parts.append((F.lit(True), items("file-hash", _diff_hashes(diff), "sha256")))
    return F.concat(*[F.when(when, part).otherwise(none) for when, part in parts])


def extract(df: DataFrame, keys: list[str], content: Column, diff: Column | None = None, cap: int = CAP) -> DataFrame:
    """(keys, seq, type, value, ecosystem): the first ``cap`` indicators of each row, by order of extraction.

    Benign values are left out and a value counts once per type, whatever its case. All is done inside the row: nothing is
    shuffled, and rows may repeat.
    """
    own = df.withColumn("x_items", candidates(content, diff))
    own = own.withColumn("x_names", F.transform("x_items", lambda i: F.concat(i["type"], F.lit("|"), F.lower(i["value"]))))
    once = F.transform(F.array_distinct("x_names"), lambda n: F.element_at("x_items", F.array_position("x_names", n).cast("int")))
    kept = F.slice(F.filter(once, lambda i: (i["value"] != "") & ~F.coalesce(_benign(i["type"], i["value"]), F.lit(False))), 1, cap)
    return own.where(F.size("x_items") > 0).select(*keys, F.posexplode(kept).alias("at", "i")).select(*keys, (F.col("at") + 1).alias("seq"), "i.type", "i.value", "i.ecosystem")


def _benign(kind: Column, value: Column) -> Column:
    """``allow.benign`` of the kinds that are extracted here, as an expression."""
    return F.when(kind == "ipv4", allow.benign_ipv4(value)).when(kind == "email", allow.benign_domain(text.host_of(value))).otherwise(False)


def _once(values: Column) -> Column:
    """Values without those that repeat an earlier one in another case."""
    low = F.transform(values, F.lower)
    return F.filter(values, lambda v, k: F.array_position(low, F.lower(v)) == k + 1)


def declared_hashes(recipe: Column) -> Column:
    """Hashes in a recipe's checksum arrays, in order, each once."""
    return _once(F.flatten(F.transform(_all(F.coalesce(recipe, F.lit("")), SUMS, 1), lambda body: _all(body, "[a-fA-F0-9]{32,128}"))))


def candidate_hashes(recipe: Column, diff: Column) -> Column:
    """Declared hashes, then those that the latest diff adds outside checksum arrays."""
    return _once(F.concat(declared_hashes(recipe), _diff_hashes(diff)))


def normal_hash(value: Column) -> Column:
    """A hash in lower case without prefix and quotes; null if it is none."""
    h = F.regexp_replace(F.regexp_replace(F.lower(text.trim(value)), "^sha256:", ""), "^sha512:", "")
    h = F.regexp_replace(h, "^['\"]+|['\"]+\\z", "")
    return F.when(F.rlike(h, F.lit("^[0-9a-f]{32,}\\z")), h)


def hash_list(rows: DataFrame, column: str = "value") -> DataFrame:
    """(hash): a list of one hash per line; comments and what follows the hash are dropped."""
    token = F.regexp_extract(text.trim(F.col(column)), r"^[^ \t,#]+", 0)
    return rows.select(normal_hash(token).alias("hash")).where("hash IS NOT NULL").distinct()


def known_bad(df: DataFrame, keys: list[str], hashes: Column, bad: DataFrame) -> DataFrame:
    """Findings for hashes that are in ``bad(hash)``."""
    own = df.select(*keys, F.explode(hashes).alias("matched_line")).withColumn("hash", normal_hash(F.col("matched_line")))
    hit = own.join(bad.select("hash").distinct(), "hash", "left_semi")
    return hit.select(*keys, F.lit("B-KNOWN-BAD-HASH").alias("id"), F.lit("hash").alias("category"), F.lit("evidence").alias("class"), F.lit("CWE-506").alias("cwe"), F.lit(0).alias("points"), F.lit("a file's hash is known to be bad").alias("description"), "matched_line")
