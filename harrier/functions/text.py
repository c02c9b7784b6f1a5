"""Column functions on texts: lines, trimming, comments, entropy, hosts."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .regex import to_java

#: White space at either end, as Unicode has it.
_ENDS = r"^[\s\x0B\x85\p{Z}]+|[\s\x0B\x85\p{Z}]+\z"
RECIPE = r"(?m)^\s*((build|check|package|prepare)\s*\(\)\s*\{?|arch=\(|pkg(name|rel|ver)=|source(_[a-z0-9]+)?=\()"
PHP_DECLARATION = r"\bfunction\s+&?\s*(exec|passthru|popen|proc_open|shell_exec|system)\s*\("
PHP_BOOLEAN = r"assert\s*\(\s*\$[^)]*?(!=|!==|&&|->|::|<=|==|===|>=|\bcount\s*\(|\bin_array\s*\(|\bis_[a-z_]+\s*\(|instanceof|\|\|)"


def constants(values: Iterable[str]) -> Column:
    """A constant array of texts: one node of a plan, however many they are."""
    return F.split(F.lit("\1".join(values)), "\1", -1)


def lines(text: Column) -> Column:
    """Lines of a text, cut at line feeds only; one empty line for an empty text."""
    return F.split(text, "\n", -1)


def trim(text: Column) -> Column:
    return F.regexp_replace(text, _ENDS, "")


def is_comment(line: Column) -> Column:
    """Whether a line is one that no interpreter runs."""
    s = trim(line)
    return (
        F.startswith(s, F.lit("#")) | F.startswith(s, F.lit("//")) | F.startswith(s, F.lit("/*")) | F.startswith(s, F.lit("<!--")) | F.startswith(s, F.lit("-- ")) | (s == "*/")
        | (F.startswith(s, F.lit("* ")) & ~F.startswith(trim(F.substr(s, F.lit(3))), F.lit(")")))
    )


def is_recipe(text: Column) -> Column:
    """Whether a text looks like a build recipe."""
    return F.rlike(text, F.lit(to_java(RECIPE)))


@F.pandas_udf(DoubleType())
def entropy(texts: pd.Series) -> pd.Series:
    """Shannon entropy of the bytes, in bits a byte; 0 of an empty text. Bytes are counted in Arrow batches."""

    def one(value: str | None) -> float | None:
        if value is None:
            return None
        counts = np.bincount(np.frombuffer(value.encode(), np.uint8))
        share = counts[counts > 0] / max(counts.sum(), 1)
        return float(-(share * np.log2(share)).sum()) + 0.0

    return texts.map(one)


def byte_entropy(text: Column) -> Column:
    """The same as ``entropy`` as an expression, for use inside of arrays: each of the characters that occur in a Latin-1 reading of the bytes is counted by itself."""
    latin = F.decode(F.encode(text, "utf-8"), "ISO-8859-1")
    symbols = F.filter(F.array_distinct(F.split(latin, "")), lambda c: c != "")
    size = F.octet_length(text)
    share = lambda c: (F.length(latin) - F.length(F.replace(latin, c, F.lit("")))) / size
    bits = F.aggregate(F.transform(symbols, share), F.lit(0.0), lambda a, p: a - p * F.log2(p))
    return F.when(size > 0, bits).otherwise(F.when(text.isNotNull(), F.lit(0.0)))


def host_of(value: Column) -> Column:
    """The host of a url or mail address: lower case, without scheme, user, port, path and root dot."""
    v = F.lower(trim(value))
    v = F.regexp_replace(v, r"(?s)^.*?://", "")
    v = F.regexp_replace(v, r"(?s)^.*@", "")
    return norm_host(F.regexp_replace(v, r"(?s)[/?#].*$", ""))


def norm_host(host: Column) -> Column:
    """A host without its port, root dot and the brackets of an address. Each step uses the one before once, so that plans stay small."""
    h = F.regexp_replace(trim(F.lower(host)), r"\.\z", "")
    h = F.regexp_replace(h, r"(?s)^\[([^\]]+)\].*$", "$1")
    return F.regexp_replace(F.regexp_replace(h, r"(?s)^([^:]*):[^:]*$", "$1"), r"\.\z", "")
