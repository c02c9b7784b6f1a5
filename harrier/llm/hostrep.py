"""Empirical-Bayes reputation of hosts.

Labelled pages are good or bad. A host's share of good pages is shrunk towards its registered domain's, that towards its public
suffix's, and that towards the overall share: at every level the parent's mean and a strength estimated from all children (by
the method of moments for a beta-binomial) are the prior. Pages are kept by a lower bound of their host's posterior, a quantile
of its beta distribution.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import saved

#: Suffixes of two labels under which names are registered, by country and by service; any other suffix is the last label. For
#: the whole public list, give its names of two labels.
TWO_LABEL_SUFFIXES = (
    *(f"{x}.{c}" for c in ("uk", "au", "jp", "br", "cn", "mx", "ar", "tr", "in", "kr", "nz", "za", "sg", "tw", "hk", "my", "th", "id", "il", "ua", "pl", "pt", "ve", "co", "pe", "ph", "vn", "eg", "ng", "ke", "pk", "bd", "sa", "ae") for x in ("com", "co", "org", "net", "edu", "gov", "ac", "or", "ne", "go")),
    "ltd.uk", "me.uk", "plc.uk", "sch.uk", "id.au", "asn.au", "ad.jp", "ed.jp", "gr.jp", "lg.jp", "gen.nz", "geek.nz", "school.nz", "web.za", "nom.co", "github.io", "gitlab.io", "blogspot.com", "herokuapp.com", "netlify.app", "vercel.app", "pages.dev", "workers.dev",
)
#: Share of the posterior below the bound by which a host is judged.
TAIL = 0.05
KEEP_AT = 0.7
#: Halvings of the range of a quantile, and the least that a parameter of the posterior counts as.
STEPS, LEAST = 44, 1e-3
#: Bounds of the estimated correlation within a parent, and its value where nothing can be estimated.
RHO = (0.001, 0.95, 0.1)
#: Digits that results are rounded to, so that they do not depend on the order of sums.
DIGITS = 6

HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)"


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction (Lentz's method)."""
    flip = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    tiny = 1e-300
    lead = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(np.maximum(x, tiny)) + b * np.log1p(-np.minimum(x, 1 - 1e-16)))
    c, d = np.ones_like(x), 1 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.abs(d * c - 1).max(initial=0) < 1e-15:
            break
    own = lead * h / a
    return np.where(flip, 1 - own, own)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    import math

    return np.array([math.lgamma(v) for v in x])


def beta_quantile(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where the beta distributions' lower tails are ``p``, by bisection."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    low, high = np.zeros_like(a), np.ones_like(a)
    for _ in range(STEPS):
        middle = (low + high) / 2
        under = beta_cdf(middle, a, b) < p
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return (low + high) / 2


def _bound(tail: float) -> Callable[[F.Column, F.Column], F.Column]:
    @F.pandas_udf(DoubleType())
    def own(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs, which = np.unique(np.stack([a.to_numpy(float), b.to_numpy(float)], 1), axis=0, return_inverse=True)
        return pd.Series(beta_quantile(tail, pairs[:, 0], pairs[:, 1])[which.reshape(-1)] if len(pairs) else np.zeros(0))

    return own


def hosts(pages: DataFrame, two_label: Iterable[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """Adds host, domain and suffix, all null where the url has no host; of an address in numbers, all three are the address."""
    listed = F.split(F.lit(" ".join(two_label)), " ")
    host = F.nullif(F.regexp_replace(F.lower(F.regexp_extract("url", HOST, 1)), r"\.+$", ""), F.lit(""))
    number = F.col("host").rlike(r"^\[|^[0-9.]+$")
    two = F.substring_index("host", ".", -2)
    suffix = F.when(number, F.col("host")).when(F.array_contains(listed, two), two).otherwise(F.substring_index("host", ".", -1))
    domain = F.when(number, F.col("host")).when(F.array_contains(listed, two), F.substring_index("host", ".", -3)).otherwise(two)
    return pages.withColumn("host", host).withColumn("suffix", suffix).withColumn("domain", domain)


def _rho(children: DataFrame, mean: F.Column) -> F.Column:
    """Correlation within the parent, over children with n labelled pages, k of them good, whose parents have the mean."""
    spread = mean * (1 - mean)
    s = F.sum(F.col("n") * (F.col("k") / F.col("n") - mean) * (F.col("k") / F.col("n") - mean))
    q, r = F.sum(spread), F.sum((F.col("n") - 1) * spread)
    return F.when(r > 0, F.least(F.greatest((s - q) / r, F.lit(RHO[0])), F.lit(RHO[1]))).otherwise(RHO[2])


def reputation(pages: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT, tail: float = TAIL, two_label: Iterable[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """Adds host, domain, suffix, host_labelled, host_good, reputation (posterior mean), reputation_bound and keep to pages.

    ``labels(doc_id, quality)`` name pages by page_id; of repeated labels of a page the best counts, null ones do not.
    Pages without a host belong to one nameless host. A host without labelled pages has its domain's mean, at the strength of
    the prior alone; a domain without any has its suffix's, and so on up to 0.5 if nothing is labelled. keep is
    reputation_bound >= keep_at, and ``filter_pages`` keeps only those. The bound is the quantile ``tail`` of the host's beta
    posterior. Every row is judged, repeated ones too, and a repeated page's outcome counts once per row. Input columns of
    these names are replaced, others stay whatever they are called; an empty table gives an empty result. Without labels every
    page has 0.5. Labelled pages are counted, and levels written to the shared folder, when this is called.
    """
    names = ["host", "domain", "suffix", "host_labelled", "host_good", "reputation", "reputation_bound", "keep"]
    kept = [c for c in pages.columns if c.lower() not in names]
    own = pages.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept)], F.col("page_id").alias("h_page"), F.col("url"))
    placed = hosts(own, two_label)
    filled = {c: F.coalesce(F.col(c), F.lit("")).alias(f"h_{c}") for c in ("host", "domain", "suffix")}
    outcome = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("h_id")).agg((F.max("quality") > 0).cast("long").alias("good"))
    labelled = placed.select("h_page", *filled.values()).join(outcome, F.col("h_page") == F.col("h_id"))
    by_host = saved(labelled.groupBy("h_suffix", "h_domain", "h_host").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("k")))
    by_domain = by_host.groupBy("h_suffix", "h_domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    by_suffix = by_domain.groupBy("h_suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    overall = by_suffix.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).select(F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(0.5).alias("m0"))

    def shrunk(level: DataFrame, mean: str, out: str) -> DataFrame:
        strength = level.agg(_rho(level, F.col(mean)).alias("h_rho")).select((1 / F.col("h_rho") - 1).alias(f"s_{out}"))
        # one row
        return level.crossJoin(F.broadcast(strength)).withColumn(out, (F.col("k") + F.col(f"s_{out}") * F.col(mean)) / (F.col("n") + F.col(f"s_{out}")))

    suffixes = saved(shrunk(by_suffix.crossJoin(F.broadcast(overall)), "m0", "m1"))
    domains = saved(shrunk(by_domain.join(suffixes.select("h_suffix", "m1"), "h_suffix"), "m1", "m2"))
    seen = by_host.join(domains.select("h_suffix", "h_domain", "m2"), ["h_suffix", "h_domain"])
    strength = seen.agg(_rho(seen, F.col("m2")).alias("h_rho")).select((1 / F.col("h_rho") - 1).alias("s_host"))
    judged = (
        placed.select("*", *filled.values())
        .join(by_host.select("h_suffix", "h_domain", "h_host", F.col("n").alias("h_n"), F.col("k").alias("h_k")), ["h_suffix", "h_domain", "h_host"], "left")
        .join(domains.select("h_suffix", "h_domain", "m2"), ["h_suffix", "h_domain"], "left")
        .join(suffixes.select("h_suffix", "m1"), ["h_suffix"], "left")
        .crossJoin(F.broadcast(overall))
        .crossJoin(F.broadcast(strength))
    )
    mean = F.coalesce("m2", "m1", "m0")
    n, k = F.coalesce("h_n", F.lit(0)), F.coalesce("h_k", F.lit(0))
    a, b = k + F.col("s_host") * mean, n - k + F.col("s_host") * (1 - mean)
    judged = judged.withColumn("host_labelled", n).withColumn("host_good", k).withColumn("h_a", a).withColumn("h_b", b)
    a, b = F.col("h_a"), F.col("h_b")
    average = a / (a + b)
    judged = judged.withColumn("reputation", F.round(average, DIGITS))
    judged = judged.withColumn("reputation_bound", F.round(_bound(tail)(F.greatest(a, F.lit(LEAST)), F.greatest(b, F.lit(LEAST))), DIGITS))
    judged = judged.withColumn("keep", F.col("reputation_bound") >= keep_at)
    return judged.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(kept)], *names)


def filter_pages(pages: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """The pages of hosts whose bound reaches ``keep_at``, with the input's columns."""
    return reputation(pages, labels, keep_at).where("keep").select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "domain", "suffix", "host_labelled", "host_good", "reputation", "reputation_bound", "keep")])
