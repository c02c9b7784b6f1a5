"""The subpackage's queries, with production parameters, over whole tables; and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import curriculum, decontam, extract, hostrep, langid, media, ngram_join, rans, toxicity, warc
from .common import documents, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir))


def op3_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.assemble(warc.parse(warc.page_records(table(spark, sf_dir, "pages"))))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(documents(spark, sf_dir)).select("doc_id", "lang", "pred_family", "family_margin", "pred_lang", "lang_margin")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(media.page_pictures(table(spark, sf_dir, "pages")))


def op6_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrep.reputation(table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_text(table(spark, sf_dir, "pages"))


def op8_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.pack(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", *[F.col(f"p_{x}") for x in (*toxicity.CATEGORIES, "toxic")], "toxic")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.mix(documents(spark, sf_dir)).withColumn("position", F.round("position", 9))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_benchmark_decontamination, op2_ngram_jaccard_join, op3_warc_transactions, op4_language_id, op5_media_columns, op6_host_reputation, op7_html_extraction, op8_token_blocks, op9_toxicity, op10_mix_sources)}


_WORDS = r"regexp_extract_all(lower(text), '[0-9a-z\x{C0}-\x{1FFF}\x{2080}-\x{2FFF}\x{3040}-\x{10FFFF}]+')"

NGRAM_JOIN = rf"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
ids AS (SELECT DISTINCT doc_id, w FROM words WHERE len(w) > 0),
reps AS (SELECT w, min(doc_id) AS rep, count(*) AS copies FROM ids GROUP BY w),
grams AS (SELECT DISTINCT rep, CASE WHEN len(w) < {ngram_join.GRAM} THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + {ngram_join.GRAM - 1}], ' ') END AS g
          FROM (SELECT rep, w, unnest(range(1, greatest(len(w) - {ngram_join.GRAM - 2}, 2))) AS i FROM reps)),
sizes AS (SELECT rep, count(*) AS n FROM grams GROUP BY rep),
common AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep),
near AS MATERIALIZED (SELECT a, b FROM common JOIN sizes x ON x.rep = a JOIN sizes y ON y.rep = b WHERE c::DOUBLE / (x.n + y.n - c) >= {ngram_join.THRESHOLD}),
edges AS MATERIALIZED (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT a, a AS b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
classes AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a), links AS (SELECT a AS rep, count(*) AS links FROM edges GROUP BY a)
SELECT doc_id, coalesce(class_id, rep) AS class_id, copies, coalesce(links, 0) AS links FROM ids JOIN reps USING (w) LEFT JOIN classes USING (rep) LEFT JOIN links USING (rep)
UNION ALL
SELECT DISTINCT doc_id, doc_id, 1, 0 FROM words WHERE coalesce(len(w), 0) = 0
"""

MIX = rf"""
WITH d AS (SELECT *, coalesce(len(regexp_extract_all(text, '{curriculum.SPACES}')), 0)::BIGINT AS n_tokens, md5('mix/' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
supply AS (SELECT source, sum(n_tokens)::DOUBLE AS s FROM d GROUP BY source HAVING sum(n_tokens) > 0),
named AS (SELECT source, s, pow(s, {curriculum.TEMPERATURE}) AS base, CASE WHEN row_number() OVER (ORDER BY source NULLS FIRST) - 1 >= count(*) OVER () / 2.0 THEN 1 ELSE -1 END AS way FROM supply),
raw AS (SELECT source, s, base * (1 - way * {curriculum.RAMP}) AS w0, base AS w1, base * (1 + way * {curriculum.RAMP}) AS w2 FROM named),
plan AS (SELECT source, s, w0 / sum(w0) OVER () AS a, w1 / sum(w1) OVER () AS b, w2 / sum(w2) OVER () AS c FROM raw),
demand AS (SELECT *, (a + b) / 4 AS half, (a + b) / 4 + (b + c) / 4 AS whole FROM plan),
budget AS (SELECT ceil(max(s / whole)) AS t FROM demand),
epochs AS (SELECT demand.*, t, unnest(range(0, greatest(ceil(t * whole / s), 1)::BIGINT)) AS epoch FROM demand, budget),
cum AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source ORDER BY h, doc_id, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before FROM d),
x AS (SELECT cum.*, e.epoch, (e.epoch * s + before) / t AS x, a, b, c, half, whole FROM cum JOIN epochs e ON cum.source IS NOT DISTINCT FROM e.source),
part AS (SELECT *, CASE WHEN x < half THEN 0.0 ELSE 0.5 END AS t0, CASE WHEN x < half THEN a ELSE b END AS wa, CASE WHEN x < half THEN b ELSE c END AS wb, CASE WHEN x < half THEN x ELSE x - half END AS rest FROM x WHERE x < whole)
SELECT doc_id, text, lang, source, n_chars, epoch::INTEGER AS epoch, n_tokens, round(t0 + CASE WHEN rest <= 0 THEN 0 ELSE 2 * rest / (wa + sqrt(greatest(wa * wa + 2 * (wb - wa) / 0.5 * rest, 0))) END, 9) AS position FROM part
"""


_RHO = "CASE WHEN sum((n - 1) * {m} * (1 - {m})) > 0 THEN least(greatest((sum(n * (k / n - {m}) * (k / n - {m})) - sum({m} * (1 - {m}))) / sum((n - 1) * {m} * (1 - {m})), %s), %s) ELSE %s END" % hostrep.RHO
#: The incomplete beta function as a power series, with all the terms that count where x is at most the mean.
_SERIES = "exp({a} * ln({x}) + {b} * ln(1 - {x}) - ln({a}) - lgamma({a}) - lgamma({b}) + lgamma({a} + {b})) * list_sum(list_transform(range(0, 3000), lambda i: exp(lgamma({a} + {b} + i) - lgamma({a} + {b}) - lgamma({a} + 1 + i) + lgamma({a} + 1) + i * ln({x}))))"
_TWO = "array_to_string(list_slice(string_split(host, '.'), -2, -1), '.')"
_IN = ", ".join(f"'{x}'" for x in hostrep.TWO_LABEL_SUFFIXES)

HOST_REPUTATION = rf"""
WITH RECURSIVE p AS (SELECT page_id, url, nullif(regexp_replace(lower(regexp_extract(url, '{hostrep.HOST}', 1)), '\.+$', ''), '') AS host FROM pages),
q AS (SELECT *, CASE WHEN regexp_matches(host, '^\[|^[0-9.]+$') THEN host WHEN {_TWO} IN ({_IN}) THEN {_TWO} ELSE list_extract(string_split(host, '.'), -1) END AS suffix,
      CASE WHEN regexp_matches(host, '^\[|^[0-9.]+$') THEN host WHEN {_TWO} IN ({_IN}) THEN array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') ELSE {_TWO} END AS domain FROM p),
placed AS (SELECT *, coalesce(suffix, '') AS hs, coalesce(domain, '') AS hd, coalesce(host, '') AS hh FROM q),
outcome AS (SELECT doc_id, CASE WHEN max(quality) > 0 THEN 1 ELSE 0 END AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
h AS (SELECT hs, hd, hh, count(*)::DOUBLE AS n, sum(good)::DOUBLE AS k FROM placed JOIN outcome ON page_id = doc_id GROUP BY ALL),
d AS (SELECT hs, hd, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
s AS (SELECT hs, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
o AS (SELECT CASE WHEN sum(n) > 0 THEN sum(k) / sum(n) ELSE 0.5 END AS m0 FROM s),
s0 AS (SELECT s.*, m0 FROM s, o), s1 AS (SELECT hs, (k + r * m0) / (n + r) AS m1 FROM s0, (SELECT 1 / ({_RHO.format(m="m0")}) - 1 AS r FROM s0)),
d0 AS (SELECT d.*, m1 FROM d JOIN s1 USING (hs)), d1 AS (SELECT hs, hd, (k + r * m1) / (n + r) AS m2 FROM d0, (SELECT 1 / ({_RHO.format(m="m1")}) - 1 AS r FROM d0)),
h0 AS (SELECT h.*, m2 FROM h JOIN d1 USING (hs, hd)), strength AS (SELECT 1 / ({_RHO.format(m="m2")}) - 1 AS r FROM h0),
j AS (SELECT placed.*, coalesce(h.n, 0) AS n, coalesce(h.k, 0) AS k, coalesce(m2, m1, m0) AS m, r FROM placed LEFT JOIN h USING (hs, hd, hh) LEFT JOIN d1 USING (hs, hd) LEFT JOIN s1 USING (hs), o, strength),
ab AS (SELECT *, (k + r * m) / (n + r) AS mean, greatest(k + r * m, {hostrep.LEAST}) AS pa, greatest(n - k + r * (1 - m), {hostrep.LEAST}) AS pb FROM j),
pairs AS MATERIALIZED (SELECT DISTINCT pa, pb FROM ab),
search AS (SELECT pa, pb, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS step FROM pairs
  UNION ALL SELECT pa, pb, CASE WHEN cdf < {hostrep.TAIL} THEN mid ELSE lo END, CASE WHEN cdf < {hostrep.TAIL} THEN hi ELSE mid END, step + 1
  FROM (SELECT *, CASE WHEN mid <= pa / (pa + pb) THEN {_SERIES.format(x="mid", a="pa", b="pb")} ELSE 1 - {_SERIES.format(x="(1 - mid)", a="pb", b="pa")} END AS cdf FROM (SELECT *, (lo + hi) / 2 AS mid FROM search WHERE step < {hostrep.STEPS}))),
res AS (SELECT ab.*, round((lo + hi) / 2, {hostrep.DIGITS}) AS bound FROM ab JOIN search USING (pa, pb) WHERE step = {hostrep.STEPS})
SELECT page_id, url, host, domain, suffix, n::BIGINT AS host_labelled, k::BIGINT AS host_good, round(mean, {hostrep.DIGITS}) AS reputation, bound AS reputation_bound, bound >= {hostrep.KEEP_AT} AS keep FROM res
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard_join": NGRAM_JOIN, "op6_host_reputation": HOST_REPUTATION, "op10_mix_sources": MIX}
