"""Mixing sources to target weights that change over training.

Each source has a weight at every knot of training time (0 to 1), linear in between; at each knot the weights are scaled to sum
to 1. The integral of a source's weight up to time t, times the token budget, is its cumulative demand. A document that starts
at cumulative token c of its source is placed at the time when the demand reaches c, and documents are range-sorted by that
position. Sources go round again (epochs) until their demand is met.

Running token counts are taken in two levels: sums per (source, hash bucket) first, then inside each bucket, so no task ever
holds a whole source. They are taken on rows without text. By the schedule tokens are spread evenly over positions, so equal
stretches of positions make equal partitions; the narrow rows give the hash at which each source enters each stretch, and the
texts move once, straight to their stretch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Sources' base weights are their token shares to this power, so small sources are raised.
TEMPERATURE = 0.85
#: Knots of the schedule, and how much the weight of the later half of the sources (by name) grows towards the end.
KNOTS = (0.0, 0.5, 1.0)
RAMP = 0.3
#: Documents whose running counts one window holds, about; such a row has no text.
BUCKET_ROWS = 100_000
#: Tokens in a partition of the result, about.
PARTITION_TOKENS = 8_000_000
SPACES = r"[^ \t\n\r\f]+"


def token_count(text: str = "text") -> F.Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(SPACES)), F.lit(0)).cast("long")


def _hash(seed: str) -> F.Column:
    return F.md5(F.concat_ws("/", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def training_order(seed: str = "mix") -> list[F.Column]:
    """What the rows of ``mix`` (with ``report``) are in the order of: their order on files is lost when those are read."""
    return [F.col("position"), _hash(seed), F.col("epoch")]


def _sums(docs: DataFrame, seed: str) -> DataFrame:
    """(h_source, h_hash, h_rows, h_sum): documents and tokens by source and hash, that is about by document."""
    narrow = docs.select(F.col("source").cast("string").alias("h_source"), _hash(seed).alias("h_hash"), token_count().alias("h_n"))
    return narrow.groupBy("h_source", "h_hash").agg(F.count(F.lit(1)).alias("h_rows"), F.sum("h_n").alias("h_sum"))


def default_schedule(supply: Mapping[str | None, int], temperature: float = TEMPERATURE, knots: Sequence[float] = KNOTS, ramp: float = RAMP) -> dict[str | None, list[tuple[float, float]]]:
    """Weights by source at the knots: shares to the power ``temperature``; the first half of the sources by name falls by ``ramp`` from start to end, the second half rises."""
    names = sorted((s for s in supply if supply[s] > 0), key=lambda s: (s is not None, s))
    base = {s: supply[s] ** temperature for s in names}
    half = len(names) / 2
    return {s: [(t, base[s] * (1 + (1 if i >= half else -1) * ramp * (2 * t - 1))) for t in knots] for i, s in enumerate(names)}


def segments(schedule: Mapping[str | None, Sequence[tuple[float, float]]]) -> dict[str | None, list[tuple[float, float, float, float, float]]]:
    """By source: (start, end, weight at start, weight at end, integral before) of each stretch between knots, after scaling."""
    knots = sorted({t for points in schedule.values() for t, _ in points} | {0.0, 1.0})

    def at(points: Sequence[tuple[float, float]], t: float) -> float:
        points = sorted(points)
        if t <= points[0][0]:
            return points[0][1]
        for (t0, w0), (t1, w1) in zip(points, points[1:]):
            if t <= t1:
                return w0 + (w1 - w0) * (t - t0) / (t1 - t0)
        return points[-1][1]

    raw = {s: [at(p, t) for t in knots] for s, p in schedule.items()}
    if any(w < 0 for ws in raw.values() for w in ws):
        raise ValueError("weights must not be negative")
    totals = [sum(ws[k] for ws in raw.values()) for k in range(len(knots))]
    if raw and min(totals) <= 0:
        raise ValueError("at every knot some source needs a weight")
    out: dict[str | None, list[tuple[float, float, float, float, float]]] = {}
    for s, ws in raw.items():
        done, out[s] = 0.0, []
        for k in range(len(knots) - 1):
            a, b = ws[k] / totals[k], ws[k + 1] / totals[k + 1]
            out[s].append((knots[k], knots[k + 1], a, b, done))
            done += (a + b) / 2 * (knots[k + 1] - knots[k])
    return out


def _integral(parts: Sequence[tuple[float, float, float, float, float]]) -> float:
    t0, t1, a, b, done = parts[-1]
    return done + (a + b) / 2 * (t1 - t0)


def mix(
    docs: DataFrame, schedule: Mapping[str | None, Sequence[tuple[float, float]]] | None = None, budget: int | None = None, bucket_rows: int = BUCKET_ROWS, report: bool = True, seed: str = "mix"
) -> DataFrame:
    """The documents in training order, each as often as its source's demand needs it.

    ``schedule`` gives (time, weight) points by source; by default ``default_schedule``. ``budget`` is the number of tokens
    to place; by default the least at which every document of every source with weight is placed at least once. Within a
    source, documents follow the hash of doc_id. An occurrence is placed if its first token is within the source's demand.
    With ``report``, columns are added: epoch (from 0), n_tokens and position in [0, 1); input columns of these names are
    replaced.

    The null source is a source like any other. Null and empty texts have no tokens and share the position of the document
    after them. Sources without weight, or without any tokens, are left out. Null doc_ids hash alike; ties in the hash, and
    repeated rows, are ordered by doc_id and text and all placed; they stay in the partition of the first of them. An empty table gives an empty result.
    """
    names = ["epoch", "n_tokens", "position"]
    columns = [c for c in docs.columns if not report or c.lower() not in names]
    spark = docs.sparkSession
    groups = saved(_sums(docs, seed))
    # one row per source goes to the driver
    totals = groups.groupBy("h_source").agg(F.sum("h_sum").alias("n"), F.sum("h_rows").alias("rows")).collect()
    supply = {r.h_source: r.n for r in totals if r.n > 0}
    plan = segments(schedule if schedule is not None else default_schedule(supply))
    plan = {s: p for s, p in plan.items() if s in supply and _integral(p) > 0}
    if budget is None:
        budget = -int(-max((supply[s] / _integral(p) for s, p in plan.items()), default=0) // 1)
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-budget // PARTITION_TOKENS), 1)
    rows = [(s, int(supply[s]), int(-(-budget * _integral(p) // supply[s])), float(budget), [dict(zip(("t0", "t1", "a", "b", "done"), x)) for x in p]) for s, p in plan.items()]
    # one row per source
    plans = F.broadcast(spark.createDataFrame(rows, "h_p string, h_supply long, h_epochs long, h_budget double, h_parts array<struct<t0:double,t1:double,a:double,b:double,done:double>>"))

    def positioned(df: DataFrame, tokens_before: str) -> DataFrame:
        """Adds h_position to rows with source and epoch; null for those beyond the demand of their source."""
        df = df.withColumn("h_x", (F.col("h_epoch") * F.col("h_supply") + F.col(tokens_before)) / F.col("h_budget"))
        # the stretch in which the demand reaches x, then the root of done + a u + (b - a) u^2 / (2 (t1 - t0)) = x
        reached = F.filter("h_parts", lambda p: (p.done <= F.col("h_x")) & (p.done + (p.a + p.b) / 2 * (p.t1 - p.t0) > F.col("h_x")))
        df = df.withColumn("h_part", F.try_element_at(reached, F.lit(-1)))
        p, rest = F.col("h_part"), F.col("h_x") - F.col("h_part.done")
        slope = (p.b - p.a) / (p.t1 - p.t0)
        root = 2 * rest / (p.a + F.sqrt(F.greatest(p.a * p.a + 2 * slope * rest, F.lit(0.0))))
        return df.withColumn("h_position", F.when(rest <= 0, p.t0).otherwise(p.t0 + root))

    digits = 1
    while sum(r.rows for r in totals) / 16**digits > bucket_rows and digits < 12:
        digits += 1
    bucket = F.substring("h_hash", 1, digits)
    before = Window.partitionBy("h_source").orderBy("h_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.groupBy("h_source", bucket.alias("h_bucket")).agg(F.sum("h_sum").alias("h_sum")).withColumn("h_start", F.coalesce(F.sum("h_sum").over(before), F.lit(0)))
    inside = Window.partitionBy("h_source", "h_bucket").orderBy("h_hash").rowsBetween(Window.unboundedPreceding, -1)
    running = groups.withColumn("h_bucket", bucket).withColumn("h_in", F.coalesce(F.sum("h_sum").over(inside), F.lit(0))).drop("h_sum")
    running = running.join(starts.select(F.col("h_source").alias("h_s"), F.col("h_bucket").alias("h_b"), "h_start"), F.col("h_source").eqNullSafe(F.col("h_s")) & (F.col("h_bucket") == F.col("h_b")))
    running = running.join(plans, F.col("h_source").eqNullSafe(F.col("h_p"))).withColumn("h_before", F.col("h_start") + F.col("h_in"))
    running = running.withColumn("h_epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.col("h_epochs") - 1, F.lit(0)).cast("int"))))
    running = positioned(running, "h_before").withColumn("h_to", F.when(F.col("h_position").isNotNull(), F.least(F.floor(F.col("h_position") * partitions), F.lit(partitions - 1))).cast("int"))
    # where each source, epoch and bucket enters each partition, and (null) where demand ends: the first hash and the tokens
    # before it; without that end, the rest of a bucket would be moved to the last partition only to be left out there
    cuts = running.groupBy("h_source", "h_bucket", "h_epoch", "h_to").agg(F.min(F.struct("h_hash", "h_before")).alias("h_cut"))
    cuts = saved(cuts.groupBy(F.col("h_source").alias("h_s"), F.col("h_bucket").alias("h_b"), "h_epoch").agg(F.array_sort(F.collect_list(F.struct(F.col("h_cut.h_hash").alias("hash"), F.col("h_cut.h_before").alias("before"), F.col("h_to").alias("to")))).alias("h_cuts")).where("h_cuts[0].to IS NOT NULL"))

    own = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)], *[F.col(f"`{c}`").alias(f"h_{c}") for c in ("doc_id", "text") if c not in columns], F.col("source").cast("string").alias("h_source"), token_count().alias("h_n"), _hash(seed).alias("h_hash"))
    doc_id, text = (f"c{columns.index(c)}" if c in columns else f"h_{c}" for c in ("doc_id", "text"))
    placed = own.join(cuts, F.col("h_source").eqNullSafe(F.col("h_s")) & (bucket == F.col("h_b"))).withColumn("h_cut", F.element_at(F.filter("h_cuts", lambda c: c.hash <= F.col("h_hash")), -1)).where("h_cut.to IS NOT NULL")
    kept = [f"c{k}" for k in range(len(columns))] + [f"h_{c}" for c in ("doc_id", "text") if c not in columns]
    placed = placed.select(*kept, "h_source", "h_n", F.unhex("h_hash").alias("h_hash"), "h_epoch", bucket.alias("h_bucket"), F.col("h_cut.to").alias("h_to"), F.col("h_cut.before").alias("h_before"))
    moved = placed.repartitionById(partitions, F.col("h_to"))
    # all rows of a hash go where its first token is, so the sum is whole
    since = Window.partitionBy("h_to", "h_source", "h_epoch", "h_bucket").orderBy("h_hash", doc_id, text).rowsBetween(Window.unboundedPreceding, -1)
    moved = moved.withColumn("h_tokens", F.col("h_before") + F.coalesce(F.sum("h_n").over(since), F.lit(0))).join(plans, F.col("h_source").eqNullSafe(F.col("h_p")))
    ordered = positioned(moved, "h_tokens").where("h_position IS NOT NULL").sortWithinPartitions("h_position", "h_hash", "h_epoch")
    out = [F.col(f"c{k}").alias(c) for k, c in enumerate(columns)]
    return ordered.select(*out, *([F.col("h_epoch").alias("epoch"), F.col("h_n").alias("n_tokens"), F.col("h_position").alias("position")] if report else []))
