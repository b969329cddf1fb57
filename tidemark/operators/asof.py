"""As-of, nearest and interval joins without row-by-row searches or range-join blow-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, columns: list[str],
    order: list[str] | None = None, direction: str = "backward", bucket: str = "day", suffix: str = "",
) -> DataFrame:
    """Left rows with the last right row at or before them (``backward``) or the first at or after.

    Of right rows at one instant, the last by ``order`` counts. The rows of a key are dealt by
    time bucket: inside a bucket a window carries the right rows on, and what a bucket starts
    with comes from one row per key and bucket. So a hot key is as many tasks as it has
    buckets. Left rows without a match get nulls; null keys match nothing.
    """
    back = direction == "backward"
    sign = F.lit(1 if back else -1)
    tag = [c + suffix for c in columns]
    match = F.struct(F.col(right_ts).alias("__at"), *[F.col(c) for c in columns])
    seq = F.struct(*[F.col(c) for c in order]) if order else F.lit(0)
    r = right.where(F.col(right_ts).isNotNull()).select(*by, F.col(right_ts).alias("__ts"), F.lit(0).alias("__side"), seq.alias("__seq"), match.alias("__match"))
    kept = F.struct(*[F.col(c) for c in left.columns]).alias("__left")
    key = [F.col(c) for c in by]
    ll = left.select(*key, F.col(left_ts).alias("__ts"), F.lit(1).alias("__side"), F.lit(None).cast(r.schema["__seq"].dataType).alias("__seq"), kept)
    both = r.unionByName(ll, allowMissingColumns=True).withColumn("__bucket", F.date_trunc(bucket, F.col("__ts")))
    micros = F.unix_micros(F.col("__ts").cast("timestamp")) * sign
    side = F.col("__side")
    inside = Window.partitionBy(*by, "__bucket").orderBy(micros.asc_nulls_first(), side, F.col("__seq")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__hit", F.last("__match", ignorenulls=True).over(inside))
    # One row per key and bucket of either side: what the right rows of the bucket end with, if it has any.
    ends = both.groupBy(*by, "__bucket").agg(F.max_by("__match", F.when(side == 0, F.struct(micros, F.col("__seq")))).alias("__end"))
    bucket_order = F.unix_micros(F.col("__bucket").cast("timestamp")) * sign
    before = Window.partitionBy(*by).orderBy(bucket_order.asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    buckets = ends.withColumn("__carry", F.last("__end", ignorenulls=True).over(before)).drop("__end")
    rows = found.where("__side = 1").join(buckets, [*by, "__bucket"], "left").withColumn("__best", F.when(F.col("__ts").isNotNull(), F.coalesce("__hit", "__carry")))
    return rows.select("__left.*", F.col("__best.__at").alias(f"matched_at{suffix}"), *[F.col(f"__best.{c}").alias(t) for c, t in zip(columns, tag, strict=True)])


def nearest_join(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, columns: list[str], within_seconds: int, order: list[str] | None = None) -> DataFrame:
    """The right row nearest in time within the reach; of two as near, the earlier one."""
    back = asof_join(left, right, by, left_ts, right_ts, columns, order, "backward", suffix="__b")
    both = asof_join(back, right, by, left_ts, right_ts, columns, order, "forward", suffix="__f")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    reach = within_seconds * 1_000_000
    gap_b, gap_f = micros(left_ts) - micros("matched_at__b"), micros("matched_at__f") - micros(left_ts)
    ok_b, ok_f = F.coalesce(gap_b <= reach, F.lit(False)), F.coalesce(gap_f <= reach, F.lit(False))
    use_b = ok_b & (~ok_f | (gap_b <= gap_f))
    pick = lambda c: F.when(use_b, F.col(f"{c}__b")).when(ok_f, F.col(f"{c}__f")).alias(c)
    agree = F.when(ok_b & ok_f, F.struct(*[f"{c}__b" for c in columns]) == F.struct(*[f"{c}__f" for c in columns]))
    return both.select(*left.columns, pick("matched_at"), *[pick(c) for c in columns], agree.alias("both_agree"))


#: Levels of stretches of an interval join, from hours to more than ten thousand years, and how much wider each is.
LEVELS, GROWTH = 6, 32


def interval_pairs(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, start: str, end: str, reach_seconds: int = 0) -> DataFrame:
    """All (left row, right interval) pairs of a key with the instant within reach of the interval.

    Both sides are dealt by (key, stretch of time) as well as by key; an interval is sent to
    every stretch it reaches, an instant to its own. Longer intervals are dealt in wider
    stretches, ``GROWTH`` times as wide a level, so that none is sent to more than some
    ``GROWTH`` of them; an instant is sent once to each level that has intervals.
    """
    width = max(3600, 4 * reach_seconds)
    seconds = lambda c: F.unix_seconds(c.cast("timestamp"))
    reach = F.expr(f"INTERVAL {reach_seconds} SECONDS")
    first, last = seconds(F.col(start) - reach), seconds(F.col(end) + reach)
    level = F.when(first <= last, F.lit(LEVELS - 1))
    for n in reversed(range(LEVELS - 1)):
        level = F.when((first <= last) & (last - first <= width * GROWTH ** (n + 1)), F.lit(n)).otherwise(level)
    levels = sorted(r[0] for r in right.select(level.alias("n")).where("n is not null").distinct().collect())
    wide = F.lit(width) * F.pow(F.lit(GROWTH), F.col("__level"))
    stretch = lambda s: F.floor(s / wide)
    r = right.withColumn("__level", level).where("__level is not null").withColumn("__stretch", F.explode(F.sequence(stretch(first), stretch(last))))
    ll = left.withColumn("__level", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>"))).withColumn("__stretch", stretch(seconds(F.col(left_ts))))
    return ll.join(r, [*by, "__level", "__stretch"]).where((F.col(left_ts) >= F.col(start) - reach) & (F.col(left_ts) <= F.col(end) + reach)).drop("__level", "__stretch")


def versions(df: DataFrame, by: list[str], effective: str) -> DataFrame:
    """Rows with [effective, valid_to); a version without a date holds from the start."""
    at = F.coalesce(F.col(effective).cast("timestamp"), F.timestamp_micros(F.lit(-62135596800000000)))
    return df.withColumn("valid_from", at).withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy(*by).orderBy("valid_from")))


def version_at(left: DataFrame, prices: DataFrame, by: list[str], ts: str, effective: str, columns: list[str]) -> DataFrame:
    """The version in force at ``ts``: the oldest before all of them, the newest where the instant is unknown."""
    ordered = F.struct(F.coalesce(F.col(effective).cast("timestamp"), F.timestamp_micros(F.lit(-62135596800000000))))
    value = F.struct(*[F.col(c) for c in columns])
    ends = prices.groupBy(*by).agg(F.min_by(value, ordered).alias("__oldest"), F.max_by(value, ordered).alias("__newest"))
    hit = asof_join(left, prices, by, ts, effective, columns, bucket="month", suffix="__v")
    chosen = F.when(F.col(ts).isNull(), F.col("__newest")).when(F.col("matched_at__v").isNull(), F.col("__oldest")).otherwise(F.struct(*[F.col(f"{c}__v").alias(c) for c in columns]))
    return hit.join(ends, by, "left").withColumn("__chosen", chosen).select(*left.columns, *[F.col(f"__chosen.{c}").alias(c) for c in columns])


def longest_prefix(paths: DataFrame, roots: DataFrame, path: str, root: str) -> DataFrame:
    """Each path row with the longest root that contains it: an equi-join on its ancestors, no theta join."""
    parts = F.split(F.regexp_replace(F.col(path), "/+$", ""), "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    rows = paths.select(path).distinct().withColumn("__root", F.explode(ancestors))
    known = roots.select(F.regexp_replace(root, "/+$", "").alias("__root"), F.col(root).alias("matched_root")).distinct()
    best = rows.join(known, "__root").groupBy(path).agg(F.max_by("matched_root", F.length("__root")).alias("matched_root"))
    return paths.join(best, path, "left")


def nearest_by_gap(candidates: DataFrame, keys: list[str], gap: Column, tie: list[Column]) -> DataFrame:
    """Of candidate pairs, one per key: the least gap, ties by ``tie``."""
    return candidates.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(gap, *tie))).where("__rank = 1").drop("__rank")
