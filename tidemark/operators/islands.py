"""Intervals, bursts and episodes, by gaps-and-islands over windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def classify(start: Column, end: Column) -> Column:
    """valid, censored (an end is missing) or clock-error (it ends before it starts)."""
    return F.when(start.isNull() | end.isNull(), "censored").when(end < start, "clock-error").otherwise("valid")


def overlap_ms(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def close_open(end: Column, as_of: Column) -> Column:
    return F.coalesce(end, as_of)


def _stretch(df: DataFrame, ts: str, seconds: int) -> Column:
    """Number of the stretch of time that ``ts``, an instant or a count of ms, falls into."""
    ms = F.unix_millis(F.col(ts).cast("timestamp")) if df.schema[ts].dataType.typeName().startswith("timestamp") else F.col(ts)
    return F.floor(ms / (seconds * 1000))


def union_intervals(df: DataFrame, by: list[str], start: str, end: str, stretch_seconds: int = 86400) -> DataFrame:
    """(by..., start, end) of the union; touching intervals merge, others than valid ones are left out.

    Intervals that start in one stretch of time merge first, then what is left of a key, so the
    rows of a hot key are many tasks.
    """
    valid = df.where(classify(F.col(start), F.col(end)) == "valid").withColumn("__stretch", _stretch(df, start, stretch_seconds))
    return _merged(_merged(valid, [*by, "__stretch"], start, end), by, start, end)


def _merged(valid: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(start, end)
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    opened = valid.withColumn("__new", F.when(F.col(start) <= F.max(end).over(upto), 0).otherwise(1))
    island = opened.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*by, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def interval_totals(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Union length per key with the count left out; null, not 0, where nothing is valid; a lower bound where something is."""
    merged = union_intervals(df, by, start, end).groupBy(*by).agg(F.sum(F.col(end) - F.col(start)).alias("total_ms"))
    left_out = df.groupBy(*by).agg(F.count_if(classify(F.col(start), F.col(end)) != "valid").alias("excluded"))
    return left_out.join(merged, by, "left").withColumn("lower_bound", F.col("excluded") > 0)


def bursts(df: DataFrame, by: list[str], ts: str, gap_seconds: int, order: list[str] | None = None) -> DataFrame:
    """``df`` with a ``burst`` number per key; points up to the gap apart stay together."""
    w = Window.partitionBy(*by).orderBy(ts, *(order or []))
    micros = F.unix_micros(F.col(ts))
    new = F.when(micros - F.lag(micros).over(w) <= gap_seconds * 1_000_000, 0).otherwise(1)
    return df.withColumn("__new", new).withColumn("burst", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def burst_intervals(df: DataFrame, by: list[str], ts: str, gap_seconds: int = 1800, stretch_seconds: int = 86400) -> DataFrame:
    """(by..., burst, start, end, points): bursts of a stretch of time first, then those that a stretch's end had parted."""
    parts = bursts(df.withColumn("__stretch", _stretch(df, ts, stretch_seconds)), [*by, "__stretch"], ts, gap_seconds)
    parts = parts.groupBy(*by, "__stretch", "burst").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("points")).drop("burst")
    w = Window.partitionBy(*by).orderBy("start")
    gap = F.unix_micros("start") - F.lag(F.unix_micros("end")).over(w)
    new = parts.withColumn("__new", F.when(gap <= gap_seconds * 1_000_000, 0).otherwise(1))
    whole = new.withColumn("burst", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return whole.groupBy(*by, "burst").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("points").alias("points"))


def episodes(df: DataFrame, by: list[str], ts: str, as_of: Column, gap_hours: int = 8, current_hours: int = 24) -> DataFrame:
    """Episodes split at gaps of more than ``gap_hours``; current if the end is within a day of ``as_of``."""
    out = burst_intervals(df, by, ts, gap_hours * 3600)
    age = F.unix_micros(as_of) - F.unix_micros("end")
    return out.withColumn("current", age <= current_hours * 3600 * 1_000_000)


def explicit_interval(started: Column, completed: Column, duration_ms: Column) -> Column:
    """struct(start, end) in ms from any two of the three; null where fewer are known."""
    start = F.coalesce(started, completed - duration_ms)
    end = F.coalesce(completed, started + duration_ms)
    return F.when(start.isNotNull() & end.isNotNull(), F.struct(start.alias("start"), end.alias("end")))


def segments(df: DataFrame, by: list[str], ts: str, order: list[str] | None = None) -> DataFrame:
    """``df`` with ``valid_to``: the next row's instant of the key, null for the last."""
    return df.withColumn("valid_to", F.lead(ts).over(Window.partitionBy(*by).orderBy(ts, *(order or []))))
