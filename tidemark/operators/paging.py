"""Timelines and bounded pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def timeline_order(ts: Column, precision_rank: Column, lane: Column, event_id: Column) -> list[Column]:
    """Time first, unknown times last, then precision, lane and id."""
    return [ts.asc_nulls_last(), precision_rank, lane, event_id]


def uncertain(df: DataFrame, ts: str, lane: str, unit: str = "second") -> DataFrame:
    """Rows whose time bucket several lanes share: their order is not known."""
    bucket = F.date_trunc(unit, F.col(ts))
    mixed = df.groupBy(bucket.alias("__bucket")).agg((F.min(lane) != F.max(lane)).alias("uncertain"))
    return df.withColumn("__bucket", bucket).join(mixed, "__bucket", "left").drop("__bucket")


def page(df: DataFrame, order: list[Column], offset: int, limit: int = 50) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the total order, numbered; a limit is 1 to 500."""
    if not 1 <= limit <= 500:
        raise ValueError("a page has 1 to 500 rows")
    head = df.orderBy(*order).limit(offset + limit)
    return head.withColumn("position", F.row_number().over(Window.orderBy(*order))).where((F.col("position") > offset) & (F.col("position") <= offset + limit))


def byte_page(df: DataFrame, order: list[Column], max_bytes: int, max_rows: int = 500) -> DataFrame:
    """The first rows whose JSON fits the byte budget together."""
    head = df.orderBy(*order).limit(max_rows)
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return head.withColumn("bytes_upto", F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))).over(w)).where(F.col("bytes_upto") <= max_bytes)
