"""Where events go: idempotent appends, replaced windows, frozen snapshots, fact tables, logs."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidemark.operators.facts import one_per_key
from tidemark.session import recover_path, swap_path


def _read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    recover_path(spark, path)
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException:  # the table is not there yet
        return spark.createDataFrame([], like.schema)


def append_events(events: DataFrame, path: str, key: str = "event_id") -> tuple[int, int]:
    """Appends what the table lacks; returns (inserted, duplicates). The first of repeated rows counts."""
    incoming = events.count()
    fresh = one_per_key(events, [key], [F.xxhash64(*events.columns)]).join(_read(events.sparkSession, path, events).select(key), key, "left_anti").select(*events.columns).persist()
    inserted = fresh.count()
    fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return inserted, incoming - inserted


def replace_window(events: DataFrame, path: str, adapter: str, since: datetime, adapter_column: str = "adapter_id", ts: str = "occurred_at") -> None:
    """One adapter's rows from ``since`` on give way to ``events``; all others stay.

    The new table is written beside the old one and then takes its name, so a job that is cut off leaves one of them whole.
    """
    spark = events.sparkSession
    old = _read(spark, path, events)
    kept = old.where(~F.coalesce((F.col(adapter_column) == adapter) & (F.col(ts) >= F.lit(since)), F.lit(False)))
    staged = f"{path}.{uuid.uuid4().hex}"
    kept.unionByName(events).write.parquet(staged)
    swap_path(spark, staged, path)


def freeze_snapshot(selected: DataFrame, root: str, key: str = "event_id") -> str:
    """Writes the event ids under an id that follows from them; freezing the same selection again changes nothing."""
    spark = selected.sparkSession
    # A sum of hashes and the count stand for the set, so no list of ids passes through one task.
    state = selected.select(key).distinct().agg(F.count("*"), F.sum(F.xxhash64(key).cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit("x"), key))).first()
    snapshot = spark.range(1).select(F.substring(F.sha2(F.lit("|".join(map(str, state))), 256), 1, 24)).first()[0]
    path = f"{root}/snapshot_id={snapshot}"
    selected.select(key).distinct().write.mode("ignore").parquet(path)
    return snapshot


def write_facts(facts: DataFrame, path: str, bucket: str, buckets: int = 64) -> None:
    """Overwrites only the buckets that ``facts`` touches."""
    rows = facts.withColumn("bucket", F.pmod(F.xxhash64(bucket), F.lit(buckets)).cast("int"))
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def append_log(row: DataFrame, path: str) -> None:
    row.write.mode("append").json(path)


def over_limit(ledgers: DataFrame, limit: float) -> list[str]:
    """The ledgers above a limit, each on its own; an unknown one is never above."""
    sums = ledgers.agg(*[F.sum(c).alias(c) for c in ledgers.columns]).first()
    return [c for c in ledgers.columns if sums[c] is not None and sums[c] > limit]
