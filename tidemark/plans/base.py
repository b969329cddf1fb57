"""How plan modules register queries, and the tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def registry() -> tuple[dict, dict, Callable]:
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return queries, oracles, query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event facts: instants in UTC, the payload's one field typed, some values and types unknown."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
        F.from_json("props", "k INT")["k"].alias("k"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("amount"),
        F.when(F.col("event_type") != "signup", F.col("event_type")).alias("tool"),
    )


#: The same facts for DuckDB.
EVENTS_SQL = """e AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(json_extract(props, '$.k') AS INT) AS k,
         CASE WHEN event_id % 7 <> 0 THEN value END AS amount,
         CASE WHEN event_type <> 'signup' THEN event_type END AS tool
  FROM events)"""


def money(x: Column) -> Column:
    """Double sums to six digits, half up, so that the order of addition does not show."""
    return F.floor(x * 1e6 + 0.5) / F.lit(1e6)


def cents(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / F.lit(100.0)


def money_sql(x: str) -> str:
    return f"floor({x} * 1e6 + 0.5) / 1e6"


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))
