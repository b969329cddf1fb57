"""One-to-one pairing of account rows with turns, nearest first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import interval_pairs
from tidemark.session import drop_path, materialize


def candidates(rows: DataFrame, turns: DataFrame, by: list[str], row_ts: str, start: str, end: str, reach_seconds: int = 60) -> DataFrame:
    """(row, turn) pairs of one session within reach, with their gap in microseconds (0 inside the turn)."""
    pairs = interval_pairs(rows, turns, by, row_ts, start, end, reach_seconds)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    gap = F.greatest(micros(start) - micros(row_ts), micros(row_ts) - micros(end), F.lit(0))
    return pairs.withColumn("gap", gap)


def greedy(pairs: DataFrame, by: list[str], row_id: str, turn_id: str) -> DataFrame:
    """Pairs taken nearest first, each row and each turn at most once. A pair never leaves its session.

    In the order of (gap, row, turn), a pair that comes first both among its row's and among its
    turn's is taken whatever others do. Such pairs are taken and their rivals dropped, round by
    round until none is left, so no task holds a session. Equal pairs are one; a pair with a null
    key, row, turn or gap is none.
    """
    spark = pairs.sparkSession
    row, turn = [*by, row_id], [*by, turn_id]
    left = pairs.select(*by, row_id, turn_id, "gap").dropna().groupBy(*by, row_id, turn_id).agg(F.min("gap").alias("gap"))
    rest, path = materialize(left, "pairs")
    taken = []
    while not rest.isEmpty():
        of_row = rest.groupBy(*row).agg(F.min(F.struct("gap", turn_id)).alias("__best")).select(*row, "__best.*")
        of_turn = rest.groupBy(*turn).agg(F.min(F.struct("gap", row_id)).alias("__best")).select(*turn, "__best.*")
        first, _ = materialize(of_row.join(of_turn, [*by, row_id, turn_id, "gap"]), "paired")
        taken.append(first)
        rivals = rest.join(first.select(*row), row, "left_anti").join(first.select(*turn), turn, "left_anti")
        rest, next_path = materialize(rivals, "pairs")
        drop_path(spark, path)
        path = next_path
    found = rest
    for first in taken:
        found = found.unionByName(first)
    return found.select(*by, row_id, turn_id, "gap")


def ambiguous(pairs: DataFrame, row_id: str, turn_id: str) -> DataFrame:
    """(row_id, ambiguous): whether a row's two nearest turns are as near as each other."""
    w = Window.partitionBy(row_id).orderBy("gap", turn_id)
    ranked = pairs.withColumn("__rank", F.row_number().over(w)).withColumn("__next", F.lead("gap").over(w))
    return ranked.where("__rank = 1").select(row_id, F.coalesce(F.col("gap") == F.col("__next"), F.lit(False)).alias("ambiguous"))
