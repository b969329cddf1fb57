"""Friction: what failed or was redone often enough to be a finding, ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.metrics import THRESHOLDS

#: How severities rank.
SEVERITY_RANK = {"high": 3, "medium": 2, "low": 1, "info": 0}


def _draft(groups: DataFrame, kind: str, key: Column | None, severity: Column, weight: str) -> DataFrame:
    name = F.lit(f"friction.{kind}") if key is None else F.concat(F.lit(f"friction.{kind}:"), key.cast("string"))
    return groups.select(name.alias("finding_id"), severity.alias("severity"), F.col(weight).cast("long").alias("weight"))


def _repeated(rows: DataFrame, key: str, least: int) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def run_findings(runs: DataFrame, outcome: str, failing: str) -> DataFrame:
    """Tests that failed in several runs (each counts once a run), and the failed share of runs of known outcome."""
    names = runs.select(F.explode(F.array_distinct(failing)).alias("test"))
    repeated = _draft(_repeated(names, "test", THRESHOLDS["testRepeatedFailures"]), "test-repeated-failure", F.col("test"), F.lit("high"), "n")
    known, failed = F.count_if(F.col(outcome).isin("passed", "failed")), F.count_if(F.col(outcome) == "failed")
    total = runs.agg(known.alias("known"), failed.alias("failed"))
    over = total.where((F.col("known") >= THRESHOLDS["testFailureRateMinRuns"]) & (F.try_divide("failed", "known") >= THRESHOLDS["testFailureRate"]))
    return repeated.unionByName(_draft(over, "test-failure-rate", None, F.lit("medium"), "failed"))


def tool_findings(calls: DataFrame, failed: str) -> DataFrame:
    """The failed share of all tool calls, once enough failed."""
    total = calls.agg(F.count("*").alias("calls"), F.count_if(F.col(failed)).alias("failed"))
    over = total.where((F.col("failed") >= THRESHOLDS["toolFailureRateMinFailures"]) & (F.try_divide("failed", "calls") >= THRESHOLDS["toolFailureRate"]))
    return _draft(over, "tool-failure-rate", None, F.lit("medium"), "failed")


def command_findings(failures: DataFrame, command: str) -> DataFrame:
    """Commands that failed repeatedly."""
    return _draft(_repeated(failures, command, THRESHOLDS["commandRepeatedFailures"]), "command-repeated-failure", F.col(command), F.lit("medium"), "n")


def rework_findings(edits: DataFrame, path: str) -> DataFrame:
    """Files edited again and again; from the higher threshold on it is more than low."""
    severity = F.when(F.col("n") >= THRESHOLDS["fileReworkEditsHigh"], "medium").otherwise("low")
    return _draft(_repeated(edits, path, THRESHOLDS["fileReworkEdits"]), "file-rework", F.col(path), severity, "n")


def ranked(findings: list[DataFrame], limit: int = THRESHOLDS["maxFindings"]) -> DataFrame:
    """(rank, finding_id, severity, weight) of the first few: by severity, then weight, then id."""
    every = findings[0]
    for more in findings[1:]:
        every = every.unionByName(more)
    level = F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv]), F.col("severity"))
    order = [F.desc(level), F.desc("weight"), F.col("finding_id")]
    return every.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
