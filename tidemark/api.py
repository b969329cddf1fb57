"""The engine's surface: what a user calls, over one event table and one fact table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import cube, metrics, paging


class Engine:
    """Queries over facts: usage, history, chats, analyze, explain, evidence. Results are named DataFrames.

    Metrics are plug-ins: functions of the facts to rows; one that fails leaves a note and the
    others run.
    """

    def __init__(self, spark: SparkSession, facts: DataFrame, session: str = "user_id", ts: str = "ts") -> None:
        self.spark, self.facts, self.session, self.ts = spark, facts, session, ts
        self.metrics: dict[str, Callable[[DataFrame], DataFrame]] = {}
        facts.createOrReplaceTempView("facts")

    def usage(self, q: cube.UsageQuery) -> dict[str, DataFrame]:
        out = {"total": cube.totals(self.facts, q)}
        if q.group:
            out["unattributed"] = cube.unattributed(self.facts, q)
            out["groups"] = cube.top_groups(self.facts, q) if q.limit else cube.groups(self.facts, q)
        if q.bucket:
            out["series"] = cube.series(self.facts, q)
        return out

    def history(self, by: list[str], measures: list[str]) -> DataFrame:
        return metrics.history(self.facts, by, self.ts, measures, self.session).orderBy(F.desc_nulls_last("last_at"), *by)

    def chats(self, turns: DataFrame) -> DataFrame:
        return metrics.chat_nodes(turns, "conv_id", "turn", "role", "text")

    def analyze(self) -> tuple[DataFrame | None, list[str]]:
        """(rows, notes): all registered metrics in one table."""
        frames, notes = [], []
        for name, metric in self.metrics.items():
            try:
                frames.append(metric(self.facts))
            except Exception as e:  # noqa: BLE001  a plug-in's failure is its own
                notes.append(f"{name}: {type(e).__name__}")
        out = None
        for f in frames:
            out = f if out is None else out.unionByName(f)
        return out, notes

    def explain(self, lane: str, event_id: str, offset: int = 0, limit: int = 50) -> DataFrame:
        order = paging.timeline_order(F.col(self.ts), F.lit(0), F.col(lane), F.col(event_id))
        return paging.page(self.facts, order, offset, limit)

    def evidence(self, ids: DataFrame, key: str) -> DataFrame:
        found = ids.join(self.facts, key, "left")
        return found.withColumn("reason", F.when(F.col(self.ts).isNull(), "not-found"))
