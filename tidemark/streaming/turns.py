"""Turns of live sessions: one that never ends is closed as unfinished once it was quiet."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Fixed value: a turn that is quiet for so many minutes is over.
IDLE_MINUTES = 30
#: The kinds of rows: a request counts, an end closes the turn, all others show that it is alive.
REQUEST, ENDS = "request", ("completed", "failed", "aborted")
TURNS = "session string, turn string, started_at timestamp, last_at timestamp, requests long, status string"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Timers and list states need this store; it holds more keys than memory does."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


def _micros(t) -> int:
    return (t if isinstance(t, pd.Timestamp) else pd.Timestamp(t)).value // 1000


#: Fixed value: turns share the state of so many buckets, so that calls and timers are a bucket's and not a turn's.
BUCKETS = 1024


class IdleTurns(StatefulProcessor):
    """One bucket of turns: their rows wait in a list until the watermark has passed the point where each closes.

    Rows come in any order within the watermark's delay, so nothing is told before: a late row
    may lengthen a turn or end it. A closed turn stays closed for ``keep`` minutes, then its
    state goes. The one timer of a bucket is at the first of these points; it takes all that are due.
    """

    def __init__(self, idle: int, keep: int) -> None:
        self.idle, self.keep = idle * 60_000_000, keep * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        turn = [StructField("session", StringType()), StructField("turn", StringType())]
        self.rows = handle.getListState("rows", StructType([*turn, StructField("at", LongType()), StructField("kind", StringType())]))
        self.closed = handle.getListState("closed", StructType([*turn, StructField("at", LongType())]))

    def _cuts(self, rows: pd.DataFrame) -> pd.DataFrame:
        """(session, turn, started, last, requests, status, at) of each turn: its rows up to its close, and when and how it closes, as far as the rows tell."""
        rows = rows.sort_values(["session", "turn", "at", "kind"], kind="stable", ignore_index=True)
        turn = rows.groupby(["session", "turn"], sort=False)
        # A row closes its turn if it ends it, or if the next one comes too late or never.
        ends = rows["kind"].isin(ENDS)
        rows["closes"] = ends | ~(turn["at"].shift(-1) - rows["at"] < self.idle)
        taken = rows[turn["closes"].cumsum() - rows["closes"] == 0]
        per_turn = taken.assign(request=taken["kind"] == REQUEST).groupby(["session", "turn"], sort=False).agg(started=("at", "first"), last=("at", "last"), requests=("request", "sum"), status=("kind", "last")).reset_index()
        ended = per_turn["status"].isin(ENDS)
        per_turn["status"] = per_turn["status"].where(ended, "unfinished")
        per_turn["at"] = per_turn["last"].where(ended, per_turn["last"] + self.idle)
        return per_turn

    def _state(self, state, columns: list[str]) -> pd.DataFrame:
        return pd.DataFrame([tuple(r) for r in state.get()], columns=columns)

    def _wait(self, points: list[int]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(int(timer[0] if isinstance(timer, tuple) else timer))
        if points:
            self.handle.registerTimer(-(-min(points) // 1000))

    def _points(self, cuts: pd.DataFrame, closed: pd.DataFrame) -> list[int]:
        return [int(x) for x in [*cuts["at"], *(closed["at"] + self.keep)]]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        new = pd.concat([f[["session", "turn", "at", "kind"]] for f in rows], ignore_index=True)
        new = new[new["at"].notna()].assign(at=lambda f: [_micros(x) for x in f["at"]])
        closed = self._state(self.closed, ["session", "turn", "at"])
        gone = set(zip(closed["session"], closed["turn"], strict=True))
        new = new[[t not in gone for t in zip(new["session"], new["turn"], strict=True)]]
        if len(new):
            self.rows.appendList([(s, t, int(at), None if pd.isna(kind) else kind) for s, t, at, kind in new.itertuples(index=False, name=None)])
            self._wait(self._points(self._cuts(self._state(self.rows, ["session", "turn", "at", "kind"])), closed))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        # A timer fires once the watermark is beyond it.
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1) * 1000
        rows, closed = self._state(self.rows, ["session", "turn", "at", "kind"]), self._state(self.closed, ["session", "turn", "at"])
        cuts = self._cuts(rows)
        due = cuts["at"] <= now
        out, open_turns = cuts[due], set(zip(cuts["session"][~due], cuts["turn"][~due], strict=True))
        # What was closed before, but for that whose time is over, and what closes now.
        closed = pd.concat([closed[closed["at"] + self.keep > now], out[["session", "turn", "at"]]], ignore_index=True)
        if len(out):
            left = [r for r in rows.itertuples(index=False, name=None) if r[:2] in open_turns]
            self.rows.put(left) if left else self.rows.clear()
        kept = [(s, t, int(at)) for s, t, at in closed.itertuples(index=False, name=None)]
        self.closed.put(kept) if kept else self.closed.clear()
        self._wait(self._points(cuts[~due], closed))
        out = out[(out["requests"] > 0) | (out["status"] != "unfinished")]
        stamps = {f"{n}_at": pd.to_datetime(out[n].astype("int64"), unit="us") for n in ("started", "last")}
        yield pd.DataFrame({"session": out["session"], "turn": out["turn"], "started_at": stamps["started_at"], "last_at": stamps["last_at"], "requests": out["requests"].astype("int64"), "status": out["status"]})

    def close(self) -> None:
        pass


def closed_turns(rows: DataFrame, idle_minutes: int = IDLE_MINUTES, delay: str = "10 minutes", keep_minutes: int = 7 * 24 * 60) -> DataFrame:
    """(session, turn, started_at, last_at, requests, status) of a stream of (session, turn, at, kind).

    A turn closes with its first end, or as unfinished ``idle_minutes`` after its last row, by
    the time in the rows: once the watermark, ``delay`` behind the newest row, has passed that
    point. Rows later than the delay are dropped; one that comes to a closed turn changes
    nothing. An unfinished turn without a request is none. Rows without a time, session or
    turn are dropped. Call ``use_rocksdb`` before the stream starts.
    """
    shaped = rows.select(F.col("session").cast("string").alias("session"), F.col("turn").cast("string").alias("turn"), F.col("at").cast("timestamp").alias("at"), F.col("kind").cast("string").alias("kind")).where("session IS NOT NULL AND turn IS NOT NULL AND at IS NOT NULL")
    bucket = F.pmod(F.xxhash64("session", "turn"), F.lit(BUCKETS)).cast("int").alias("bucket")
    grouped = shaped.withWatermark("at", delay).select("*", bucket).groupBy("bucket")
    return grouped.transformWithStateInPandas(IdleTurns(idle_minutes, keep_minutes), TURNS, "Append", "EventTime")


def closed_turns_batch(rows: DataFrame, idle_minutes: int = IDLE_MINUTES) -> DataFrame:
    """The same of a table: what the stream tells once all its rows are behind the watermark."""
    idle = F.expr(f"INTERVAL {idle_minutes} MINUTES")
    known = rows.where("session IS NOT NULL AND turn IS NOT NULL AND at IS NOT NULL")
    order = Window.partitionBy("session", "turn").orderBy("at", "kind")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ends = F.col("kind").isin(*ENDS)
    over = F.coalesce(F.max(ends.cast("int")).over(before), F.lit(0)) + F.max((F.col("at") >= F.col("__before") + idle).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    taken = known.withColumn("__before", F.coalesce(F.lag("at").over(order), F.col("at"))).withColumn("__over", over).where("__over = 0")
    per_turn = taken.groupBy("session", "turn").agg(F.min("at").alias("started_at"), F.max("at").alias("last_at"), F.count_if(F.col("kind") == REQUEST).alias("requests"), F.coalesce(F.max(F.when(ends, F.col("kind"))), F.lit("unfinished")).alias("status"))
    return per_turn.where("requests > 0 OR status <> 'unfinished'")
