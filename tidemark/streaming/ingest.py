"""Streams: new files as events, late duplicates dropped, requests settled, facts refreshed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.sources.sinks import append_events

HOOK = "recordHash string, capturedAt timestamp, tool string, hookEvent string, sessionId string, generationId string, branch string, worktree string, durationMs long"


def hook_stream(spark: SparkSession, path: str) -> DataFrame:
    """Hook observations as the spool's files appear; lines of another shape come with null fields."""
    return spark.readStream.schema(HOOK).json(path)


def without_late_duplicates(events: DataFrame, key: str = "event_id", ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Each id once within the delay; state older than that is let go."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def bucket_counts(events: DataFrame, ts: str, key: str, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    return events.withWatermark(ts, delay).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))


def settle(rows: DataFrame, request: str = "request", seconds: int = 60) -> DataFrame:
    """(request, output, final): a request's largest output, once a final row came or it was quiet long enough.

    The rows need ``request``, ``output`` and ``final``; quiet is processing time.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, done = state.get if state.exists else (None, False)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"request": [key[0]], "output": [best], "final": [False]})
            return
        for frame in frames:
            top = frame["output"].max()
            best = top if best is None or (pd.notna(top) and top > best) else best
            done = done or bool(frame["final"].any())
        if done:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"request": [key[0]], "output": [best], "final": [True]})
        else:
            state.update((best, done))
            state.setTimeoutDuration(seconds * 1000)

    shaped = rows.select(F.col(request).cast("string").alias("request"), F.col("output").cast("double").alias("output"), F.col("final").cast("boolean").alias("final"))
    return shaped.groupBy("request").applyInPandasWithState(step, "request string, output double, final boolean", "best double, done boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def refresh_facts(stream: DataFrame, events_path: str, derive: Callable[[DataFrame], DataFrame], facts_path: str, family: str, checkpoint: str, buckets: int = 64):
    """Each micro-batch appends its new events, then derives anew only the families they touch.

    A batch that runs twice appends nothing the second time and writes the same facts. With many
    families take more ``buckets``, and the same number for all runs: a batch derives all families of the buckets it touches.
    """
    from tidemark.sources.sinks import write_facts

    def batch(df: DataFrame, _: int) -> None:
        held = df.persist()
        append_events(held, events_path)
        touched = held.select(family).distinct()
        # Buckets are overwritten whole, so all families of a touched bucket are derived.
        everything = df.sparkSession.read.parquet(events_path)
        bucket = lambda d: d.withColumn("__b", F.pmod(F.xxhash64(family), F.lit(buckets)))
        again = bucket(everything).join(bucket(touched).select("__b").distinct(), "__b", "left_semi").drop("__b")
        write_facts(derive(again), facts_path, family, buckets)
        held.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
