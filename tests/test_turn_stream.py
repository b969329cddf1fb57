"""Turns closed by event time in a stream, equal to what the whole table gives."""

import random
from datetime import UTC, datetime, timedelta

from tidemark.session import new_path
from tidemark.streaming import turns

START = datetime(2024, 1, 1, tzinfo=UTC)
LOG = "session string, turn string, at timestamp, kind string"


def run(spark, batches, **options):
    """Each batch of rows is a file, read in a micro-batch of its own."""
    turns.use_rocksdb(spark)
    path, checkpoint = new_path(spark, "turn-log"), new_path(spark, "turn-checkpoint")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{path}/n={i:03}")
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    name = f"turns_{random.randrange(10**9)}"
    turns.closed_turns(stream, **options).writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return sorted(map(tuple, spark.table(name).collect()), key=str)


def at(minutes):
    return START + timedelta(minutes=minutes)


def test_quiet_turns_close_and_stay_closed(spark):
    batches = [
        [("s", "crashed", at(0), "started"), ("s", "crashed", at(1), "request"), ("s", "done", at(2), "request"), ("s", "empty", at(2), "started")],
        [("s", "done", at(5), "completed"), ("s", "slow", at(0), "started"), ("s", "slow", at(20), "other")],
        [("s", "slow", at(45), "request"), ("s", "crashed", at(50), "request"), ("s", "done", at(50), "request")],
        [("s", "slow", at(40), "request"), ("clock", "t", at(300), "started")],
        [("clock", "t", at(301), "started")],
    ]
    got = run(spark, batches)
    rows = spark.createDataFrame([r for b in batches for r in b], LOG)
    want = sorted(map(tuple, turns.closed_turns_batch(rows.where("session <> 'clock'")).collect()), key=str)
    assert got == want
    assert [(r[1], r[4], r[5]) for r in got] == [("crashed", 1, "unfinished"), ("done", 1, "completed"), ("slow", 2, "unfinished")]


def test_stream_equals_table_with_late_rows(spark):
    rng = random.Random(3)
    rows = [(f"s{rng.randrange(4)}", f"t{rng.randrange(6)}", START + timedelta(seconds=60 * m + rng.randrange(60)), rng.choice(["request", "other", "started", "request", "completed"])) for m in sorted(rng.randrange(600) for _ in range(250))]
    # Each row comes up to 20 minutes late, the delay is 25.
    order = sorted(rows, key=lambda r: (r[2] + timedelta(minutes=rng.randrange(20)), str(r)))
    batches = [order[i : i + 50] for i in range(0, len(order), 50)] + [[("clock", "t", at(2000), "started")], [("clock", "t", at(2001), "started")]]
    got = run(spark, batches, delay="25 minutes")
    want = sorted(map(tuple, turns.closed_turns_batch(spark.createDataFrame(rows, LOG)).collect()), key=str)
    assert got == want and {r[5] for r in got} == {"completed", "unfinished"}


def test_turns_share_the_state_of_a_bucket(spark, monkeypatch):
    """Calls and timers are a bucket's: turns of one bucket close each at its own time."""
    monkeypatch.setattr(turns, "BUCKETS", 1)
    rng = random.Random(9)
    rows = [(f"s{i}", "t", at(rng.randrange(400)), rng.choice(["request", "other", "completed"])) for i in range(60) for _ in range(3)]
    batches = [sorted(rows, key=lambda r: r[2]), [("clock", "t", at(2000), "started")], [("clock", "t", at(2001), "started")]]
    calls = turns.closed_turns(spark.readStream.format("rate").load().selectExpr("'s' session", "'t' turn", "timestamp at", "'request' kind"))
    assert "bucket" in calls._jdf.queryExecution().toString()
    assert run(spark, batches) == sorted(map(tuple, turns.closed_turns_batch(spark.createDataFrame(rows, LOG)).collect()), key=str)
