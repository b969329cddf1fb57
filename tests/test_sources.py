"""Readers on files written here, sinks, and streams against the batch result."""

import gzip
import json
import sqlite3
from datetime import UTC, datetime

import pytest
import zstandard
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.sources import jsonl, sinks, tables
from tidemark.streaming import ingest


def line(session, request, output, model="claude-x", cache=None):
    usage = {"input_tokens": 1, "output_tokens": output, **({"cache_read_input_tokens": cache} if cache is not None else {})}
    return json.dumps({"sessionId": session, "timestamp": "2024-01-01T00:00:00Z", "cwd": "/r", "message": {"id": request, "model": model, "usage": usage}})


def test_best_row_per_request_and_rejected_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join([line("s", "m1", 1), "broken", line("s", "m1", 7), line("s", "m2", 3), '{"type": "user", "sessionId": "s"}']))
    (tmp_path / "b.jsonl.gz").write_bytes(gzip.compress(line("t", "m1", 2).encode()))
    events, coverage = jsonl.read_sessions(spark, str(tmp_path), "claude-code")
    assert {(r.identity.session_id, r.identity.request_id, r.usage.output) for r in events.collect()} == {("s", "m1", 7.0), ("s", "m2", 3.0), ("t", "m1", 2.0)}
    assert events.schema == schemas.EVENT or events.columns == schemas.EVENT.names
    assert sum(r.rejected for r in coverage.collect()) == 1


def test_ids_are_stable_on_a_second_read(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(line("s", "m1", 1))
    read = lambda: [r.event_id for r in jsonl.read_sessions(spark, str(tmp_path), "claude-code")[0].collect()]
    assert read() == read()


def test_zstd_frames(spark, tmp_path):
    frames = b"".join(zstandard.compress(json.dumps({"session": "s", "slot": i, "at": "2024-01-01T00:00:00Z", "model": "deepseek-v3", "usage": {"output": 2}}).encode() + b"\n") for i in range(3))
    (tmp_path / "session.v2").write_bytes(frames)
    rows = jsonl.requests(jsonl.parse_lines(tables.read_zstd_lines(spark, str(tmp_path)), jsonl.GRAMMARS["deepseek"]))
    assert rows.count() == 3


def test_csv_layouts(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Date,Kind,Model,Input (w/ Cache Write),Input (w/o Cache Write),Cache Read,Output Tokens,Total Tokens,Cost\n2024-01-02T03:04:05.000Z,Included,gpt-4o,"1,000",5,6,7,1018,Included\n2024-01-02,On-Demand,gpt-4o,,,,,,$0.10\nnever,x,y,,,,,,\n')
    rows, rejected = tables.read_usage_csv(spark, str(tmp_path / "a.csv"))
    got = {r.kind: (r.cache_write, r.cost_usd, r.cost_word, r.ledger) for r in rows.collect()}
    assert got == {"Included": (1000.0, None, "Included", None), "On-Demand": (None, 0.1, None, "charge")} and rejected.count() == 1
    (tmp_path / "b.csv").write_text("name,value\na,1\n")
    with pytest.raises(ValueError):
        tables.read_usage_csv(spark, str(tmp_path / "b.csv"))


def test_reports_and_logs(spark, tmp_path):
    (tmp_path / "t.xml").write_text('<testsuites><testsuite name="a" tests="3" failures="1" errors="0"/><testsuite name="b" tests="2" failures="0" errors="0"/></testsuites>')
    assert {r.suite: r.outcome for r in tables.read_junit(spark, str(tmp_path / "t.xml")).collect()} == {"a": "failed", "b": "passed"}
    (tmp_path / "tsc.txt").write_text("src/a.ts(3,4): error TS2304: Cannot find name\n\x1b[96msrc/b.ts\x1b[0m:1:2 - error TS1: No\nok\n")
    assert {(r.file, r.line, r.code) for r in tables.read_tsc(spark, str(tmp_path / "tsc.txt")).collect()} == {("src/a.ts", 3, "TS2304"), ("src/b.ts", 1, "TS1")}
    (tmp_path / "log").write_text("\x1eabc\x1f1700000000\x1fsubject\n3\t1\tf.py\n-\t-\tg.bin\n\x1edef\x1f1700000001\x1fempty\n")
    assert {(r.sha, r.file, r.added) for r in tables.read_git_log(spark, str(tmp_path / "log")).collect()} == {("abc", "f.py", 3), ("abc", "g.bin", None), ("def", None, None)}
    (tmp_path / "reflog").write_text("HEAD@{1700000000}\x1fcheckout: moving from main to dev\nHEAD@{1700000005}\x1fcommit: x\n")
    assert [(r.kind, r["from"], r.to) for r in tables.read_reflog(spark, str(tmp_path / "reflog")).collect()] == [("checkout", "main", "dev")]
    (tmp_path / "note").write_text("src/a.py\n  p1 1-4,7\n  p2 9\nsrc/b.py\n  p1 2-3\n---\n{}")
    assert {(r.file, r.prompt): r.lines for r in tables.read_authorship(spark, str(tmp_path / "note")).collect()} == {("src/a.py", "p1"): 5, ("src/a.py", "p2"): 1, ("src/b.py", "p1"): 2}


def test_pages_catalogs_and_otlp(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"data": [{"start_time": 1700000000, "end_time": 1700003600, "results": [{"model": "m", "input_tokens": 5, "output_tokens": 6}]}]}))
    r = tables.read_provider_pages(spark, str(tmp_path / "p.json")).first()
    assert (r.model, r.input, r.output, r.scope) == ("m", 5.0, 6.0, "account-bucket")
    event = {"timestamp": "1700000000000", "model": "m", "kind": "x", "isChargeable": True, "requestId": "q", "tokenUsage": {"inputTokens": 1}}
    (tmp_path / "d.json").write_text(json.dumps({"usageEventsDisplay": [event, event]}))
    assert [r.ledger for r in tables.read_dashboard(spark, str(tmp_path / "d.json")).collect()] == ["charge"]
    (tmp_path / "c.json").write_text(json.dumps({"gpt-x": {"input_cost_per_token": 1e-6, "output_cost_per_token": 2e-6}}))
    assert tables.read_catalog(spark, str(tmp_path / "c.json"), "per-token").first().output == pytest.approx(2.0)
    body = {"resourceLogs": [{"scopeLogs": [{"logRecords": [{"timeUnixNano": "1700000000000000000", "attributes": [{"key": "model", "value": {"stringValue": "m"}}, {"key": "n", "value": {"intValue": "4"}}]}]}]}]}
    (tmp_path / "o.json").write_text(json.dumps(body))
    assert tables.read_otlp(spark, str(tmp_path / "o.json")).first().attributes == {"model": "m", "n": "4"}
    assert tables.wire_fields(b"\x08\x96\x01\x12\x02hi") == [(1, 0, 150), (2, 2, b"hi")]
    db = sqlite3.connect(tmp_path / "x.db")
    db.execute("CREATE TABLE t (a INT, b TEXT)")
    db.execute("INSERT INTO t VALUES (1, 'x'), (2, NULL)")
    db.commit()
    db.close()
    assert {(r.a, r.b) for r in tables.read_sqlite(spark, str(tmp_path / "x.db"), "SELECT a, b FROM t", "a long, b string").collect()} == {(1, "x"), (2, None)}


def test_append_replace_and_freeze(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", datetime(2024, 1, 1)), ("b", "x", datetime(2024, 1, 3)), ("c", "y", datetime(2024, 1, 3))], "event_id string, adapter_id string, occurred_at timestamp")
    path = str(tmp_path / "events")
    assert sinks.append_events(rows, path) == (3, 0) and sinks.append_events(rows, path) == (0, 3)
    first = sinks.freeze_snapshot(spark.read.parquet(path), str(tmp_path))
    assert sinks.freeze_snapshot(spark.read.parquet(path), str(tmp_path)) == first
    fresh = spark.createDataFrame([("d", "x", datetime(2024, 1, 4))], rows.schema)
    sinks.replace_window(fresh, path, "x", datetime(2024, 1, 2, tzinfo=UTC))
    assert {r.event_id for r in spark.read.parquet(path).collect()} == {"a", "c", "d"}
    assert sinks.freeze_snapshot(spark.read.parquet(path), str(tmp_path)) != first
    ledgers = spark.createDataFrame([(1.0, None), (2.0, None)], "estimate double, billed double")
    assert sinks.over_limit(ledgers, 2.5) == ["estimate"]


def test_settle_holds_until_final(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("r1", 1.0, False), ("r1", 5.0, True), ("r2", 2.0, False)], "request string, output double, final boolean").write.parquet(src)
    stream = spark.readStream.schema("request string, output double, final boolean").parquet(src)
    q = ingest.settle(stream).writeStream.format("memory").queryName("settled").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(15)
    q.stop()
    assert [(r.request, r.output) for r in spark.sql("select * from settled").collect()] == [("r1", 5.0)]


def test_late_duplicates_and_windows(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(1, datetime(2024, 1, 1, 1)), (1, datetime(2024, 1, 1, 1)), (2, datetime(2024, 1, 1, 2))]
    spark.createDataFrame(rows, "event_id long, ts timestamp").write.parquet(src)
    stream = spark.readStream.schema("event_id long, ts timestamp").parquet(src)
    q = ingest.without_late_duplicates(stream).writeStream.format("memory").queryName("once").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(15)
    q.stop()
    assert spark.sql("select * from once").count() == 2


def test_upgrade_fills_with_null(spark):
    old = spark.createDataFrame([("e", "ai.usage")], "event_id string, kind string")
    r = schemas.upgrade(old).first()
    assert r.schema_version == "2" and r.usage is None and r.context is None


def test_engine(spark):
    from tidemark.api import Engine
    from tidemark.operators.cube import UsageQuery

    f = spark.createDataFrame([("a", 1, 1.0), (None, 2, None)], "tool string, user_id long, amount double").withColumn("ts", F.lit(datetime(2024, 1, 1)))
    e = Engine(spark, f)
    out = e.usage(UsageQuery(measures=("amount",), session="user_id", ts="ts", group="tool", bucket="day", sort="amount"))
    assert out["total"].first().amount == 1.0 and out["unattributed"].first().amount is None and out["series"].count() == 1
    e.metrics["bad"] = lambda df: 1 / 0
    e.metrics["n"] = lambda df: df.agg(F.count("*").alias("n"))
    rows, notes = e.analyze()
    assert rows.first().n == 2 and notes == ["bad: ZeroDivisionError"]
