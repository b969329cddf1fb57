"""Sources, sinks and streams, run on what the driver's tables become when written as logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.base import events, registry, table
from tidemark.session import new_path

QUERIES, ORACLES, query = registry()


@query("SELECT event_id, user_id, floor(value * 1e6 + 0.5) / 1e6 AS output FROM events WHERE event_type = 'purchase'")
def session_log_requests(spark, sf_dir):
    """Purchases written as session files and read back as requests, a partial row before each final one."""
    from tidemark.sources import jsonl

    e = events(spark, sf_dir).where("event_type = 'purchase'")
    usage = lambda part: F.struct(F.lit(1).alias("input_tokens"), (F.col("value") * part).alias("output_tokens"))
    line = lambda part: F.to_json(F.struct(F.concat(F.lit("u"), "user_id").alias("sessionId"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), F.struct(F.concat(F.lit("m"), "event_id").alias("id"), F.lit("claude-x").alias("model"), usage(part).alias("usage")).alias("message")))
    path = new_path(spark, "sessions")
    e.select(F.explode(F.array(line(0.5), line(1.0), F.lit("not json"))).alias("value")).write.text(path)
    found, _ = jsonl.read_sessions(spark, path, "claude-code")
    number = lambda c: F.substring(c, 2, 20).cast("long")
    return found.select(number("identity.request_id").alias("event_id"), number("identity.session_id").alias("user_id"), (F.floor(F.col("usage.output") * 1e6 + 0.5) / F.lit(1e6)).alias("output"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_equals_batch(spark, sf_dir):
    """The events as a stream of files into a fact table, read twice over: late repeats add nothing."""
    from tidemark.streaming.ingest import refresh_facts

    src, store, facts = new_path(spark, "stream"), new_path(spark, "events"), new_path(spark, "facts")
    rows = events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type")
    rows.write.parquet(src)
    rows.where("event_id % 10 = 0").write.mode("append").parquet(src)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 8).parquet(src)

    def derive(df):
        return df.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))

    refresh_facts(stream, store, derive, facts, "user_id", new_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(facts).groupBy("event_type").agg(F.sum("n").alias("n"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def append_is_idempotent(spark, sf_dir):
    from tidemark.sources.sinks import append_events

    path = new_path(spark, "append")
    rows = events(spark, sf_dir).select("event_id", "ts")
    append_events(rows.where("event_id % 3 <> 0"), path)
    append_events(rows, path)
    return spark.read.parquet(path).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n FROM events WHERE NOT (event_type = 'view' AND ts >= '2024-01-10') OR event_id % 2 = 0 GROUP BY 1")
def replaced_window(spark, sf_dir):
    from datetime import UTC, datetime

    from tidemark.sources.sinks import append_events, replace_window

    path = new_path(spark, "window")
    rows = events(spark, sf_dir).select("event_id", "ts", "event_type")
    append_events(rows, path)
    bound = datetime(2024, 1, 10, tzinfo=UTC)
    replace_window(rows.where((F.col("event_type") == "view") & (F.col("ts") >= F.lit(bound)) & (F.col("event_id") % 2 == 0)), path, "view", bound, "event_type", "ts")
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, round(c_acctbal, 2) AS amount, CASE WHEN c_acctbal < 0 THEN 'api-equivalent' ELSE 'charge' END AS ledger FROM customer WHERE c_custkey % 2 = 0")
def usage_csv_roles(spark, sf_dir):
    """Customers written as a usage export whose cost cell is an amount or a word."""
    from tidemark.sources.tables import read_usage_csv

    path = new_path(spark, "csv")
    c = table(spark, sf_dir, "customer")
    cost = F.when(F.col("c_custkey") % 2 == 0, F.format_string("%.2f", "c_acctbal")).otherwise("Included")
    kind = F.when(F.col("c_acctbal") < 0, "Included in plan").otherwise("On-Demand")
    c.select(F.lit("2024-01-02").alias("Date"), kind.alias("Kind"), F.col("c_custkey").cast("string").alias("Model"), F.lit("1,234").alias("Total Tokens"), cost.alias("Cost")).write.option("header", True).csv(path)
    rows, _ = read_usage_csv(spark, path)
    return rows.where("cost_usd is not null").select(F.col("model").cast("long").alias("c_custkey"), F.round("cost_usd", 2).alias("amount"), "ledger")


@query("""WITH r AS (SELECT user_id, event_id // 5000 AS turn, ts, CASE event_type WHEN 'purchase' THEN 'request' WHEN 'error' THEN 'failed' ELSE event_type END AS kind FROM events),
b AS (SELECT *, lag(ts) OVER w AS before, coalesce(max((kind = 'failed')::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM r WINDOW w AS (PARTITION BY user_id, turn ORDER BY ts, kind)),
o AS (SELECT *, ended + coalesce(max((ts >= before + INTERVAL 12 HOUR)::INT) OVER (PARTITION BY user_id, turn ORDER BY ts, kind ROWS UNBOUNDED PRECEDING), 0) AS over FROM b),
t AS (SELECT user_id, turn, min(ts) AS started, max(ts) AS last, count_if(kind = 'request')::BIGINT AS requests, CASE WHEN max((kind = 'failed')::INT) = 1 THEN 'failed' ELSE 'unfinished' END AS status FROM o WHERE over = 0 GROUP BY 1, 2)
SELECT user_id, turn, epoch_us(started) AS started_us, epoch_us(last) AS last_us, requests, status FROM t, (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events)
WHERE (requests > 0 OR status = 'failed') AND CASE WHEN status = 'failed' THEN last ELSE last + INTERVAL 12 HOUR END <= mark""")
def closed_turns_stream(spark, sf_dir):
    """Turns that the stream of events closes: by a failure, or after half a day of quiet behind the watermark."""
    from tidemark.streaming import turns

    turns.use_rocksdb(spark)
    src, out = new_path(spark, "turn-log"), new_path(spark, "turns")
    kind = F.when(F.col("event_type") == "purchase", turns.REQUEST).when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type"))
    rows = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("session"), F.floor(F.col("event_id") / 5000).cast("string").alias("turn"), F.col("ts").alias("at"), kind.alias("kind"))
    rows.write.parquet(src)
    found = turns.closed_turns(spark.readStream.schema(rows.schema).parquet(src), idle_minutes=720)
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_path(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(out).select(F.col("session").cast("long").alias("user_id"), F.col("turn").cast("long").alias("turn"), F.unix_micros("started_at").alias("started_us"), F.unix_micros("last_at").alias("last_us"), "requests", "status")


@query("""WITH p AS (SELECT user_id, CAST(strftime(ts, '%d') AS INT) // 7 AS week, last_value(CASE WHEN event_type = 'signup' THEN 'b' || (event_id % 3) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS branch FROM events)
SELECT user_id, week, branch, count(*) AS n FROM p GROUP BY 1, 2, 3""")
def history_refresh(spark, sf_dir):
    """Facts of an old history, then of a newer one, for which only the families are derived that it touches."""
    from tidemark.operators.asof import asof_join
    from tidemark.streaming import families

    e = events(spark, sf_dir).select("event_id", "user_id", (F.floor(F.dayofmonth("ts") / 7)).cast("long").alias("week"), "ts", "event_type")
    moves = e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("at"), F.concat(F.lit("b"), F.col("event_id") % 3).alias("branch"), "event_id")

    def derive_with(history):
        return lambda rows: asof_join(rows, history, ["user_id"], "ts", "at", ["branch"], ["event_id"]).groupBy("user_id", "week", "branch").agg(F.count("*").alias("n"))

    log = families.FactLog(spark, new_path(spark, "fact-log"), "user_id long, week long, branch string, n long", ["user_id", "week"])
    before = moves.where("event_id % 5 <> 0")
    log.refresh(e, e, derive_with(before))
    changed = families.changed_stretches(before, moves, ["user_id"], "at", "branch", ["event_id"])
    log.refresh(e, families.affected_families(e, changed, ["user_id"], "ts", ["user_id", "week"]), derive_with(moves))
    return log.read()
