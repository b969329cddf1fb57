"""Islands, intervals, ordering and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import islands, paging
from tidemark.plans.base import events, micros, registry, table

QUERIES, ORACLES, query = registry()

ISLANDS = """SELECT user_id, ts, event_id, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM (
SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= {gap} THEN 0 ELSE 1 END AS n FROM events)"""


@query(f"WITH b AS ({ISLANDS.format(gap=1800 * 10**6)}) SELECT user_id, burst::BIGINT AS burst, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS points FROM b GROUP BY 1, 2")
def idle_bursts_30m(spark, sf_dir):
    out = islands.burst_intervals(events(spark, sf_dir), ["user_id"], "ts")
    return out.select("user_id", "burst", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "points")


@query(f"""WITH b AS ({ISLANDS.format(gap=8 * 3600 * 10**6)}), m AS (SELECT max(ts) AS mx FROM events)
SELECT user_id, burst::BIGINT AS burst, epoch_us(min(ts)) AS start_us, count(*) AS points, epoch_us(any_value(mx)) - epoch_us(max(ts)) <= 86400000000 AS "current" FROM b, m GROUP BY 1, 2""")
def episodes_8h(spark, sf_dir):
    e = events(spark, sf_dir)
    last = e.agg(F.max("ts").alias("as_of"))
    out = islands.burst_intervals(e, ["user_id"], "ts", 8 * 3600).join(F.broadcast(last))
    return out.select("user_id", "burst", F.unix_micros("start").alias("start_us"), "points", (F.unix_micros("as_of") - F.unix_micros("end") <= 86400 * 10**6).alias("current"))


def _intervals(spark, sf_dir):
    start = F.unix_millis("ts")
    length = F.when(F.col("event_id") % 11 == 0, None).when(F.col("event_id") % 13 == 0, F.lit(-5).cast("long")).otherwise((F.col("value") * 60000).cast("long"))
    return events(spark, sf_dir).select("user_id", start.alias("start_ms"), (start + length).alias("end_ms"))


IV = """iv AS (SELECT user_id, epoch_us(ts) // 1000 AS s, epoch_us(ts) // 1000 + CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN -5 ELSE trunc(value * 60000)::BIGINT END AS e FROM events)"""
UNION = f"""{IV}, v AS (SELECT * FROM iv WHERE e >= s), n AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM v),
i AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM n), u AS (SELECT user_id, min(s) AS s, max(e) AS e FROM i GROUP BY user_id, g)"""


@query(f"WITH {UNION} SELECT user_id, s AS start_ms, e AS end_ms FROM u")
def interval_union(spark, sf_dir):
    return islands.union_intervals(_intervals(spark, sf_dir), ["user_id"], "start_ms", "end_ms")


@query(f"""WITH {UNION}, t AS (SELECT user_id, sum(e - s)::BIGINT AS total_ms FROM u GROUP BY 1), x AS (SELECT user_id, count(*) FILTER (WHERE e IS NULL OR e < s) AS excluded FROM iv GROUP BY 1)
SELECT x.user_id, excluded, total_ms, excluded > 0 AS lower_bound FROM x LEFT JOIN t ON x.user_id = t.user_id""")
def interval_totals(spark, sf_dir):
    return islands.interval_totals(_intervals(spark, sf_dir), ["user_id"], "start_ms", "end_ms")


@query(f"WITH {IV} SELECT user_id, CASE WHEN e IS NULL THEN 'censored' WHEN e < s THEN 'clock-error' ELSE 'valid' END AS kind, count(*) AS n FROM iv GROUP BY 1, 2")
def interval_classes(spark, sf_dir):
    iv = _intervals(spark, sf_dir)
    return iv.groupBy("user_id", islands.classify(F.col("start_ms"), F.col("end_ms")).alias("kind")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, greatest(0, least(o_orderkey + 40, o_custkey + 90) - greatest(o_orderkey, o_custkey)) AS overlap FROM orders""")
def interval_overlap(spark, sf_dir):
    s1, s2 = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", islands.overlap_ms(s1, s1 + 40, s2, s2 + 90).alias("overlap"))


@query("SELECT event_id, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS valid_to_us FROM events WHERE event_type = 'signup'")
def head_segments(spark, sf_dir):
    moves = events(spark, sf_dir).where("event_type = 'signup'")
    return islands.segments(moves, ["user_id"], "ts", ["event_id"]).select("event_id", F.unix_micros("valid_to").alias("valid_to_us"))


@query("""SELECT event_id, min(event_type) OVER (PARTITION BY date_trunc('minute', ts)) <> max(event_type) OVER (PARTITION BY date_trunc('minute', ts)) AS uncertain FROM events""")
def timeline_uncertain(spark, sf_dir):
    return paging.uncertain(events(spark, sf_dir), "ts", "event_type", "minute").select("event_id", "uncertain")


@query("SELECT event_id, position FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_type, event_id)::INT AS position FROM events) WHERE position > 100 AND position <= 150")
def timeline_page(spark, sf_dir):
    order = [F.col("ts").asc_nulls_last(), F.col("event_type"), F.col("event_id")]
    return paging.page(events(spark, sf_dir), order, 100, 50).select("event_id", "position")


@query("""WITH s AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) // 1000 END AS a, CASE WHEN event_id % 2 = 0 THEN epoch_us(ts) // 1000 + 500 END AS b, CASE WHEN event_id % 5 <> 0 THEN 400 END AS d FROM events),
x AS (SELECT event_id, coalesce(a, b - d) AS s, coalesce(b, a + d) AS e FROM s)
SELECT event_id, CASE WHEN s IS NOT NULL AND e IS NOT NULL THEN s END AS start_ms, CASE WHEN s IS NOT NULL AND e IS NOT NULL THEN e END AS end_ms FROM x""")
def explicit_intervals(spark, sf_dir):
    at, i = F.unix_millis("ts"), F.col("event_id")
    found = islands.explicit_interval(F.when(i % 3 == 0, at), F.when(i % 2 == 0, at + 500), F.when(i % 5 != 0, F.lit(400)))
    return events(spark, sf_dir).select("event_id", found["start"].alias("start_ms"), found["end"].alias("end_ms"))


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_event, arg_max(event_id, (ts, event_id)) AS last_event, epoch_us(max(ts)) AS last_us FROM events GROUP BY 1")
def first_last_per_key(spark, sf_dir):
    order = F.struct("ts", "event_id")
    return events(spark, sf_dir).groupBy("user_id").agg(F.min_by("event_id", order).alias("first_event"), F.max_by("event_id", order).alias("last_event"), F.max(micros("ts")).alias("last_us"))
