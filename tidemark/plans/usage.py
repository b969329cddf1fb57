"""The grouped usage query and its parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import tokens
from tidemark.operators import cube
from tidemark.plans.base import EVENTS_SQL, events, money, money_sql, registry, table

QUERIES, ORACLES, query = registry()
BASE = cube.UsageQuery(measures=("amount",), session="user_id", ts="ts", group="tool", stack="tool", sort="amount", bucket="day")


def _q(**changes) -> cube.UsageQuery:
    from dataclasses import replace

    return replace(BASE, **changes)


def _rounded(df):
    return df.withColumn("amount", money(F.col("amount")))


SUMS = f"{money_sql('sum(amount)')} AS amount, count(*) AS facts, count(DISTINCT user_id) AS sessions"


@query(f"WITH {EVENTS_SQL} SELECT tool AS key, {SUMS} FROM e WHERE tool IS NOT NULL GROUP BY tool")
def usage_by_type(spark, sf_dir):
    return _rounded(cube.groups(events(spark, sf_dir), _q()))


@query(f"WITH {EVENTS_SQL} SELECT {SUMS} FROM e")
def usage_total(spark, sf_dir):
    return _rounded(cube.totals(events(spark, sf_dir), _q()))


@query(f"WITH {EVENTS_SQL} SELECT NULL::DOUBLE AS amount, count(*) AS facts, NULL::BIGINT AS sessions FROM e WHERE tool = 'nothing'")
def usage_total_of_nothing(spark, sf_dir):
    return _rounded(cube.totals(events(spark, sf_dir), _q(filters={"tool": ("nothing",)})))


@query(f"""WITH {EVENTS_SQL}, g AS (SELECT tool, row_number() OVER (ORDER BY sum(amount) DESC NULLS LAST, tool) AS r FROM e WHERE tool IS NOT NULL GROUP BY tool),
l AS (SELECT tool, least(r, 3)::INT AS rank, CASE WHEN r <= 2 THEN tool ELSE '(other)' END AS key FROM g)
SELECT rank, key, {SUMS} FROM e JOIN l USING (tool) GROUP BY rank, key""")
def usage_topn_other(spark, sf_dir):
    return _rounded(cube.top_groups(events(spark, sf_dir), _q(limit=2)))


@query(f"WITH {EVENTS_SQL} SELECT {SUMS} FROM e WHERE tool IS NULL")
def usage_unattributed(spark, sf_dir):
    return _rounded(cube.unattributed(events(spark, sf_dir), _q()))


@query(f"WITH {EVENTS_SQL} SELECT strftime(ts, '%Y-%m-%d') AS bucket, {SUMS} FROM e GROUP BY 1")
def usage_by_day(spark, sf_dir):
    return _rounded(cube.series(events(spark, sf_dir), _q(stack=None)))


@query(f"WITH {EVENTS_SQL} SELECT strftime(date_trunc('week', (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York'), '%Y-%m-%d') AS bucket, {SUMS} FROM e GROUP BY 1")
def usage_by_week_tz(spark, sf_dir):
    return _rounded(cube.series(events(spark, sf_dir), _q(stack=None, bucket="week", zone="America/New_York")))


@query(f"WITH {EVENTS_SQL} SELECT strftime(ts, '%Y-%m') AS bucket, {SUMS} FROM e GROUP BY 1")
def usage_by_month(spark, sf_dir):
    return _rounded(cube.series(events(spark, sf_dir), _q(stack=None, bucket="month")))


@query(f"""WITH {EVENTS_SQL}, g AS (SELECT tool, row_number() OVER (ORDER BY sum(amount) DESC NULLS LAST, tool) AS r FROM e WHERE tool IS NOT NULL GROUP BY tool),
x AS (SELECT strftime(ts, '%Y-%m-%d') AS bucket, CASE WHEN e.tool IS NULL THEN '(none)' WHEN r <= 2 THEN e.tool ELSE '(other)' END AS stack, amount, user_id FROM e LEFT JOIN g USING (tool))
SELECT bucket, stack, {SUMS} FROM x GROUP BY GROUPING SETS ((bucket, stack), (bucket))""")
def usage_stacked_series(spark, sf_dir):
    return _rounded(cube.series(events(spark, sf_dir), _q(limit=2)))


@query(f"WITH {EVENTS_SQL} SELECT event_type AS key, {SUMS} FROM e WHERE coalesce(tool, '(none)') IN ('(none)', 'click') AND ts >= '2024-01-05' AND ts < '2024-01-12' GROUP BY 1")
def usage_filtered_window(spark, sf_dir):
    q = _q(group="event_type", filters={"tool": ("(none)", "click")}, since="2024-01-05", until="2024-01-12")
    return _rounded(cube.groups(events(spark, sf_dir), q))


@query("SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'")
def half_open_window(spark, sf_dir):
    from tidemark.functions.times import in_window

    bound = lambda v: F.lit(v).cast("timestamp")
    return events(spark, sf_dir).where(in_window(F.col("ts"), bound("2024-01-10"), bound("2024-01-11"))).agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS_SQL} SELECT count(*) AS n FROM e WHERE tool IS NULL OR tool = 'view'")
def none_filter(spark, sf_dir):
    return events(spark, sf_dir).where(cube.matches({"tool": ("(none)", "view")})).agg(F.count("*").alias("n"))


@query(f"""WITH {EVENTS_SQL}, x AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 'account-bucket' ELSE 'request' END AS scope FROM e)
SELECT event_type AS key, {SUMS} FROM x WHERE scope <> 'account-bucket' GROUP BY 1""")
def account_bucket_exclusion(spark, sf_dir):
    scoped = events(spark, sf_dir).withColumn("scope", F.when(F.col("event_type") == "purchase", "account-bucket").otherwise("request"))
    return _rounded(cube.groups(scoped, _q(group="event_type", scope="scope")))


@query(f"""WITH {EVENTS_SQL}, s AS (SELECT user_id, min(ts) AS f, max(ts) AS t, CASE WHEN count(DISTINCT coalesce(tool, '~')) = 1 THEN min(tool) END AS tool,
bool_and(event_type <> 'error') AS match_all, bool_or(event_type <> 'error') AS match_any FROM e GROUP BY user_id, strftime(ts, '%Y-%m-%d'))
SELECT user_id, epoch_us(f) AS from_us, epoch_us(t) AS to_us, tool, match_all, match_any FROM s""")
def session_span_common_key(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    spans = cube.session_spans(e, ["user_id", "day"], "ts", ["tool"], F.col("event_type") != "error")
    return spans.select("user_id", F.unix_micros("from_ts").alias("from_us"), F.unix_micros("to_ts").alias("to_us"), "tool", "match_all", "match_any")


@query(f"""WITH {EVENTS_SQL}, d AS (SELECT *, CAST(ts AS DATE) AS day FROM e),
s AS (SELECT user_id, day, min(ts) AS f, max(ts) AS t, bool_and(event_type <> 'error') AS a, bool_or(event_type <> 'error') AS o FROM d GROUP BY 1, 2),
g AS (SELECT user_id, day, max(value) AS figure FROM d GROUP BY 1, 2)
SELECT user_id, figure, coalesce(f >= '2024-01-05 06:00' AND t < '2024-01-12 06:00' AND a, false) AS included,
(t >= '2024-01-05 06:00' AND f < '2024-01-12 06:00' AND o) AND NOT (f >= '2024-01-05 06:00' AND t < '2024-01-12 06:00' AND a) AS cut FROM g JOIN s USING (user_id, day)""")
def session_figure_placement(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    spans = cube.session_spans(e, ["user_id", "day"], "ts", [], F.col("event_type") != "error")
    figures = e.groupBy("user_id", "day").agg(F.max("value").alias("figure"))
    bound = lambda v: F.lit(v).cast("timestamp")
    placed = cube.place_figures(figures, spans, ["user_id", "day"], bound("2024-01-05 06:00"), bound("2024-01-12 06:00"))
    return placed.select("user_id", "figure", "included", "cut")


@query(f"""WITH {EVENTS_SQL}, f AS (SELECT DISTINCT user_id FROM e WHERE event_type = 'purchase' AND value > 400)
SELECT event_id FROM e WHERE (ts >= '2024-01-10' AND ts < '2024-01-12') OR user_id IN (SELECT user_id FROM f)""")
def semi_open_sessions(spark, sf_dir):
    e = events(spark, sf_dir)
    figures = e.where("event_type = 'purchase' and value > 400")
    bound = lambda v: F.lit(v).cast("timestamp")
    return cube.facts_to_read(e, figures, ["user_id"], "ts", bound("2024-01-10"), bound("2024-01-12")).select("event_id")


@query("""SELECT l_returnflag, floor(sum(CASE WHEN l_tax > 0.09 THEN NULL WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity END) * 1e6 + 0.5) / 1e6 AS qty FROM lineitem GROUP BY 1""")
def null_preserving_sum(spark, sf_dir):
    known = F.when((F.col("l_tax") <= 0.09) & (F.col("l_returnflag") != "R"), F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(money(F.sum(known)).alias("qty"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN l_quantity END AS a, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 2 END AS b,
CASE WHEN l_linenumber = 5 THEN 7.0 END AS total FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(total, CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN coalesce(a, 0) + coalesce(b, 0) END) AS tokens,
CASE WHEN a IS NULL AND b IS NULL THEN total ELSE greatest(total, coalesce(a, 0) + coalesce(b, 0)) END AS writes FROM t""")
def token_total(spark, sf_dir):
    n, qty = F.col("l_linenumber"), F.col("l_quantity")
    a, b, total = F.when(n % 3 == 0, qty), F.when(n % 2 == 0, qty * 2), F.when(n == 5, 7.0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tokens.token_total(total, a, b).alias("tokens"), tokens.cache_writes(total, a, b).alias("writes"))


@query("""SELECT l_orderkey, l_linenumber, u.category, u.value FROM lineitem,
LATERAL (SELECT unnest(['input', 'output', 'cache']) AS category, unnest([l_quantity, CASE WHEN l_tax > 0.02 THEN l_extendedprice END, CASE WHEN l_linenumber = 1 THEN l_discount END]) AS value) u WHERE u.value IS NOT NULL""")
def token_categories(spark, sf_dir):
    parts = {"input": F.col("l_quantity"), "output": F.when(F.col("l_tax") > 0.02, F.col("l_extendedprice")), "cache": F.when(F.col("l_linenumber") == 1, F.col("l_discount"))}
    exploded = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.explode(tokens.token_categories(parts)).alias("t"))
    return exploded.select("l_orderkey", "l_linenumber", "t.category", "t.value")


@query("SELECT n_regionkey, c_nationkey, count(*) AS n, floor(sum(c_acctbal) * 1e6 + 0.5) / 1e6 AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, c_nationkey)")
def rollup_total(spark, sf_dir):
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.rollup("n_regionkey", "c_nationkey").agg(F.count("*").alias("n"), money(F.sum("c_acctbal")).alias("balance"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_2d(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'")
def intersect_users(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.where("event_type = 'purchase'").select("user_id").intersect(e.where("event_type = 'error'").select("user_id"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def remainder_anti(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left_anti").distinct()


@query("""SELECT epoch_us(w) AS start_us, event_type, count(*) AS n FROM (SELECT event_type, unnest(range(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS w FROM events) GROUP BY 1, 2""")
def sliding_7d(spark, sf_dir):
    win = F.window(F.col("ts"), "7 days", "1 day")
    return events(spark, sf_dir).groupBy(win.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_micros("w.start").alias("start_us"), "event_type", "n")


@query("SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90 FROM events GROUP BY 1")
def percentiles(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.percentile("value", 0.5).alias("p50"), F.percentile("value", 0.9).alias("p90"))


@query()
def approx_sessions(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("sessions"))
