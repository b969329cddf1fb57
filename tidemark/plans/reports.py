"""Metrics and reports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import friction, metrics
from tidemark.plans.base import EVENTS_SQL, cents, events, micros, money, registry, table

QUERIES, ORACLES, query = registry()


@query(f"""WITH {EVENTS_SQL} SELECT user_id, count(*) AS runs, count(*) FILTER (WHERE event_type = 'error') AS failures, count(*) FILTER (WHERE event_type IN ('error', 'click')) AS known,
count(*) FILTER (WHERE event_type = 'error')::DOUBLE / nullif(count(*) FILTER (WHERE event_type IN ('error', 'click')), 0) AS rate FROM e GROUP BY 1""")
def failure_rates(spark, sf_dir):
    runs = events(spark, sf_dir).withColumn("outcome", F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "passed").otherwise("unknown"))
    return metrics.failure_rates(runs, ["user_id"], "outcome")


@query(f"""WITH {EVENTS_SQL}, r AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS failures, count(*) FILTER (WHERE event_type IN ('error', 'click')) AS known FROM e GROUP BY 1),
f AS (SELECT *, failures::DOUBLE / known AS rate, 'medium' AS severity FROM r WHERE known >= 3 AND failures::DOUBLE / known >= 0.2)
SELECT * FROM (SELECT row_number() OVER (ORDER BY failures DESC, user_id)::INT AS rank, user_id, severity, failures, known, rate FROM f) WHERE rank <= 10""")
def failure_rate_findings(spark, sf_dir):
    return metrics.findings(failure_rates(spark, sf_dir), "user_id", 3, 0.2)


@query(f"""WITH {EVENTS_SQL}, runs AS (SELECT CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'passed' ELSE 'unknown' END AS outcome, k FROM e),
tests AS (SELECT 't' || t AS test, count(*) AS n FROM (SELECT k AS t FROM runs WHERE outcome = 'failed' UNION ALL SELECT k + 1 FROM runs WHERE outcome = 'failed') GROUP BY 1),
total AS (SELECT count(*) AS calls, count(*) FILTER (WHERE outcome = 'failed') AS failed, count(*) FILTER (WHERE outcome <> 'unknown') AS known FROM runs),
d AS (SELECT 'friction.test-repeated-failure:' || test AS finding_id, 'high' AS severity, n AS weight FROM tests WHERE n >= 2
UNION ALL SELECT 'friction.test-failure-rate', 'medium', failed FROM total WHERE known >= 3 AND failed / known >= 0.5
UNION ALL SELECT 'friction.tool-failure-rate', 'medium', failed FROM total WHERE failed >= 3 AND failed / calls >= 0.2
UNION ALL SELECT 'friction.command-repeated-failure:' || user_id, 'medium', count(*) FROM e WHERE event_type = 'error' GROUP BY user_id HAVING count(*) >= 2
UNION ALL SELECT 'friction.file-rework:' || k, CASE WHEN count(*) >= 10 THEN 'medium' ELSE 'low' END, count(*) FROM e WHERE event_type = 'purchase' GROUP BY k HAVING count(*) >= 5)
SELECT rank, finding_id, severity, weight FROM (SELECT *, row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, weight DESC, finding_id)::INT AS rank FROM d) WHERE rank <= 10""")
def friction_findings(spark, sf_dir):
    e = events(spark, sf_dir)
    outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "passed").otherwise("unknown")
    name = lambda k: F.concat(F.lit("t"), k.cast("string"))
    failing = F.when(F.col("event_type") == "error", F.array(name(F.col("k")), name(F.col("k") + 1), name(F.col("k"))))
    runs = e.select(outcome.alias("outcome"), failing.alias("failing"))
    drafts = [
        friction.run_findings(runs, "outcome", "failing"), friction.tool_findings(e.select((F.col("event_type") == "error").alias("failed")), "failed"),
        friction.command_findings(e.where("event_type = 'error'"), "user_id"), friction.rework_findings(e.where("event_type = 'purchase'"), "k"),
    ]
    return friction.ranked(drafts)


@query("""WITH g AS (SELECT min(o_orderdate) AS s FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= '1995-06-01'),
u AS (SELECT * FROM orders, g WHERE (o_orderstatus = 'F' AND o_orderdate >= '1995-06-01') OR (o_orderstatus <> 'F' AND o_orderdate < g.s))
SELECT count(*) AS rows, floor(sum(CASE WHEN o_custkey % 3 <> 0 THEN o_totalprice END) * 100 + 0.5) / 100 AS linked, floor(sum(CASE WHEN o_custkey % 3 = 0 THEN o_totalprice END) * 100 + 0.5) / 100 AS unlinked,
count(DISTINCT CASE WHEN o_custkey % 3 <> 0 THEN o_custkey END) AS conversations FROM u""")
def account_cutover(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp"))
    dashboard = F.col("o_orderstatus") == "F"
    rows = o.where(~dashboard | (F.col("at") >= F.lit("1995-06-01").cast("timestamp"))).select(
        F.when(dashboard, "dashboard").otherwise("export").alias("origin"), "at", "o_totalprice", F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("conversation")
    )
    out = metrics.account_summary(rows, "origin", "at", "o_totalprice", "conversation")
    return out.select("rows", cents(F.col("linked")).alias("linked"), cents(F.col("unlinked")).alias("unlinked"), "conversations")


@query("SELECT l_partkey, count(DISTINCT l_orderkey) AS touches FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 1")
def retouched_parts(spark, sf_dir):
    return metrics.retouched(table(spark, sf_dir, "lineitem"), "l_partkey", "l_orderkey")


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem), b AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber, l_orderkey) AS s FROM a WHERE r = 1)
SELECT l_orderkey, l_partkey FROM b WHERE s = 1""")
def rewrite_dedupe(spark, sf_dir):
    from tidemark.operators.facts import one_per_key

    first = one_per_key(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey")])
    return one_per_key(first, ["l_partkey"], [F.col("l_linenumber"), F.col("l_orderkey")]).select("l_orderkey", "l_partkey")


@query("""SELECT n_name, o_orderstatus, epoch_us(min(o_orderdate)) AS first_us, epoch_us(max(o_orderdate)) AS last_us, count(*) AS facts, count(DISTINCT o_custkey) AS sessions, floor(sum(o_totalprice) * 100 + 0.5) / 100 AS o_totalprice
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def history_rows(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    out = metrics.history(joined, ["n_name", "o_orderstatus"], "o_orderdate", ["o_totalprice"], "o_custkey")
    return out.select("n_name", "o_orderstatus", micros("first_at").alias("first_us"), micros("last_at").alias("last_us"), "facts", "sessions", cents(F.col("o_totalprice")).alias("o_totalprice"))


@query("""SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'assistant') AS requests, left(arg_min(text, turn) FILTER (WHERE role = 'user'), 40) AS title, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1""")
def chat_nodes(spark, sf_dir):
    return metrics.chat_nodes(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@query("SELECT p.conv_id FROM (SELECT DISTINCT conv_id FROM conversations) p LEFT JOIN (SELECT DISTINCT conv_id FROM conversations) q ON p.conv_id % 4 <> 0 AND p.conv_id // 2 = q.conv_id AND p.conv_id <> q.conv_id WHERE q.conv_id IS NULL")
def chat_tree_roots(spark, sf_dir):
    nodes = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    parents = nodes.select(F.col("conv_id").alias("parent"))
    child = nodes.withColumn("up", F.when(F.col("conv_id") % 4 != 0, F.floor(F.col("conv_id") / 2)))
    return child.join(parents, (F.col("up") == F.col("parent")) & (F.col("conv_id") != F.col("parent")), "left_anti").select("conv_id")


@query("SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE event_type IS DISTINCT FROM b")
def model_timeline(spark, sf_dir):
    return metrics.model_timeline(events(spark, sf_dir), ["user_id"], "ts", "event_type", ["event_id"]).select("event_id", "event_type")


@query(f"""WITH {EVENTS_SQL}, s AS (SELECT event_type, sum(value) AS v FROM e GROUP BY 1) SELECT event_type, floor(v / sum(v) OVER () * 1e6 + 0.5) / 1e6 AS share FROM s""")
def token_shares(spark, sf_dir):
    from pyspark.sql import Window

    s = events(spark, sf_dir).groupBy("event_type").agg(F.sum("value").alias("v"))
    return s.select("event_type", money(F.col("v") / F.sum("v").over(Window.partitionBy())).alias("share"))


@query("SELECT event_type AS origin, count(*) AS n, sha256(sum(('0x' || substr(md5(event_id::VARCHAR), 1, 15))::BIGINT)::VARCHAR) AS watermark FROM events GROUP BY 1")
def origin_mix_watermark(spark, sf_dir):
    # A count and a sum of hashes, which no task holds as a list.
    hashed = F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 15), 16, 10).cast("decimal(20,0)")
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("origin")).agg(F.count("*").alias("n"), F.sha2(F.sum(hashed).cast("string"), 256).alias("watermark"))


@query(f"""WITH {EVENTS_SQL} SELECT 'failure-rate' AS metric, count(*) FILTER (WHERE event_type = 'error')::DOUBLE / count(*) AS value, 'ratio' AS unit, count(*) FILTER (WHERE event_type = 'error')::DOUBLE AS numerator, count(*)::DOUBLE AS denominator, NULL::VARCHAR AS reason FROM e
UNION ALL SELECT 'late-usage', NULL, 'tokens', NULL, NULL, 'no observations'""")
def metric_envelopes(spark, sf_dir):
    e = events(spark, sf_dir)
    rates = e.agg(F.count_if(F.col("event_type") == "error").alias("f"), F.count("*").alias("n"))
    late = e.where("event_type = 'never'").agg(F.sum("value").alias("v"))
    first = metrics.envelope(rates, "failure-rate", F.try_divide(F.col("f").cast("double"), F.col("n").cast("double")), "ratio", F.col("f"), F.col("n"))
    return first.unionByName(metrics.envelope(late, "late-usage", F.col("v"), "tokens"))


@query("""WITH c AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) SELECT c_custkey, o_orderkey AS newest, CASE WHEN o_orderkey IS NULL THEN 'unknown' WHEN c_acctbal < 0 THEN 'merged' ELSE 'open' END AS status FROM customer LEFT JOIN c ON c_custkey = o_custkey AND r = 1""")
def branch_status(spark, sf_dir):
    newest = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest"))
    joined = table(spark, sf_dir, "customer").join(newest, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", "newest", F.when(F.col("newest").isNull(), "unknown").when(F.col("c_acctbal") < 0, "merged").otherwise("open").alias("status"))


@query("""WITH w AS (SELECT unnest([1, 5, 999999999, 7]) AS id, unnest([0, 1, 2, 3]) AS pos) SELECT w.id, pos::INT AS pos, event_type, CASE WHEN e.event_id IS NULL THEN 'not-found' END AS reason FROM w LEFT JOIN events e ON e.event_id = w.id""")
def evidence_lookup(spark, sf_dir):
    wanted = spark.range(1).select(F.posexplode(F.array(*[F.lit(i) for i in (1, 5, 999999999, 7)])).alias("pos", "id"))
    found = wanted.join(events(spark, sf_dir).select("event_id", "event_type"), F.col("id") == F.col("event_id"), "left")
    return found.select("id", "pos", "event_type", F.when(F.col("event_id").isNull(), "not-found").alias("reason"))


@query("SELECT event_id, event_type, floor(value * 1e6 + 0.5) / 1e6 AS value FROM events ORDER BY ts, event_id LIMIT 100 OFFSET 200")
def pinned_third_page(spark, sf_dir):
    """The third page of a pinned timeline, reached by cursors."""
    from tidemark.operators.basis import Basis
    from tidemark.session import new_path

    basis = Basis.pin(events(spark, sf_dir).select("event_id", "ts", "event_type", "value"), new_path(spark, "basis"), ["ts", "event_id"])
    cursor = None
    for _ in range(2):
        cursor = basis.cursor_after(basis.page(cursor, 100))
    return basis.page(cursor, 100).select("event_id", "event_type", money(F.col("value")).alias("value"))
