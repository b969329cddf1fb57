"""Requests rebuilt from log rows and merged into facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import tokens
from tidemark.operators import facts
from tidemark.plans.base import EVENTS_SQL, events, money, registry, table

QUERIES, ORACLES, query = registry()


def _lines(spark, sf_dir):
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_partkey").alias("part"), F.col("l_extendedprice").alias("price"), n.alias("line"), (n % 3).alias("rank"), F.concat(F.lit("ch"), n % 3).alias("channel"),
        F.when(F.col("l_tax") > 0.01, F.col("l_linestatus")).alias("model"),
        F.when(F.col("l_discount") > 0.03, F.col("l_returnflag")).alias("effort"),
        F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("input"), F.when(F.col("l_quantity") > 20, F.col("l_extendedprice")).alias("output"),
    )


LINES_SQL = """l AS (SELECT l_orderkey, l_partkey AS part, l_extendedprice AS price, l_linenumber AS line, l_linenumber % 3 AS rank, 'ch' || (l_linenumber % 3) AS channel,
CASE WHEN l_tax > 0.01 THEN l_linestatus END AS model, CASE WHEN l_discount > 0.03 THEN l_returnflag END AS effort,
CASE WHEN l_quantity > 10 THEN l_quantity END AS input, CASE WHEN l_quantity > 20 THEN l_extendedprice END AS output FROM lineitem)"""
ORDER = ["rank", "line", "part", "price"]


@query(f"""WITH {LINES_SQL} SELECT l_orderkey, count(*) AS members, arg_min(model, (rank, line, part, price)) FILTER (WHERE model IS NOT NULL) AS model, arg_min(effort, (rank, line, part, price)) FILTER (WHERE effort IS NOT NULL) AS effort,
arg_min(coalesce(input, -1), (rank, line, part, price)) FILTER (WHERE input IS NOT NULL OR output IS NOT NULL) AS input, arg_min(coalesce(output, -1), (rank, line, part, price)) FILTER (WHERE input IS NOT NULL OR output IS NOT NULL) AS output FROM l GROUP BY 1""")
def reconcile_first_non_null(spark, sf_dir):
    out = facts.reconcile(_lines(spark, sf_dir), ["l_orderkey"], ["model", "effort"], [F.col(c) for c in ORDER], whole=[["input", "output"]])
    known = F.coalesce("input", "output").isNotNull()
    return out.select("l_orderkey", "members", "model", "effort", *[F.when(known, F.coalesce(c, F.lit(-1.0))).alias(c) for c in ("input", "output")])


@query(f"""WITH {LINES_SQL}, u AS (SELECT l_orderkey, channel, rank, line, part, price, 'model' AS field, model AS value FROM l UNION ALL SELECT l_orderkey, channel, rank, line, part, price, 'effort', effort FROM l),
c AS (SELECT l_orderkey, field, channel, arg_min(value, (rank, line, part, price)) AS value FROM u WHERE value IS NOT NULL GROUP BY 1, 2, 3)
SELECT l_orderkey, field, string_agg(DISTINCT value, '|' ORDER BY value) AS values, count(*) AS channels FROM c GROUP BY 1, 2 HAVING count(DISTINCT value) > 1""")
def disagreements(spark, sf_dir):
    out = facts.disagreements(_lines(spark, sf_dir), ["l_orderkey"], "channel", ["model", "effort"], [F.col(c) for c in ORDER])
    return out.withColumn("values", F.array_join("values", "|"))


@query(f"WITH {LINES_SQL} SELECT l_orderkey, 'effort' AS field, count(effort) AS candidates, arg_min(effort, (rank, line, part, price)) FILTER (WHERE effort IS NOT NULL) AS winner FROM l GROUP BY 1")
def field_explanations(spark, sf_dir):
    out = facts.explain_fields(_lines(spark, sf_dir), ["l_orderkey"], "channel", ["effort"], [F.col(c) for c in ORDER])
    return out.select("l_orderkey", "field", F.size("candidates").cast("long").alias("candidates"), "winner")


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, CASE WHEN l_tax > 0 THEN 0 ELSE 1 END, l_orderkey DESC, l_linenumber DESC) AS r FROM lineitem) WHERE r = 1")
def best_row_per_request(spark, sf_dir):
    order = [F.desc("l_quantity"), F.when(F.col("l_tax") > 0, 0).otherwise(1), F.desc("l_orderkey"), F.desc("l_linenumber")]
    return facts.best_row(table(spark, sf_dir, "lineitem"), ["l_partkey"], order).select("l_orderkey", "l_partkey", "l_linenumber")


@query(f"WITH {EVENTS_SQL} SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS turn FROM e")
def turn_carry_forward(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("turn", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return facts.carry_forward(e, ["user_id"], ["ts", "event_id"], "turn").select("event_id", "turn")


@query(f"""WITH {EVENTS_SQL}, x AS (SELECT *, event_type = 'purchase' AND value > 450 AS exact FROM e),
w AS (SELECT event_id, exact, k, lag(k) OVER o AS b, row_number() OVER (PARTITION BY user_id, k, event_type ORDER BY ts, event_id) AS n, coalesce(max(exact::INT) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM x WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id FROM w WHERE k IS DISTINCT FROM b AND n = 1 AND seen = 0 AND NOT exact""")
def counter_fallback(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("exact", (F.col("event_type") == "purchase") & (F.col("value") > 450)).withColumn("signature", F.struct("k", "event_type"))
    return facts.counter_requests(e, ["user_id"], ["ts", "event_id"], "k", "signature", "exact").select("event_id")


@query("""WITH s AS (SELECT o_orderkey, o_totalprice FROM orders), r AS (SELECT l_orderkey, sum(l_extendedprice) AS x FROM lineitem GROUP BY 1)
SELECT o_orderkey, floor(greatest(o_totalprice - coalesce(x, 0), 0) * 1e6 + 0.5) / 1e6 AS overhead, coalesce(x, 0) > o_totalprice AS over_count FROM s LEFT JOIN r ON o_orderkey = l_orderkey""")
def session_remainder(spark, sf_dir):
    sessions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice")
    requests = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_extendedprice")
    out = facts.session_remainder(sessions, requests, "k", "o_totalprice", "l_extendedprice")
    return out.select(F.col("k").alias("o_orderkey"), money(F.col("overhead")).alias("overhead"), "over_count")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, (l_quantity * 7)::BIGINT AS t FROM lineitem), f AS (SELECT *, floor(t * 0.5)::BIGINT AS a, floor(t * 0.3)::BIGINT AS b, floor(t * 0.2)::BIGINT AS c FROM x)
SELECT l_orderkey, l_linenumber, a + t - (a + b + c) AS p0, b AS p1, c AS p2 FROM f""")
def integer_split(spark, sf_dir):
    shares = F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2))
    pieces = tokens.split_integer((F.col("l_quantity") * 7).cast("long"), shares)
    out = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", pieces.alias("p"))
    return out.select("l_orderkey", "l_linenumber", *[F.get("p", F.lit(i)).alias(f"p{i}") for i in range(3)])


@query(f"""WITH {EVENTS_SQL} SELECT event_id, coalesce(CASE WHEN k % 5 <> 0 THEN k END, first_value(CASE WHEN k % 5 <> 0 THEN k END IGNORE NULLS) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS model FROM e""")
def model_backfill(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("day", F.to_date("ts")).withColumn("model", F.when(F.col("k") % 5 != 0, F.col("k")))
    return facts.backfill(e, ["user_id", "day"], ["ts", "event_id"], "model").select("event_id", "model")


@query("""WITH s AS (SELECT l_orderkey, l_suppkey % 3 AS reading, sum(l_extendedprice) AS x FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, arg_max(reading, (floor(x * 1e6 + 0.5) / 1e6, reading)) AS reading, floor(max(x) * 1e6 + 0.5) / 1e6 AS amount FROM s GROUP BY 1""")
def max_cumulative_figure(spark, sf_dir):
    readings = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 3).alias("reading"), F.col("l_extendedprice").alias("amount"))
    out = facts.largest_figure(readings, ["l_orderkey"], "reading", "amount")
    return out.withColumn("amount", money(F.col("amount")))


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS amount, l_extendedprice * 0.25 AS a, CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice * 0.75 ELSE l_extendedprice * 0.7 END AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, model, floor(x * 1e6 + 0.5) / 1e6 AS amount FROM (SELECT l_orderkey, l_linenumber, 'm1' AS model, a AS x FROM f WHERE l_linenumber % 2 = 0 UNION ALL SELECT l_orderkey, l_linenumber, 'm2', b FROM f WHERE l_linenumber % 2 = 0
UNION ALL SELECT l_orderkey, l_linenumber, NULL, amount FROM f WHERE l_linenumber % 2 <> 0)""")
def figure_split_by_model(spark, sf_dir):
    price = F.col("l_extendedprice")
    share = F.when(F.col("l_linenumber") % 2 == 0, price * 0.75).otherwise(price * 0.7)
    figures = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", price.alias("amount"), F.create_map(F.lit("m1"), price * 0.25, F.lit("m2"), share).alias("costs"))
    out = facts.split_figure(figures, "amount", "costs")
    return out.select("l_orderkey", "l_linenumber", "model", money(F.col("amount")).alias("amount"))


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def last_wins_dedupe(spark, sf_dir):
    return facts.one_per_key(events(spark, sf_dir), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("event_id", "user_id")


@query(f"""WITH {EVENTS_SQL}, r AS (SELECT event_id, user_id AS session, event_type AS channel, CASE WHEN event_id % 5 <> 0 THEN k END AS key FROM e),
s AS (SELECT session, min(channel) AS a, max(channel) AS b FROM r WHERE key IS NOT NULL GROUP BY 1) SELECT event_id FROM r JOIN s USING (session) WHERE key IS NULL AND (a <> channel OR b <> channel)""")
def unresolved_reports(spark, sf_dir):
    e = events(spark, sf_dir)
    reports = e.select("event_id", F.col("user_id").alias("session"), F.col("event_type").alias("channel"), F.when(F.col("event_id") % 5 != 0, F.col("k")).alias("key"))
    return facts.overlaps_keyed(reports, "session", "channel", "key").select("event_id")


@query("SELECT o_custkey, 'uf_' || substr(sha256(string_agg(DISTINCT o_orderkey::VARCHAR, chr(10) ORDER BY o_orderkey::VARCHAR)), 1, 24) AS fact_id FROM orders GROUP BY 1")
def fact_ids(spark, sf_dir):
    ids = F.collect_list(F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(tokens.digest_id(ids).alias("fact_id"))


@query(f"""WITH {EVENTS_SQL}, x AS (SELECT event_id, 'q' || k || '-' || (user_id % 20) AS key, CASE WHEN event_id % 19 = 0 THEN 'q' || ((k + 1) % 100) || '-' || (user_id % 20) END AS rep, event_type AS src, user_id::VARCHAR AS gen, epoch_us(ts) AS ob FROM e),
l AS (SELECT * FROM x WHERE key NOT IN (SELECT rep FROM x WHERE rep IS NOT NULL)), m AS (SELECT *, max(ob) OVER (PARTITION BY key, src) AS n, last_value(gen) OVER (PARTITION BY key, src ORDER BY ob ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS g FROM l) SELECT event_id FROM m WHERE ob = n OR gen = g""")
def superseded_requests(spark, sf_dir):
    e = events(spark, sf_dir)
    slot = (F.col("user_id") % 20).cast("string")
    key = lambda k: F.concat(F.lit("q"), k.cast("string"), F.lit("-"), slot)
    x = e.select("event_id", key(F.col("k")).alias("key"), F.when(F.col("event_id") % 19 == 0, key((F.col("k") + 1) % 100)).alias("rep"), F.col("event_type").alias("src"), F.col("user_id").cast("string").alias("gen"), F.unix_micros("ts").alias("ob"))
    return facts.without_replaced(x, "key", "rep", "src", "gen", "ob").select("event_id")
