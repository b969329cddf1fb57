"""As-of, nearest, interval, prefix and component joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import asof, graph, pairing
from tidemark.plans.base import events, registry, table

QUERIES, ORACLES, query = registry()


@query("""WITH m AS (SELECT user_id, ts, max(event_id) AS branch FROM events WHERE event_type = 'signup' GROUP BY 1, 2)
SELECT p.event_id, m.branch, epoch_us(m.ts) AS at_us FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN m ON p.user_id = m.user_id AND p.ts >= m.ts""")
def asof_last_move(spark, sf_dir):
    e = events(spark, sf_dir)
    moves = e.where("event_type = 'signup'").withColumn("branch", F.col("event_id"))
    probes = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    out = asof.asof_join(probes, moves, ["user_id"], "ts", "ts", ["branch"], ["event_id"])
    return out.select("event_id", "branch", F.unix_micros("matched_at").alias("at_us"))


@query("""WITH m AS (SELECT user_id, ts, max(event_id) AS b, min(event_id) AS f FROM events WHERE event_type = 'signup' GROUP BY 1, 2), p AS (SELECT * FROM events WHERE event_type = 'error'),
x AS (SELECT p.event_id, p.ts, b.ts AS bt, b.b AS bb, f.ts AS ft, f.b AS fb FROM p ASOF LEFT JOIN m b ON p.user_id = b.user_id AND p.ts >= b.ts ASOF LEFT JOIN m f ON p.user_id = f.user_id AND p.ts <= f.ts),
g AS (SELECT *, epoch_us(ts) - epoch_us(bt) AS gb, epoch_us(ft) - epoch_us(ts) AS gf FROM x)
SELECT event_id, CASE WHEN gb <= 86400000000 AND (gf IS NULL OR gf > 86400000000 OR gb <= gf) THEN bb WHEN gf <= 86400000000 THEN fb END AS branch FROM g""")
def nearest_within_24h(spark, sf_dir):
    e = events(spark, sf_dir)
    moves = e.where("event_type = 'signup'").withColumn("branch", F.col("event_id"))
    probes = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    return asof.nearest_join(probes, moves, ["user_id"], "ts", "ts", ["branch"], 86400, ["event_id"]).select("event_id", "branch")


@query("""WITH v AS (SELECT p_brand, date_trunc('month', o_orderdate) AS eff, max(o_totalprice) AS price FROM orders JOIN part ON o_orderkey = p_partkey GROUP BY 1, 2),
q AS (SELECT o_orderkey, p_brand, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate END AS asked FROM orders JOIN part ON o_custkey = p_partkey),
h AS (SELECT q.*, v.price FROM q ASOF LEFT JOIN v ON q.p_brand = v.p_brand AND q.asked >= v.eff),
b AS (SELECT p_brand, arg_min(price, eff) AS oldest, arg_max(price, eff) AS newest FROM v GROUP BY 1)
SELECT o_orderkey, h.p_brand, CASE WHEN asked IS NULL THEN newest ELSE coalesce(price, oldest) END AS price FROM h LEFT JOIN b ON h.p_brand = b.p_brand""")
def price_version_asof(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    versions = orders.join(part, F.col("o_orderkey") == F.col("p_partkey")).groupBy("p_brand", F.date_trunc("month", "o_orderdate").alias("eff")).agg(F.max("o_totalprice").alias("price"))
    asked = orders.join(part, F.col("o_custkey") == F.col("p_partkey")).select("o_orderkey", "p_brand", F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderdate")).alias("at"))
    return asof.version_at(asked, versions, ["p_brand"], "at", "eff", ["price"]).select("o_orderkey", "p_brand", "price")


PAIRS = """p AS (SELECT a.event_id AS row_id, t.event_id AS turn_id, a.user_id, greatest(epoch_us(t.ts) - epoch_us(a.ts), epoch_us(a.ts) - epoch_us(t.ts) - 600000000, 0) AS gap
FROM events a JOIN events t ON a.user_id = t.user_id AND a.event_type = 'purchase' AND t.event_type = 'click' AND a.ts >= t.ts - INTERVAL 3600 SECOND AND a.ts <= t.ts + INTERVAL 4200 SECOND)"""


def _pairs(spark, sf_dir):
    e = events(spark, sf_dir)
    rows = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("row_id"), "ts")
    turns = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("turn_id"), F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 10 MINUTES")).alias("end"))
    return pairing.candidates(rows, turns, ["user_id"], "ts", "start", "end", 3600)


@query(f"WITH {PAIRS} SELECT row_id, turn_id, gap FROM p")
def interval_pairs_60m(spark, sf_dir):
    return _pairs(spark, sf_dir).select("row_id", "turn_id", "gap")


@query()
def greedy_pairing(spark, sf_dir):
    return pairing.greedy(_pairs(spark, sf_dir), ["user_id"], "row_id", "turn_id")


@query(f"WITH {PAIRS}, r AS (SELECT row_id, gap, row_number() OVER w AS n, lead(gap) OVER w AS nx FROM p WINDOW w AS (PARTITION BY row_id ORDER BY gap, turn_id)) SELECT row_id, coalesce(gap = nx, false) AS ambiguous FROM r WHERE n = 1")
def pairing_ambiguity(spark, sf_dir):
    return pairing.ambiguous(_pairs(spark, sf_dir), "row_id", "turn_id")


@query(f"WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY gap, turn_id DESC) AS n FROM p) SELECT row_id, turn_id FROM r WHERE n = 1")
def hook_turn_nearest(spark, sf_dir):
    return asof.nearest_by_gap(_pairs(spark, sf_dir), ["row_id"], F.col("gap"), [F.desc("turn_id")]).select("row_id", "turn_id")


@query("""WITH paths AS (SELECT page_id, string_split(rtrim('/' || replace(split_part(split_part(url, '://', 2), '?', 1), '.', '/'), '/'), '/') AS parts FROM pages),
roots AS (SELECT DISTINCT rtrim(array_to_string(parts[1:n], '/'), '/') AS root FROM paths, (VALUES (3), (4)) AS t(n)),
heads AS (SELECT page_id, array_to_string(parts[1:n], '/') AS root FROM (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS n FROM paths))
SELECT page_id, arg_max(r.root, length(r.root)) AS root FROM heads LEFT JOIN roots r USING (root) GROUP BY page_id""")
def longest_prefix_root(spark, sf_dir):
    # Roots have no slashes at their ends, so that no two are one.
    paths, head = _paths(spark, sf_dir)
    roots = paths.select(head(3)).union(paths.select(head(4))).select(F.regexp_replace("root", "/+$", "").alias("root")).distinct()
    return asof.longest_prefix(paths, roots, "path", "root").select("page_id", F.col("matched_root").alias("root"))


def _paths(spark, sf_dir):
    path = F.concat(F.lit("/"), F.replace(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("?"), F.lit(1)), F.lit("."), F.lit("/")))
    paths = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return paths, lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/").alias("root")


@query()
def request_components(spark, sf_dir):
    from tidemark.operators.facts import group_reports

    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"))
    lines = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("order_id"), "left_semi")
    reports = lines.select(F.col("l_orderkey").alias("order_id"), F.array(F.concat(F.lit("p"), (F.col("l_partkey") % 5000).cast("string"))).alias("keys"))
    return group_reports(reports, "order_id", "keys")


@query("""WITH RECURSIVE p AS (SELECT c_custkey AS c, CASE WHEN c_custkey % 10 <> 0 THEN c_custkey // 2 END AS p FROM customer WHERE c_custkey > 0), q AS (SELECT * FROM p WHERE p > 0),
r AS (SELECT c AS node, p AS ancestor, 1 AS level FROM q UNION ALL SELECT r.node, q.p, level + 1 FROM r JOIN q ON r.ancestor = q.c)
SELECT node, ancestor, level FROM r""")
def parent_lineage(spark, sf_dir):
    c = F.col("c_custkey")
    parents = table(spark, sf_dir, "customer").where(c > 0).select(c.alias("child"), F.when(c % 10 != 0, F.floor(c / 2)).alias("parent")).where("parent > 0")
    return graph.lineage(parents)


@query("""WITH ev AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 <> 0 THEN k END AS req, CASE WHEN event_id % 4 <> 0 THEN user_id % 40 END AS session FROM (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)),
o AS (SELECT req, min(session) AS s FROM ev WHERE session IS NOT NULL GROUP BY 1 HAVING min(session) = max(session)) SELECT event_id, coalesce(session, o.s) AS session FROM ev LEFT JOIN o ON ev.req = o.req""")
def sessionless_bridge(spark, sf_dir):
    from tidemark.operators.facts import bridge_sessionless

    e = events(spark, sf_dir)
    ev = e.select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("k")).alias("req"), F.when(F.col("event_id") % 4 != 0, F.col("user_id") % 40).alias("session"))
    return bridge_sessionless(ev, "req", "session").select("event_id", "session")


@query("""WITH w AS (SELECT user_id, min(ts) AS s, max(ts) AS t FROM events WHERE event_type = 'signup' GROUP BY user_id, CAST(ts AS DATE)),
c AS (SELECT e.event_id, count(w.s) AS n, min(epoch_us(w.s)) AS s FROM events e LEFT JOIN w ON e.user_id = w.user_id AND e.ts >= w.s AND e.ts <= w.t WHERE e.event_type = 'view' GROUP BY 1)
SELECT event_id, CASE WHEN n = 1 THEN s END AS window_us, CASE WHEN n = 0 THEN 'none' WHEN n = 1 THEN 'explicit' ELSE 'ambiguous' END AS how FROM c""")
def feature_windows(spark, sf_dir):
    e = events(spark, sf_dir)
    windows = e.where("event_type = 'signup'").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("ts").alias("s"), F.max("ts").alias("t")).drop("day")
    views = e.where("event_type = 'view'").select("event_id", "user_id", "ts")
    hits = asof.interval_pairs(views, windows, ["user_id"], "ts", "s", "t").groupBy("event_id").agg(F.count("*").alias("n"), F.min(F.unix_micros("s")).alias("w"))
    joined = views.join(hits, "event_id", "left")
    return joined.select("event_id", F.when(F.col("n") == 1, F.col("w")).alias("window_us"), F.when(F.col("n").isNull(), "none").when(F.col("n") == 1, "explicit").otherwise("ambiguous").alias("how"))


@query("""WITH l AS (SELECT user_id, event_type AS branch, ts, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
SELECT event_id, branch, sum(CASE WHEN b IS NULL OR b <> branch THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS flight FROM l""")
def implicit_features(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    changed = F.when(F.col("event_type").eqNullSafe(F.lag("event_type").over(w)), 0).otherwise(1)
    e = events(spark, sf_dir).withColumn("new", changed)
    return e.select("event_id", F.col("event_type").alias("branch"), F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("flight"))
