"""Ledgers, readings, selections and session folds, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import folds, ledgers, pricing, selection
from tidemark.plans.base import EVENTS_SQL, events, registry, table

QUERIES, ORACLES, query = registry()


def _text(prefix: str, x):
    return F.concat(F.lit(prefix), x.cast("string"))


@query(f"""WITH {EVENTS_SQL}, l AS (SELECT DISTINCT user_id FROM e WHERE event_type = 'signup' AND k % 20 = 0)
SELECT event_id, CASE WHEN user_id NOT IN (SELECT user_id FROM l) THEN amount END AS amount FROM e""")
def ledgered_figures(spark, sf_dir):
    e = events(spark, sf_dir)
    return ledgers.without_ledgered_figures(e, e.where("event_type = 'signup' and k % 20 = 0").select("user_id"), "user_id", "amount").select("event_id", "amount")


@query(f"""WITH {EVENTS_SQL}, p AS (SELECT * FROM (VALUES ('click', 1), ('view', 2), ('error', 3)) t(event_type, rank)) SELECT event_id, CAST(coalesce(rank, 10000) AS INT) AS rank FROM e LEFT JOIN p USING (event_type)""")
def channel_rank(spark, sf_dir):
    precedence = spark.createDataFrame([("click", 1), ("view", 2), ("error", 3)], "event_type string, rank int")
    return ledgers.ranked(events(spark, sf_dir), precedence, ["event_type"]).select("event_id", "rank")


@query(f"""WITH {EVENTS_SQL} SELECT tool AS account, sum(k)::BIGINT AS observed, sum(CASE WHEN k % 3 = 0 THEN k ELSE 0 END)::BIGINT AS allocated, sum(CASE WHEN k % 3 <> 0 THEN k ELSE 0 END)::BIGINT AS remainder, sum((k % 3 <> 0)::INT)::BIGINT AS open_rows FROM e GROUP BY 1""")
def account_remainder(spark, sf_dir):
    e = events(spark, sf_dir).withColumnRenamed("tool", "account")
    taken = e.where("k % 3 = 0").select("event_id")
    return ledgers.account_remainder(e, taken.union(taken.where("event_id % 2 = 0")), "account", "event_id", "k")


LEDGER = f"""{EVENTS_SQL}, r AS (SELECT *, CASE WHEN event_id % 5 <> 0 THEN user_id * 100 + k END AS grp, event_id % 4 AS rank, CASE WHEN event_id % 9 <> 0 THEN 'b' || (event_id % 6) END AS branch FROM e)"""


def _rows(spark, sf_dir):
    return events(spark, sf_dir).select("*", F.when(F.col("event_id") % 5 != 0, F.col("user_id") * 100 + F.col("k")).alias("grp"), (F.col("event_id") % 4).alias("rank"), F.when(F.col("event_id") % 9 != 0, _text("b", F.col("event_id") % 6)).alias("branch"))


@query(f"""WITH {LEDGER}, b AS (SELECT *, row_number() OVER (PARTITION BY grp, tool ORDER BY rank, event_id) AS n, count(*) OVER (PARTITION BY grp, tool) - 1 AS c FROM r WHERE grp IS NOT NULL)
SELECT tool, sum(k)::BIGINT AS k, count(*) AS groups, sum(c)::BIGINT AS collapsed FROM b WHERE n = 1 GROUP BY 1""")
def usage_ledger(spark, sf_dir):
    return ledgers.usage_ledger(_rows(spark, sf_dir), "grp", ["tool"], [F.col("rank"), F.col("event_id")], "k")


@query(f"WITH {LEDGER} SELECT tool, sum(k)::BIGINT AS k, count(*) AS rows FROM r WHERE grp IS NULL GROUP BY 1")
def unresolved_usage(spark, sf_dir):
    return ledgers.unresolved(_rows(spark, sf_dir), "grp", ["tool"], "k")


BRANCHES = f"""{LEDGER}, bs AS (SELECT grp, min(rank) AS best FROM r WHERE grp IS NOT NULL GROUP BY 1),
gb AS (SELECT r.grp, min(branch) AS lo, max(branch) AS hi, min(CASE WHEN rank = best THEN branch END) AS slo, max(CASE WHEN rank = best THEN branch END) AS shi FROM r JOIN bs ON r.grp = bs.grp GROUP BY 1),
a AS (SELECT grp, CASE WHEN lo = hi THEN lo WHEN slo = shi THEN slo END AS branch FROM gb)"""


@query(f"WITH {BRANCHES} SELECT grp, branch FROM a")
def branch_of_group(spark, sf_dir):
    return ledgers.branch_of_group(_rows(spark, sf_dir).where("grp is not null"), "grp", "branch", "rank")


@query(f"""WITH {BRANCHES} SELECT coalesce(CASE WHEN r.grp IS NOT NULL THEN a.branch ELSE r.branch END, '(no branch)') AS branch, sum(k)::BIGINT AS k, count(*) AS rows FROM r LEFT JOIN a ON r.grp = a.grp GROUP BY 1""")
def usage_by_branch(spark, sf_dir):
    r = _rows(spark, sf_dir)
    return ledgers.by_branch(r, ledgers.branch_of_group(r.where("grp is not null"), "grp", "branch", "rank"), "grp", "branch", "k")


@query(f"""WITH {EVENTS_SQL}, r AS (SELECT *, user_id % 5 AS rank, 's' || (user_id % 5) AS kind FROM e WHERE k > 0), f AS (SELECT *, row_number() OVER (PARTITION BY k, tool ORDER BY rank, event_id) AS n, count(*) OVER (PARTITION BY k, tool) - 1 AS collapsed FROM r),
b AS (SELECT tool, min(rank) AS rank FROM f WHERE n = 1 GROUP BY 1) SELECT event_id, f.tool, kind, collapsed FROM f JOIN b ON f.tool IS NOT DISTINCT FROM b.tool AND f.rank = b.rank WHERE n = 1""")
def preferred_readings(spark, sf_dir):
    r = events(spark, sf_dir).where("k > 0").select("*", (F.col("user_id") % 5).alias("rank"), _text("s", F.col("user_id") % 5).alias("kind"))
    return ledgers.preferred_readings(r, ["k", "tool"], "tool", "kind", [F.col("event_id")]).select("event_id", "tool", "kind", "collapsed")


@query(f"""WITH {EVENTS_SQL}, r AS (SELECT user_id AS session, event_id // 3 AS component, k % 4 AS rank FROM e WHERE user_id % 4 <> 0), b AS (SELECT session, row_number() OVER (PARTITION BY component ORDER BY rank, session) AS n FROM r),
d AS (SELECT session, count(*) AS calls FROM b WHERE n = 1 GROUP BY 1), s AS (SELECT user_id AS session, max(k)::BIGINT AS calls FROM e GROUP BY 1) SELECT session, calls, 'detail' AS source FROM d UNION ALL SELECT session, calls, 'session' FROM s WHERE session NOT IN (SELECT session FROM d)""")
def distinct_tool_calls(spark, sf_dir):
    e = events(spark, sf_dir).withColumnRenamed("user_id", "session")
    reports = e.where("session % 4 <> 0").select("session", F.floor(F.col("event_id") / 3).alias("component"), (F.col("k") % 4).alias("rank"))
    return ledgers.tool_calls(reports, e.select("session", F.col("k").cast("long").alias("calls")), "component", "session", "rank", "calls")


@query(f"WITH {EVENTS_SQL} SELECT user_id, count(*) AS requests, sum(k)::BIGINT AS k FROM e WHERE tool = 'click' GROUP BY 1")
def session_usage(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("scope", F.when(F.col("tool") == "click", "request").otherwise("session"))
    return ledgers.session_usage(e, "user_id", "scope", ["k"])


@query(f"""WITH {EVENTS_SQL} SELECT 'tokens.' || tool AS name, sum(k)::DOUBLE AS value FROM e WHERE tool IS NOT NULL GROUP BY 1 UNION ALL SELECT 'requests', count(DISTINCT user_id * 100 + k)::DOUBLE FROM e
UNION ALL SELECT 'ledger.billed', sum(CASE WHEN k % 2 = 0 THEN k END)::DOUBLE FROM e UNION ALL SELECT 'ledger.own', sum(CASE WHEN k % 3 = 0 THEN k END)::DOUBLE FROM e""")
def usage_results(spark, sf_dir):
    e = events(spark, sf_dir).select("*", (F.col("user_id") * 100 + F.col("k")).alias("request"), F.when(F.col("k") % 2 == 0, F.col("k")).alias("billed"), F.when(F.col("k") % 3 == 0, F.col("k")).alias("own"))
    return ledgers.usage_results(e, "tool", "k", {"billed": "billed", "own": "own"})


PRICES = """p AS (SELECT * FROM (VALUES ('click', 0.01, 0.25), ('view', 0.02, NULL), ('error', NULL, 0.5)) t(tool, search_price, premium_price))"""


def _prices(spark):
    return spark.createDataFrame([("click", 0.01, 0.25), ("view", 0.02, None), ("error", None, 0.5)], "tool string, search_price double, premium_price double")


@query(f"""WITH {EVENTS_SQL}, {PRICES}, u AS (SELECT event_id, e.tool, CASE WHEN k % 3 <> 0 THEN k % 4 END AS searches, k % 2 AS premiums FROM e),
c AS (SELECT event_id, coalesce(searches, 0) > 0 AND search_price IS NULL OR premiums > 0 AND premium_price IS NULL AS unpriced, CASE WHEN searches > 0 THEN searches * search_price::DOUBLE END AS a, CASE WHEN premiums > 0 THEN premiums * premium_price::DOUBLE END AS b FROM u LEFT JOIN p USING (tool))
SELECT event_id, coalesce(a, 0) + coalesce(b, 0) AS charges, NOT unpriced AS complete FROM c""")
def flat_charges(spark, sf_dir):
    u = events(spark, sf_dir).select("event_id", "tool", F.when(F.col("k") % 3 != 0, F.col("k") % 4).alias("searches"), (F.col("k") % 2).alias("premiums"))
    usd, complete = pricing.unit_charges([(F.col("searches"), F.col("search_price")), (F.col("premiums"), F.col("premium_price"))])
    return u.join(_prices(spark), "tool", "left").select("event_id", usd.alias("charges"), complete.alias("complete"))


@query("""WITH p AS (SELECT p_brand AS model, max(p_retailprice) AS price FROM part GROUP BY 1), s AS (SELECT DISTINCT p_brand || '-v' || (p_size % 3) AS model FROM part UNION SELECT p_brand FROM part WHERE p_size = 1),
m AS (SELECT s.model, regexp_replace(s.model, '-v[0-9]+$', '') AS base FROM s WHERE s.model NOT IN (SELECT model FROM p)) SELECT model, price FROM p UNION ALL SELECT m.model, p.price FROM m JOIN p ON p.model = m.base""")
def observed_prices(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    prices = part.groupBy(F.col("p_brand").alias("model")).agg(F.max("p_retailprice").alias("price"))
    seen = part.select(F.concat("p_brand", F.lit("-v"), (F.col("p_size") % 3).cast("string")).alias("model")).union(part.where("p_size = 1").select("p_brand"))
    keyed = seen.select("model", F.array(F.regexp_replace("model", "-v[0-9]+$", "")).alias("keys"))
    return pricing.expand_prices(prices, keyed, "model", "keys")


@query(f"""WITH {EVENTS_SQL}, v AS (SELECT event_id, CASE WHEN k % 5 <> 0 THEN ts END AS o, ts + INTERVAL 1 HOUR AS s, tool FROM e) SELECT event_id FROM v WHERE tool = 'click' AND coalesce(o, s) >= TIMESTAMP '2024-01-05' AND coalesce(o, s) <= TIMESTAMP '2024-01-20'""")
def snapshot_selector(spark, sf_dir):
    v = events(spark, sf_dir).select("event_id", F.when(F.col("k") % 5 != 0, F.col("ts")).alias("occurred_at"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("observed_at"), "tool")
    stamp = lambda x: F.to_timestamp(F.lit(x))
    return selection.snapshot(v, {"tool": "click"}, stamp("2024-01-05"), stamp("2024-01-20")).select("event_id")


KEYS = f"""{EVENTS_SQL}, v AS (SELECT event_id, CASE WHEN k % 13 = 0 THEN 'provider-bucket' END AS scope, CASE k % 3 WHEN 0 THEN 'q' || k WHEN 1 THEN ' ' END AS request, CASE WHEN k % 7 = 0 THEN 'g' END AS generation, CASE WHEN k % 11 = 0 THEN 'u' END AS ukey,
CASE k % 4 WHEN 0 THEN 'usage-api' WHEN 1 THEN 'log' WHEN 2 THEN 'usage-api' END AS channel, CASE WHEN user_id % 2 = 0 THEN 's' || user_id ELSE '' END AS session, CASE WHEN k % 17 = 0 THEN 'p' END AS split, 'ai.' || tool AS kind, amount FROM e),
f AS (SELECT *, coalesce(scope = 'provider-bucket', false) OR (nullif(trim(coalesce(request, '')), '') IS NULL AND generation IS NULL AND ukey IS NULL AND (channel IS NULL OR (channel = 'usage-api' AND session = ''))) AS bucket FROM v)"""


def _keys(spark, sf_dir):
    k = F.col("k")
    return events(spark, sf_dir).select(
        "event_id", F.when(k % 13 == 0, "provider-bucket").alias("scope"), F.when(k % 3 == 0, _text("q", k)).when(k % 3 == 1, " ").alias("request"), F.when(k % 7 == 0, "g").alias("generation"), F.when(k % 11 == 0, "u").alias("ukey"),
        F.when(k % 4 == 0, "usage-api").when(k % 4 == 1, "log").when(k % 4 == 2, "usage-api").alias("channel"), F.when(F.col("user_id") % 2 == 0, _text("s", F.col("user_id"))).otherwise("").alias("session"), F.when(k % 17 == 0, "p").alias("split"), _text("ai.", F.col("tool")).alias("kind"), "amount",
    )


@query(f"""WITH {KEYS} SELECT event_id, bucket, coalesce(channel = 'usage-api', false) AND session <> '' AND nullif(trim(coalesce(request, '')), '') IS NULL AND generation IS NULL AND NOT bucket AND split IS NULL AS unkeyed, coalesce(kind <> 'ai.session', false) AND kind IS NOT NULL AND amount IS NOT NULL AS bearing FROM f""")
def account_rows(spark, sf_dir):
    c = [F.col(x) for x in ("scope", "request", "generation", "ukey", "channel", "session")]
    return _keys(spark, sf_dir).select("event_id", selection.account_bucket(*c).alias("bucket"), selection.unkeyed_account_row(*c, F.col("split")).alias("unkeyed"), selection.usage_bearing(F.col("kind"), F.col("amount")).alias("bearing"))


@query(f"""WITH {EVENTS_SQL} SELECT event_id FROM e WHERE (tool IS NULL OR tool = 'view') AND strftime(ts, '%Y-%m-%d') >= '2024-01-12'""")
def chat_scope(spark, sf_dir):
    return events(spark, sf_dir).where(selection.chat_scope(F.col("tool"), F.date_format("ts", "yyyy-MM-dd"), "view", "2024-01-12")).select("event_id")


@query(f"""WITH {EVENTS_SQL} SELECT event_id FROM e WHERE tool IN ('click', 'error') AND user_id IN (1, 2, 3, 5, 8, 13, 21)""")
def basis_scope(spark, sf_dir):
    return selection.in_basis(events(spark, sf_dir), {"tool": ["click", "error"], "user_id": [1, 2, 3, 5, 8, 13, 21], "k": None}).select("event_id")


@query(f"""WITH {EVENTS_SQL} SELECT user_id, max(event_id) AS event_id FROM e WHERE (k % 3 = 0 OR k % 5 IN (1, 2)) GROUP BY 1""")
def latest_coverage(spark, sf_dir):
    scope = F.when(F.col("k") % 3 != 0, F.array(_text("r", F.col("k") % 5), _text("r", (F.col("k") + 4) % 5)))
    return selection.latest_coverage(events(spark, sf_dir).withColumn("repo", scope), {"repo": "r1"}, "user_id", "event_id").select("user_id", "event_id")


@query("""WITH a AS (SELECT o_orderkey AS ref, o_orderstatus AS s, o_custkey AS c FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_orderkey AS ref, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS s, o_custkey AS c FROM orders WHERE o_orderkey % 11 <> 0)
SELECT coalesce(a.ref, b.ref) AS ref, CASE WHEN a.ref IS NULL THEN 'added' WHEN b.ref IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.ref = b.ref WHERE a.ref IS NULL OR b.ref IS NULL OR a.s <> b.s""")
def changed_inputs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ref"), F.col("o_orderstatus").alias("s"), F.col("o_custkey").alias("c"))
    before = o.where("ref % 7 <> 0").select("ref", selection.content_digest("s", "c").alias("digest"))
    after = o.where("ref % 11 <> 0").withColumn("s", F.when(F.col("ref") % 5 == 0, "X").otherwise(F.col("s"))).select("ref", selection.content_digest("c", "s").alias("digest"))
    return selection.compare_bases(before, after, "ref", "digest")


@query(f"""WITH {EVENTS_SQL}, v AS (SELECT event_id, CASE WHEN k % 2 = 0 THEN 'r' || (k % 6) END AS repo, CASE WHEN k % 3 = 0 THEN 'w' || (k % 9) END AS worktree, tool FROM e)
SELECT event_id, CASE WHEN repo IS NOT NULL THEN 100 ELSE 0 END + CASE WHEN worktree IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN tool IS NOT NULL THEN 1 ELSE 0 END AS score FROM v WHERE (repo IS NULL OR repo = 'r0') AND (worktree IS NULL OR worktree = 'w3') AND (tool IS NULL OR tool = 'view')""")
def applicable_records(spark, sf_dir):
    v = events(spark, sf_dir).select("event_id", F.when(F.col("k") % 2 == 0, _text("r", F.col("k") % 6)).alias("repo"), F.when(F.col("k") % 3 == 0, _text("w", F.col("k") % 9)).alias("worktree"), "tool")
    return selection.applicability(v, "r0", "w3", {"tool": "view"}).select("event_id", "score")


@query(f"""WITH {EVENTS_SQL} SELECT event_id, lower(coalesce(CASE WHEN k % 5 = 0 THEN 'HIGH' END, CASE WHEN k % 3 = 0 THEN 'Low' END, CASE WHEN k % 2 = 0 THEN 'medium' END)) AS effort FROM e""")
def recorded_effort(spark, sf_dir):
    k = F.col("k")
    return events(spark, sf_dir).select("event_id", selection.recorded_effort(F.when(k % 5 == 0, "HIGH").otherwise(" "), F.when(k % 3 == 0, "Low"), F.when(k % 2 == 0, "medium")).alias("effort"))


@query(f"""WITH {EVENTS_SQL}, v AS (SELECT user_id, event_id, k, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 END AS r FROM e WHERE user_id % 9 <> 0 OR event_type <> 'purchase')
SELECT user_id, arg_min('t' || k, (r, -event_id)) AS title FROM v WHERE r IS NOT NULL AND k % 4 <> 0 GROUP BY 1""")
def session_titles(spark, sf_dir):
    kind = F.when(F.col("event_type") == "purchase", "custom").when(F.col("event_type") == "click", "ai").when(F.col("event_type") == "view", "agent").otherwise("tool")
    v = events(spark, sf_dir).where("user_id % 9 <> 0 or event_type <> 'purchase'").select("user_id", "event_id", kind.alias("source"), F.when(F.col("k") % 4 != 0, _text("t", F.col("k"))).otherwise(" ").alias("title"))
    return folds.best_title(v, "user_id", "source", "title", "event_id")


@query(f"""WITH RECURSIVE {EVENTS_SQL}, en AS (SELECT user_id AS file, k AS entry, event_id AS seq FROM e WHERE user_id > 0), pr AS (SELECT DISTINCT file, file // 2 AS parent FROM en WHERE file % 3 <> 0 AND file // 2 > 0),
an AS (SELECT file, parent FROM pr UNION SELECT an.file, pr.parent FROM an JOIN pr ON an.parent = pr.file), cp AS (SELECT DISTINCT an.file, en.entry FROM an JOIN en ON en.file = an.parent)
SELECT en.file, en.entry, seq, CASE WHEN cp.file IS NOT NULL THEN 'copied' WHEN row_number() OVER (PARTITION BY en.file, en.entry ORDER BY seq) > 1 THEN 'duplicate' ELSE 'own' END AS ownership FROM en LEFT JOIN cp ON cp.file = en.file AND cp.entry = en.entry""")
def entry_owners(spark, sf_dir):
    en = events(spark, sf_dir).where("user_id > 0").select(F.col("user_id").alias("file"), F.col("k").alias("entry"), F.col("event_id").alias("seq"))
    parents = en.select("file").distinct().where("file % 3 <> 0").select("file", F.floor(F.col("file") / 2).alias("parent")).where("parent > 0")
    return folds.entry_owners(en, parents)


@query(f"""WITH {EVENTS_SQL}, r AS (SELECT event_id, user_id, k // 20 AS step, k % 3 AS a, CASE WHEN k % 2 = 0 THEN 1 END AS b FROM e), l AS (SELECT *, lag(event_id) OVER w AS p, lag(a) OVER w AS pa, lag(b) OVER w AS pb FROM r WINDOW w AS (PARTITION BY user_id, step ORDER BY event_id)),
n AS (SELECT * FROM l WHERE p IS NULL OR a IS DISTINCT FROM pa OR b IS DISTINCT FROM pb) SELECT event_id, user_id, step, a, b, lag(event_id) OVER (PARTITION BY user_id, step ORDER BY event_id) AS replaces FROM n""")
def slot_requests(spark, sf_dir):
    r = events(spark, sf_dir).select("event_id", "user_id", F.floor(F.col("k") / 20).alias("step"), (F.col("k") % 3).alias("a"), F.when(F.col("k") % 2 == 0, 1).alias("b"))
    return folds.slot_requests(r, ["user_id", "step"], "event_id", ["a", "b"], "event_id")


@query("""WITH c AS (SELECT o_custkey % 4000 AS session, o_orderkey AS seq, CASE WHEN o_custkey % 3 = 0 THEN o_orderkey * 10 ELSE (o_orderkey * 7919) % 1000 END AS start, o_orderkey % 50 AS total FROM orders),
m AS (SELECT *, coalesce(start > lag(start) OVER w, row_number() OVER w = 1) AS rising, lead(start) OVER w AS nxt, count(*) OVER (PARTITION BY session) AS n, row_number() OVER (PARTITION BY session ORDER BY seq DESC) = 1 AS last FROM c WINDOW w AS (PARTITION BY session ORDER BY seq)),
k AS (SELECT *, CASE WHEN n = 1 THEN 'single' WHEN bool_and(rising) OVER (PARTITION BY session) THEN 'delta' ELSE 'cumulative' END AS kind FROM m)
SELECT session, start, CASE WHEN kind = 'delta' THEN nxt END AS "end", total, kind FROM k WHERE kind <> 'cumulative' OR last""")
def checkpoint_windows(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    start = F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderkey") * 10).otherwise((F.col("o_orderkey") * 7919) % 1000)
    return folds.checkpoint_windows(o.select((F.col("o_custkey") % 4000).alias("session"), F.col("o_orderkey").alias("seq"), start.alias("start"), (F.col("o_orderkey") % 50).alias("total")), "session", "seq", "start", "total")


@query(f"""WITH {EVENTS_SQL}, x AS (SELECT event_id AS entry, 'own' AS part, 0 AS nth, k AS usage FROM e WHERE k % 5 <> 0 UNION ALL SELECT event_id, 'tools', n, k + n FROM e, range(0, 3) t(n) WHERE n < k % 4 UNION ALL SELECT event_id, 'subagents', 0, k * 2 FROM e WHERE k % 6 = 0)
SELECT entry, part, CAST(nth AS INT) AS nth, usage::BIGINT AS usage FROM x""")
def nested_requests(spark, sf_dir):
    k = F.col("k").cast("long")
    use = lambda x: F.struct(x.alias("tokens"))
    e = events(spark, sf_dir).select(
        F.col("event_id").alias("entry"), F.when(k % 5 != 0, use(k)).alias("own"),
        F.transform(F.when(k % 4 > 0, F.sequence(F.lit(0).cast("long"), k % 4 - 1)), lambda i: use(k + i)).alias("tools"), F.when(k % 6 == 0, F.array(use(k * 2))).alias("subagents"),
    )
    return folds.tree_requests(e, "entry", {"own": "own", "tools": "tools", "subagents": "subagents"}).select("entry", "part", "nth", F.col("usage.tokens").alias("usage"))
