"""Branch, worktree and repository of events, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import placement
from tidemark.plans.base import EVENTS_SQL, events, registry, table

QUERIES, ORACLES, query = registry()

MOVES = f"""{EVENTS_SQL}, st AS (SELECT user_id % 50 AS worktree, ts AS t0, event_id AS seq, CASE WHEN k % 7 <> 0 THEN 'b' || (k % 5) END AS branch, k % 7 = 0 AS detached, k % 3 = 0 AS back, CASE WHEN k % 13 = 0 AND k % 7 <> 0 THEN 'b' || ((k + 1) % 5) END AS renamed_from FROM e WHERE event_type IN ('signup', 'error') AND k % 11 <> 0),
lagged AS (SELECT *, lag(detached) OVER w AS pd, lag(branch) OVER w AS pb FROM st WINDOW w AS (PARTITION BY worktree ORDER BY t0, seq)),
m AS (SELECT * FROM lagged WHERE pd IS NULL OR pd <> detached OR pb IS DISTINCT FROM branch)"""


def _moves(spark, sf_dir):
    e = events(spark, sf_dir).where("event_type in ('signup', 'error')")
    local = F.col("k") % 7 != 0
    reflog = e.select(
        (F.col("user_id") % 50).alias("worktree"), F.col("ts").alias("at"), F.col("event_id").alias("seq"),
        F.when(F.col("k") % 11 != 0, F.when(local, F.concat(F.lit("b"), (F.col("k") % 5).cast("string"))).otherwise(F.concat(F.lit("sha"), F.col("k").cast("string")))).alias("target"),
        (F.col("k") % 3 == 0).alias("returning"), F.when((F.col("k") % 13 == 0) & local, F.concat(F.lit("b"), ((F.col("k") + 1) % 5).cast("string"))).alias("renamed_from"),
    )
    names = spark.range(50).select(F.col("id").alias("worktree"), F.explode(F.array(*[F.lit(f"b{i}") for i in range(5)])).alias("name"))
    return placement.head_moves(reflog, names)


@query(f"""WITH {MOVES} SELECT worktree, seq, branch, detached, CASE WHEN detached THEN coalesce(CASE WHEN lead(back) OVER w THEN lead(branch) OVER w END,
  last_value(branch IGNORE NULLS) OVER (PARTITION BY worktree ORDER BY t0, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  first_value(branch IGNORE NULLS) OVER (PARTITION BY worktree ORDER BY t0, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) END AS owner FROM m WINDOW w AS (PARTITION BY worktree ORDER BY t0, seq)""")
def head_moves(spark, sf_dir):
    return _moves(spark, sf_dir).select("worktree", "seq", "branch", "detached", "owner")


@query(f"""WITH RECURSIVE {MOVES}, ren AS (SELECT worktree, seq AS id, t0, renamed_from AS f, branch AS t FROM m WHERE renamed_from IS NOT NULL AND branch IS NOT NULL),
nxt AS (SELECT a.id, arg_min(b.id, (b.t0, b.id)) AS id2 FROM ren a JOIN ren b ON a.worktree = b.worktree AND b.f = a.t AND (b.t0, b.id) > (a.t0, a.id) GROUP BY a.id),
fst AS (SELECT m.seq, arg_min(b.id, (b.t0, b.id)) AS id FROM m JOIN ren b ON m.worktree = b.worktree AND b.f = m.branch AND (b.t0, b.id) > (m.t0, m.seq) GROUP BY m.seq),
c AS (SELECT seq, id FROM fst UNION ALL SELECT c.seq, n.id2 FROM c JOIN nxt n ON c.id = n.id),
ends AS (SELECT c.seq, r.t FROM c JOIN ren r ON r.id = c.id LEFT JOIN nxt n ON n.id = c.id WHERE n.id IS NULL)
SELECT m.worktree, m.seq, coalesce(x.t, m.branch) AS branch FROM m LEFT JOIN ends x ON x.seq = m.seq""")
def renamed_branches(spark, sf_dir):
    return placement.follow_renames(_moves(spark, sf_dir)).select("worktree", "seq", "branch")


@query("""WITH m AS (SELECT user_id, ts, max(event_id) AS b FROM events WHERE event_type = 'signup' AND user_id % 3 = 0 GROUP BY 1, 2),
p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), x AS (SELECT p.*, m.b FROM p ASOF LEFT JOIN m ON p.user_id = m.user_id AND p.ts >= m.ts)
SELECT event_id, CASE WHEN b IS NOT NULL THEN b::VARCHAR WHEN user_id NOT IN (SELECT user_id FROM m) AND user_id % 5 <> 0 AND ts >= TIMESTAMP '2024-01-10' THEN 'main' END AS branch,
CASE WHEN b IS NOT NULL THEN 'move' WHEN user_id NOT IN (SELECT user_id FROM m) AND user_id % 5 <> 0 AND ts >= TIMESTAMP '2024-01-10' THEN 'current' END AS method FROM x""")
def branch_or_current(spark, sf_dir):
    e = events(spark, sf_dir).withColumnRenamed("user_id", "worktree")
    moves = e.where("event_type = 'signup' and worktree % 3 = 0").groupBy("worktree", F.col("ts").alias("at")).agg(F.max("event_id").cast("string").alias("branch"))
    current = e.where("worktree % 5 <> 0").select("worktree").distinct().select("worktree", F.lit("main").alias("current_branch"), F.lit("2024-01-10").cast("timestamp").alias("since"))
    return placement.branch_at(e.where("event_type = 'purchase'").select("event_id", "worktree", "ts"), moves, current).select("event_id", "branch", "method")


CHAIN = f"""{EVENTS_SQL}, cm AS (SELECT l_orderkey % 4000 AS sha, 'b' || (l_suppkey % 7) AS branch FROM lineitem), one AS (SELECT sha, min(branch) AS branch FROM cm GROUP BY 1 HAVING min(branch) = max(branch)),
c AS (SELECT event_id, 0 AS rule, 'tool' AS method, 't' || (user_id % 3) AS branch, 0.95 AS confidence FROM e WHERE event_id % 17 = 0
UNION ALL SELECT event_id, 1, 'hook', 'h' || k, 0.85 FROM e WHERE k % 19 = 0
UNION ALL SELECT event_id, 2, 'scored', o.branch, 0.9 FROM e JOIN one o ON o.sha = e.event_id % 8000),
f AS (SELECT event_id, arg_min(branch, rule) AS branch, arg_min(confidence, rule) AS confidence, arg_min(method, rule) AS method FROM c GROUP BY 1)"""


def _first(spark, sf_dir):
    e = events(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem")
    commits = lines.select((F.col("l_orderkey") % 4000).alias("sha"), F.concat(F.lit("b"), (F.col("l_suppkey") % 7).cast("string")).alias("branch"))
    rules = {
        "tool": e.where("event_id % 17 = 0").select("event_id", F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("branch"), F.lit(0.95).alias("confidence")),
        "hook": e.where("k % 19 = 0").select("event_id", F.concat(F.lit("h"), F.col("k").cast("string")).alias("branch"), F.lit(0.85).alias("confidence")),
        "scored": placement.scored_commits(e.withColumn("sha", F.col("event_id") % 8000), commits),
    }
    return e, placement.first_rule(rules)


@query(f"WITH {CHAIN} SELECT event_id, branch, CAST(confidence AS DOUBLE) AS confidence, method FROM f")
def placement_rules(spark, sf_dir):
    return _first(spark, sf_dir)[1]


@query(f"""WITH {CHAIN}, v AS (SELECT event_id, ts, user_id % 40 AS session, CASE WHEN event_id % 2 = 0 THEN k END AS request FROM e),
pl AS (SELECT v.*, f.branch, f.confidence FROM v JOIN f USING (event_id)), rq AS (SELECT request, arg_min(branch, (-confidence, branch)) AS branch, max(confidence) AS confidence FROM pl WHERE request IS NOT NULL GROUP BY 1),
o AS (SELECT v.*, rq.branch AS rb, rq.confidence AS rc FROM v LEFT JOIN rq USING (request) WHERE v.event_id NOT IN (SELECT event_id FROM f)),
bk AS (SELECT session, ts, arg_max(branch, event_id) AS branch, arg_max(confidence, event_id) AS confidence FROM pl GROUP BY 1, 2), fw AS (SELECT session, ts, arg_min(branch, event_id) AS branch, arg_min(confidence, event_id) AS confidence FROM pl GROUP BY 1, 2),
n AS (SELECT o.event_id, epoch_us(o.ts) - epoch_us(b.ts) AS gb, epoch_us(w.ts) - epoch_us(o.ts) AS gf, b.branch AS bb, b.confidence AS bc, w.branch AS fb, w.confidence AS fc FROM o ASOF LEFT JOIN bk b ON o.session = b.session AND o.ts >= b.ts ASOF LEFT JOIN fw w ON o.session = w.session AND o.ts <= w.ts WHERE o.rb IS NULL)
SELECT event_id, branch, CAST(confidence AS DOUBLE) AS confidence, method FROM f UNION ALL SELECT event_id, rb, CAST(least(rc, 0.8) AS DOUBLE), 'request' FROM o WHERE rb IS NOT NULL
UNION ALL SELECT event_id, CASE WHEN gb IS NOT NULL AND (gf IS NULL OR gb <= gf) THEN bb ELSE fb END, CAST(least(CASE WHEN gb IS NOT NULL AND (gf IS NULL OR gb <= gf) THEN bc ELSE fc END, 0.8) AS DOUBLE), 'session' FROM n WHERE gb IS NOT NULL OR gf IS NOT NULL""")
def placement_links(spark, sf_dir):
    e, found = _first(spark, sf_dir)
    asked = e.select("event_id", "ts", (F.col("user_id") % 40).alias("session"), F.when(F.col("event_id") % 2 == 0, F.col("k")).alias("request"))
    return placement.by_links(asked, found)


@query(f"""WITH {EVENTS_SQL}, s AS (SELECT user_id % 50 AS worktree, k % 3 AS incarnation, ts AS t0, k % 9 AS branch FROM e WHERE event_type = 'signup'),
l AS (SELECT user_id % 50 AS worktree, ts AS t0, k % 9 AS branch FROM e WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-20' AND user_id % 50 <> 7),
i AS (SELECT * FROM (SELECT worktree, incarnation, min(t0) AS start FROM s GROUP BY 1, 2) LEFT JOIN (SELECT worktree, min(t0) AS live FROM l GROUP BY 1) USING (worktree) WHERE live IS NULL OR start < live),
u AS (SELECT *, lead(start) OVER (PARTITION BY worktree ORDER BY start, incarnation) AS nxt FROM i)
SELECT worktree, incarnation, epoch_us(t0) AS at_us, min(branch) AS branch FROM s JOIN u USING (worktree, incarnation) WHERE (nxt IS NULL OR t0 < nxt) AND (live IS NULL OR t0 < live) GROUP BY 1, 2, 3
UNION ALL SELECT worktree, NULL, epoch_us(t0), min(branch) FROM l GROUP BY 1, 3""")
def merged_histories(spark, sf_dir):
    def part(kind):
        return events(spark, sf_dir).where(F.col("event_type") == kind).select((F.col("user_id") % 50).alias("worktree"), (F.col("k") % 3).alias("incarnation"), F.col("ts").alias("at"), (F.col("k") % 9).alias("branch"))

    live = part("view").drop("incarnation").where((F.col("at") >= F.lit("2024-01-20").cast("timestamp")) & (F.col("worktree") != 7))
    return placement.merge_histories(part("signup"), live).select("worktree", "incarnation", F.unix_micros("at").alias("at_us"), "branch")


@query(f"""WITH {MOVES}, o AS (SELECT *, CASE WHEN detached THEN coalesce(CASE WHEN lead(back) OVER w THEN lead(branch) OVER w END,
  last_value(branch IGNORE NULLS) OVER (PARTITION BY worktree ORDER BY t0, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  first_value(branch IGNORE NULLS) OVER (PARTITION BY worktree ORDER BY t0, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) END AS owner FROM m WINDOW w AS (PARTITION BY worktree ORDER BY t0, seq)),
p AS (SELECT event_id, user_id % 50 AS worktree, ts FROM e WHERE event_type = 'purchase'),
x AS (SELECT p.event_id, arg_max({{'b': branch, 'd': detached, 'o': owner}}, (t0, seq)) AS h FROM p LEFT JOIN o ON o.worktree = p.worktree AND o.t0 <= p.ts GROUP BY 1)
SELECT event_id, CASE WHEN h.d THEN h.o ELSE h.b END AS branch, CASE WHEN h.d AND h.o IS NOT NULL THEN 'owner' WHEN NOT h.d AND h.b IS NOT NULL THEN 'move' END AS method,
CASE WHEN h.d AND h.o IS NOT NULL THEN 0.6 WHEN NOT h.d AND h.b IS NOT NULL THEN 0.95 END::DOUBLE AS confidence FROM x""")
def branch_of_detached(spark, sf_dir):
    """The branch at each purchase; a detached head belongs to the branch around it, less surely."""
    probes = events(spark, sf_dir).where("event_type = 'purchase'").select("event_id", (F.col("user_id") % 50).alias("worktree"), "ts")
    none = spark.createDataFrame([], "worktree long, current_branch string, since timestamp")
    return placement.branch_at(probes, _moves(spark, sf_dir), none).select("event_id", "branch", "method", "confidence")



@query()
def repo_ladder(spark, sf_dir):
    return placement.attribute_repos(*ladder_tables(events(spark, sf_dir)))


def ladder_tables(e):
    """Events with places of their own, turns with touched paths, and parents: held against brute force in the tests."""
    own = F.col("k") % 11 == 0
    rows = e.select(
        "event_id", "ts", F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("self"), F.when(F.col("event_id") % 3 != 0, (F.col("user_id") * 7 + 1) % 150).alias("parent"), F.floor(F.col("event_id") / 10).alias("turn"),
        F.when(own, F.concat(F.lit("r"), (F.col("k") % 3).cast("string"))).alias("repo"), F.when(own, F.concat(F.lit("w"), (F.col("k") % 4).cast("string"))).alias("worktree"),
    )
    touched = e.where("k % 23 = 0").select(F.floor(F.col("event_id") / 10).alias("turn"), F.concat(F.lit("r"), (F.col("k") % 2).cast("string")).alias("repo"), F.concat(F.lit("w"), (F.col("k") % 4).cast("string")).alias("worktree"))
    return rows, touched


SHARES = f"""{EVENTS_SQL}, kd AS (SELECT t.event_id AS turn, 'w' || (c.k % 4) AS place, c.ts BETWEEN t.ts - INTERVAL 2 DAY AND t.ts AS i, CASE WHEN c.event_id % 7 <> 0 THEN c.k ELSE 0 END AS tok FROM e t JOIN e c ON t.user_id = c.user_id AND t.event_type = 'click' AND c.event_type = 'purchase' AND c.k % 9 <> 0),
pp AS (SELECT turn, place, sum(i::INT) AS ni, sum(CASE WHEN i THEN tok ELSE 0 END) AS ti, count(*) AS na, sum(tok) AS ta FROM kd GROUP BY 1, 2), pc AS (SELECT *, sum(ni) OVER (PARTITION BY turn) > 0 AS inside FROM pp),
ch AS (SELECT turn, place, CASE WHEN inside THEN ni ELSE na END AS n, CASE WHEN inside THEN ti ELSE ta END AS t FROM pc),
sh AS (SELECT turn, place, CASE WHEN sum(t) OVER w > 0 THEN t::DOUBLE / (sum(t) OVER w)::DOUBLE ELSE n::DOUBLE / (sum(n) OVER w)::DOUBLE END AS weight FROM ch WINDOW w AS (PARTITION BY turn)), ws AS (SELECT * FROM sh WHERE weight > 0)"""


def _shares(spark, sf_dir):
    e = events(spark, sf_dir)
    turns = e.where("event_type = 'click'").select(F.col("event_id").alias("turn"), F.col("user_id").alias("self"), (F.col("ts") - F.expr("INTERVAL 2 DAYS")).alias("start"), F.col("ts").alias("end"))
    children = e.where("event_type = 'purchase'").select(F.col("user_id").alias("parent"), "ts", F.when(F.col("k") % 9 != 0, F.concat(F.lit("w"), (F.col("k") % 4).cast("string"))).alias("place"), F.when(F.col("event_id") % 7 != 0, F.col("k")).alias("tokens"))
    return e, placement.subagent_shares(turns, children)


@query(f"WITH {SHARES} SELECT turn, place, weight FROM ws")
def subagent_shares(spark, sf_dir):
    return _shares(spark, sf_dir)[1]


@query(f"""WITH {SHARES}, nm AS (SELECT *, row_number() OVER (PARTITION BY turn ORDER BY place) - 1 AS i, count(*) OVER (PARTITION BY turn) AS n FROM ws)
SELECT CASE WHEN n > 1 THEN event_id || '#split:' || i || '/' || n ELSE event_id::VARCHAR END AS share_id, event_id, place, value * coalesce(weight, 1.0) AS value FROM e LEFT JOIN nm ON e.event_id = nm.turn WHERE event_type = 'click'""")
def split_usage(spark, sf_dir):
    e, shares = _shares(spark, sf_dir)
    usage = e.where("event_type = 'click'").select("event_id", F.col("event_id").alias("turn"), "value")
    return placement.split_usage(usage, shares, "turn", ["value"])


@query(f"""WITH {EVENTS_SQL}, v AS (SELECT event_id, CASE WHEN k % 17 <> 0 THEN event_id % 900 END AS session, CASE WHEN k % 4 = 0 THEN 'w' || (k % 3) END AS worktree FROM e),
o AS (SELECT session, min(worktree) AS t FROM v WHERE session IS NOT NULL AND worktree IS NOT NULL GROUP BY 1 HAVING min(worktree) = max(worktree))
SELECT event_id, coalesce(worktree, t) AS worktree, CASE WHEN worktree IS NOT NULL THEN 'own' WHEN t IS NOT NULL THEN 'chat' END AS method FROM v LEFT JOIN o USING (session)""")
def same_chat_worktree(spark, sf_dir):
    v = events(spark, sf_dir).select("event_id", F.when(F.col("k") % 17 != 0, F.col("event_id") % 900).alias("session"), F.when(F.col("k") % 4 == 0, F.concat(F.lit("w"), (F.col("k") % 3).cast("string"))).alias("worktree"))
    return placement.place_same_chat(v)


@query("""WITH c AS (SELECT o_custkey AS session, CASE WHEN o_orderkey % 6 <> 0 THEN 'w' || (o_orderkey % 6) END AS worktree, CASE WHEN o_custkey % 4 <> 0 THEN o_orderkey % 100 END AS tokens FROM orders),
s AS (SELECT session, worktree, sum(coalesce(tokens, 0)) AS t, count(*) AS n FROM c WHERE worktree IS NOT NULL GROUP BY 1, 2),
w AS (SELECT session, worktree, CASE WHEN sum(t) OVER x > 0 THEN t::DOUBLE / (sum(t) OVER x)::DOUBLE ELSE n::DOUBLE / (sum(n) OVER x)::DOUBLE END AS weight FROM s WINDOW x AS (PARTITION BY session)) SELECT * FROM w WHERE weight > 0""")
def session_weights(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    c = o.select(F.col("o_custkey").alias("session"), F.when(F.col("o_orderkey") % 6 != 0, F.concat(F.lit("w"), (F.col("o_orderkey") % 6).cast("string"))).alias("worktree"), F.when(F.col("o_custkey") % 4 != 0, F.col("o_orderkey") % 100).alias("tokens"))
    return placement.session_weights(c)
