"""Commit graphs over the event table: its rows as commits on branches that fork, merge and end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.history import fork_points as points_of
from tidemark.plans.base import registry, table
from tidemark.session import materialize

QUERIES, ORACLES, query = registry()


def commit_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(commits, branches, bases, created) of 64 repositories: a branch ends after a stretch of ids, some commits merge what came before them elsewhere."""
    stretch = F.floor(F.col("event_id") / 2000)
    e = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 64).cast("string").alias("repo"), F.col("event_id").alias("id"), F.col("event_id").cast("string").alias("sha"), F.col("ts").cast("timestamp").alias("at"),
        F.when(F.col("event_id") % 4 == 0, "main").otherwise(F.concat_ws("-", F.lit("b"), (F.col("event_id") % 4).cast("string"), stretch.cast("string"))).alias("branch"),
        (F.col("event_id") % 4).alias("lane"), stretch.alias("stretch"),
    )
    here, repo = Window.partitionBy("repo", "branch").orderBy("id"), Window.partitionBy("repo").orderBy("id")
    c = e.select("*", F.lag("sha").over(here).alias("p"), F.lag("sha").over(repo).alias("q"), F.lag("branch").over(repo).alias("q_branch"))
    second = F.when(F.col("p").isNotNull() & (F.col("id") % 5 == 2) & (F.col("q") != F.col("p")), F.col("q"))
    commits = c.select("repo", "sha", F.array_compact(F.array(F.coalesce("p", "q"), second)).alias("parents"), F.col("id").alias("clock"))
    tips = c.groupBy("repo", "branch").agg(
        F.max("lane").alias("lane"), F.max("stretch").alias("stretch"), F.max_by("sha", "id").alias("sha"), F.max_by("at", "id").alias("at"), F.min_by("sha", "id").alias("oldest"), F.min_by("q_branch", "id").alias("made_from")
    )
    tips, _ = materialize(tips, "branch-tips")
    main = tips.where("branch = 'main'").select("repo", F.col("sha").alias("tip"), F.col("oldest").alias("root"))
    explicit = F.coalesce((F.col("lane") == 1) & (F.col("stretch") % 7 == 3), F.lit(False))
    bases = tips.where("branch <> 'main'").join(main, "repo").select(
        "repo", "branch", F.when(explicit, F.col("root")).otherwise("main").alias("ref"), F.when(explicit, F.col("root")).otherwise(F.col("tip")).alias("sha"), explicit.alias("explicit")
    )
    told = tips.where("lane = 2 and stretch % 2 = 1").select("repo", "branch", "oldest", F.when(F.col("stretch") % 4 == 3, "HEAD").otherwise(F.col("made_from")).alias("ref"))
    created = told.join(tips.select("repo", F.col("branch").alias("ref"), F.col("sha").alias("ref_sha")), ["repo", "ref"], "left").select("repo", "branch", F.col("oldest").alias("sha"), "ref", "ref_sha")
    return commits, tips.select("repo", "branch", "sha", "at"), bases, created


@query("""
WITH RECURSIVE e AS (
  SELECT CAST(user_id % 64 AS VARCHAR) AS repo, event_id AS id, CAST(event_id AS VARCHAR) AS sha, ts AS moment, event_id % 4 AS lane, event_id // 2000 AS stretch,
         CASE WHEN event_id % 4 = 0 THEN 'main' ELSE 'b-' || (event_id % 4) || '-' || (event_id // 2000) END AS branch
  FROM events),
c AS MATERIALIZED (
  SELECT *, lag(sha) OVER (PARTITION BY repo, branch ORDER BY id) AS p, lag(sha) OVER (PARTITION BY repo ORDER BY id) AS q, lag(branch) OVER (PARTITION BY repo ORDER BY id) AS q_branch FROM e),
links AS MATERIALIZED (
  SELECT repo, sha, coalesce(p, q) AS parent, 0 AS nth FROM c WHERE coalesce(p, q) IS NOT NULL
  UNION ALL SELECT repo, sha, q, 1 FROM c WHERE p IS NOT NULL AND id % 5 = 2 AND q <> p),
anc AS (
  SELECT repo, sha AS a, sha AS x FROM c
  UNION SELECT anc.repo, anc.a, l.parent FROM anc JOIN links l ON l.repo = anc.repo AND l.sha = anc.x),
tips AS MATERIALIZED (
  SELECT repo, branch, max(lane) AS lane, max(stretch) AS stretch, max_by(sha, id) AS head, max_by(moment, id) AS moment, min_by(sha, id) AS oldest, min_by(q_branch, id) AS made_from
  FROM c GROUP BY repo, branch),
base AS MATERIALIZED (
  SELECT t.repo, t.branch, t.lane = 1 AND t.stretch % 7 = 3 AS explicit,
         CASE WHEN t.lane = 1 AND t.stretch % 7 = 3 THEN m.oldest ELSE 'main' END AS ref, CASE WHEN t.lane = 1 AND t.stretch % 7 = 3 THEN m.oldest ELSE m.head END AS base
  FROM tips t JOIN tips m ON m.repo = t.repo AND m.branch = 'main' WHERE t.branch <> 'main'),
made AS (
  SELECT repo, branch, oldest, CASE WHEN stretch % 4 = 3 THEN 'HEAD' ELSE made_from END AS ref FROM tips WHERE lane = 2 AND stretch % 2 = 1),
line AS (
  SELECT repo, head AS x FROM tips WHERE branch = 'main'
  UNION SELECT line.repo, l.parent FROM line JOIN links l ON l.repo = line.repo AND l.sha = line.x AND l.nth = 0),
free AS MATERIALIZED (
  SELECT t.* FROM tips t LEFT JOIN base b USING (repo, branch) WHERE t.branch <> 'main' AND NOT coalesce(b.explicit, false)),
mainline AS (
  SELECT f.repo, f.branch, f.head, min_by(l.parent, CAST(line.x AS BIGINT)) AS base
  FROM free f JOIN tips m ON m.repo = f.repo AND m.branch = 'main' JOIN anc held ON held.repo = f.repo AND held.a = m.head AND held.x = f.head
  JOIN line ON line.repo = f.repo JOIN anc up ON up.repo = f.repo AND up.a = line.x AND up.x = f.head AND line.x <> f.head
  JOIN links two ON two.repo = f.repo AND two.sha = line.x AND two.nth = 1 JOIN links l ON l.repo = f.repo AND l.sha = line.x AND l.nth = 0
  GROUP BY f.repo, f.branch, f.head),
pairs AS MATERIALIZED (
  SELECT t.repo, t.branch, t.head, b.base AS other, CASE WHEN b.explicit THEN 'explicit' ELSE 'default' END AS method, b.ref, true AS self FROM tips t JOIN base b USING (repo, branch)
  UNION ALL SELECT f.repo, f.branch, f.head, t.head, 'reflog', m.ref, false FROM free f JOIN made m USING (repo, branch) JOIN tips t ON t.repo = f.repo AND t.branch = m.ref
  UNION ALL SELECT repo, branch, head, base, 'default', 'main', false FROM mainline),
common AS MATERIALIZED (
  SELECT p.*, h.x FROM pairs p JOIN anc h ON h.repo = p.repo AND h.a = p.head JOIN anc o ON o.repo = p.repo AND o.a = p.other AND o.x = h.x),
forks AS (
  SELECT repo, branch, head, method, ref, x FROM common k
  WHERE NOT EXISTS (SELECT 1 FROM links l JOIN common y ON y.repo = l.repo AND y.x = l.sha WHERE l.repo = k.repo AND l.parent = k.x AND y.branch = k.branch AND y.method = k.method AND y.other = k.other)
    AND (self OR x <> head)),
told AS MATERIALIZED (
  SELECT f.repo, f.branch, f.head, 'reflog' AS method, m.ref, m.oldest AS x FROM free f JOIN made m USING (repo, branch) JOIN anc h ON h.repo = f.repo AND h.a = f.head AND h.x = m.oldest
  UNION ALL SELECT * FROM forks WHERE method = 'reflog'),
near AS MATERIALIZED (
  SELECT f.repo, f.branch, f.head, t.branch AS ref, t.moment, h.x
  FROM free f JOIN tips t ON t.repo = f.repo AND t.branch NOT IN ('main', f.branch)
  JOIN anc h ON h.repo = f.repo AND h.a = f.head JOIN anc o ON o.repo = f.repo AND o.a = t.head AND o.x = h.x
  WHERE NOT EXISTS (SELECT 1 FROM told WHERE told.repo = f.repo AND told.branch = f.branch)
    AND NOT EXISTS (SELECT 1 FROM anc WHERE anc.repo = f.repo AND anc.a = t.head AND anc.x = f.head)),
shared AS MATERIALIZED (SELECT repo, branch, head, x, arg_min(ref, (-epoch_us(moment), ref)) AS ref FROM near GROUP BY repo, branch, head, x),
others AS (
  SELECT repo, branch, head, 'ancestor-branch', ref, x FROM shared s
  WHERE NOT EXISTS (SELECT 1 FROM links l JOIN shared y ON y.repo = l.repo AND y.x = l.sha WHERE l.repo = s.repo AND l.parent = s.x AND y.branch = s.branch)),
found AS (SELECT * FROM forks WHERE method <> 'reflog' UNION ALL SELECT * FROM told UNION ALL SELECT * FROM others),
sizes AS MATERIALIZED (SELECT repo, a, count(*) AS n FROM anc GROUP BY repo, a),
ranked AS (
  SELECT f.repo, f.branch, f.method, f.ref, f.x AS fork, h.n - o.n AS distance,
         row_number() OVER (PARTITION BY f.repo, f.branch ORDER BY f.x = f.head, h.n - o.n, CASE f.method WHEN 'default' THEN 2 WHEN 'ancestor-branch' THEN 1 ELSE 0 END, coalesce(-epoch_us(t.moment), 0), f.ref, f.method, f.x) AS nth
  FROM found f JOIN sizes h ON h.repo = f.repo AND h.a = f.head JOIN sizes o ON o.repo = f.repo AND o.a = f.x LEFT JOIN tips t ON t.repo = f.repo AND t.branch = f.ref)
SELECT tips.repo, tips.branch, r.method, r.ref, r.fork, r.distance FROM tips LEFT JOIN ranked r ON r.repo = tips.repo AND r.branch = tips.branch AND r.nth = 1
""")
def fork_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each branch forked, by reflog, other branches, base or merge."""
    return points_of(*commit_tables(spark, sf_dir))
