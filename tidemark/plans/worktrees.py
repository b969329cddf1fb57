"""Paths of events in the worktrees of their users' repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import worktrees as wt
from tidemark.plans.base import EVENTS_SQL, events, registry, table

QUERIES, ORACLES, query = registry()


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user has a repository with a nested worktree, one in ten lists a folder that others list too."""
    listing = F.format_string(
        "worktree /w/u%1$d/main\nHEAD m%1$d\nbranch refs/heads/main\n\nworktree /w/u%1$d/main/trees/t/\nHEAD t%1$d\n%2$s\n\nworktree /w/bare%1$d\nbare\n%3$s",
        "user_id", F.when(F.col("user_id") % 2 == 0, "detached").otherwise("branch refs/heads/side"),
        F.when(F.col("user_id") % 10 == 0, F.format_string("\nworktree /w/shared/%d\nbranch refs/heads/s\n", F.col("user_id") % 30)).otherwise(""),
    )
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return wt.worktree_records(users.select(F.format_string("/w/u%d/main/.git/", "user_id").alias("repo"), listing.alias("listing")))


_TREES_SQL = """
users AS (SELECT DISTINCT user_id AS u FROM events),
trees AS (
  SELECT u, '/w/u' || u || '/main/.git' AS repo, '/w/u' || u || '/main' AS tree, 'main' AS branch, 'm' || u AS head FROM users
  UNION ALL SELECT u, '/w/u' || u || '/main/.git', '/w/u' || u || '/main/trees/t', CASE WHEN u % 2 = 1 THEN 'side' END, 't' || u FROM users
  UNION ALL SELECT u, '/w/u' || u || '/main/.git', '/w/shared/' || (u % 30), 's', NULL FROM users WHERE u % 10 = 0)"""


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = ("/w/u%1$d/main/./src//f%2$d.py", "/w/u%1$d/main/trees/t/../t/a%2$d", "/w/u%1$d/main/.git/f%2$d", "src/%2$d", "/w/shared/%3$d/x%2$d/", "/w/u%1$d/mainly/%2$d")
    user = (F.col("user_id"), F.col("k"), F.col("user_id") % 30)
    path = F.coalesce(*[F.when(F.col("event_id") % 6 == i, F.format_string(f, *user)) for i, f in enumerate(forms)])
    return events(spark, sf_dir).select("event_id", "user_id", path.alias("path"))


_PATHS_SQL = """
paths AS (
  SELECT event_id, user_id AS u,
    CASE event_id % 6 WHEN 0 THEN '/w/u' || user_id || '/main/./src//f' || k || '.py' WHEN 1 THEN '/w/u' || user_id || '/main/trees/t/../t/a' || k WHEN 2 THEN '/w/u' || user_id || '/main/.git/f' || k
      WHEN 3 THEN 'src/' || k WHEN 4 THEN '/w/shared/' || (user_id % 30) || '/x' || k || '/' ELSE '/w/u' || user_id || '/mainly/' || k END AS path,
    CASE event_id % 6 WHEN 0 THEN '/w/u' || user_id || '/main/src/f' || k || '.py' WHEN 1 THEN '/w/u' || user_id || '/main/trees/t/a' || k WHEN 2 THEN '/w/u' || user_id || '/main/.git/f' || k
      WHEN 4 THEN '/w/shared/' || (user_id % 30) || '/x' || k WHEN 5 THEN '/w/u' || user_id || '/mainly/' || k END AS clean
  FROM e),
held AS (
  SELECT p.clean, t.tree, count(*) AS n, min(t.repo) AS repo FROM (SELECT DISTINCT clean FROM paths) p JOIN trees t ON starts_with(p.clean, t.tree || '/') AND NOT starts_with(p.clean, t.repo || '/') GROUP BY p.clean, t.tree),
deepest AS (SELECT clean, max_by(tree, length(tree)) AS tree, max_by(n, length(tree)) AS n, max_by(repo, length(tree)) AS repo FROM held GROUP BY clean),
resolved AS (
  SELECT DISTINCT p.path, CASE WHEN p.clean IS NULL THEN 'invalid' WHEN d.n IS NULL THEN 'outside' WHEN d.n > 1 THEN 'ambiguous' ELSE 'matched' END AS status,
    CASE WHEN d.n = 1 THEN d.repo END AS repo, CASE WHEN d.n = 1 THEN d.tree END AS worktree, CASE WHEN d.n = 1 THEN substr(p.clean, length(d.tree) + 2) END AS relative
  FROM paths p LEFT JOIN deepest d USING (clean))"""


@query(f"WITH {EVENTS_SQL}, {_TREES_SQL}, {_PATHS_SQL} SELECT * FROM resolved")
def resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worktree that holds each path of an event."""
    return wt.resolve_paths(_paths(spark, sf_dir), _trees(spark, sf_dir))


@query(f"""
WITH {EVENTS_SQL}, {_TREES_SQL}, {_PATHS_SQL},
g AS (SELECT DISTINCT user_id * 1000000 + event_id // 100 AS event_id, user_id AS u FROM events),
ev AS (
  SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '/w/u' || (u + 1) || '/main/.git' WHEN event_id % 5 = 1 THEN '/w/u' || u || '/main/.git' END AS repo, CASE WHEN event_id % 7 = 0 THEN 'kept' END AS branch FROM g),
seen AS (SELECT p.u * 1000000 + p.event_id // 100 AS event_id, p.event_id AS nth, r.* FROM paths p JOIN resolved r ON r.path = p.path WHERE r.status = 'matched'),
told AS (SELECT event_id, min(repo) AS repo, min(worktree) AS tree, count(DISTINCT worktree) AS n, string_agg(relative, '|' ORDER BY nth) AS relative FROM seen GROUP BY event_id),
x AS (
  SELECT ev.*, told.repo AS told_repo, told.tree, told.relative, t.branch AS tree_branch, t.head,
    CASE WHEN told.n IS NULL THEN 'unassigned' WHEN told.n > 1 THEN 'multi-root' WHEN ev.repo <> told.repo THEN 'conflict' WHEN t.branch IS NULL AND ev.branch IS NULL THEN 'detached' ELSE 'assigned' END AS assignment
  FROM ev LEFT JOIN told USING (event_id) LEFT JOIN trees t ON t.repo = told.repo AND t.tree = told.tree)
SELECT event_id, assignment, CASE WHEN assignment IN ('assigned', 'detached') THEN told_repo ELSE repo END AS repo, CASE WHEN assignment IN ('assigned', 'detached') THEN tree END AS worktree,
  CASE WHEN assignment IN ('assigned', 'detached') THEN coalesce(branch, tree_branch) ELSE branch END AS branch, CASE WHEN assignment IN ('assigned', 'detached') THEN head END AS head,
  CASE WHEN assignment IN ('assigned', 'detached') THEN relative ELSE '' END AS relative
FROM x""")
def path_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the paths of a user's hundred events in turn say of repository, worktree and branch."""
    group = (F.col("user_id") * 1000000 + F.floor(F.col("event_id") / 100)).cast("long")
    paths = _paths(spark, sf_dir).withColumn("group", group)
    none = F.lit(None).cast("string")
    user = F.col("user_id")
    repo = F.when(F.col("group") % 5 == 0, F.format_string("/w/u%d/main/.git", user + 1)).when(F.col("group") % 5 == 1, F.format_string("/w/u%d/main/.git", user))
    known = paths.select("group", "user_id").distinct().select(F.col("group").alias("event_id"), repo.alias("repo"), none.alias("worktree"), F.when(F.col("group") % 7 == 0, "kept").alias("branch"), none.alias("head"))
    out = wt.correlate_contexts(known, paths.select(F.col("group").alias("event_id"), F.col("event_id").alias("nth"), "path"), _trees(spark, sf_dir))
    return out.withColumn("relative", F.array_join("relative", "|"))


@query(f"""
WITH {EVENTS_SQL}, {_TREES_SQL},
p AS (SELECT DISTINCT user_id AS u, k, event_id % 3 AS form FROM e),
disk AS (SELECT DISTINCT user_id AS u, k FROM e WHERE event_id % 2 = 0)
SELECT CASE form WHEN 0 THEN '/w/u' || p.u || '/main/gone/' || p.k WHEN 1 THEN '/tmp/d' || p.u || '/f' || p.k ELSE '/w/u' || p.u || '/main/trees/t/x' || p.k END AS path,
  CASE WHEN form <> 1 THEN 'repo' WHEN disk.u IS NOT NULL THEN 'outside' ELSE 'missing' END AS kind, t.repo, t.tree AS worktree, t.branch, t.head
FROM p LEFT JOIN disk ON disk.u = p.u AND disk.k = p.k
LEFT JOIN trees t ON t.u = p.u AND t.tree = CASE form WHEN 0 THEN '/w/u' || p.u || '/main' WHEN 2 THEN '/w/u' || p.u || '/main/trees/t' END""")
def located_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where files and lost folders belong, by the nearest folder above them."""
    e = events(spark, sf_dir)
    forms = ("/w/u%d/main/gone/%d", "/tmp/d%d/f%d", "/w/u%d/main/trees/t/x%d")
    paths = e.select(F.coalesce(*[F.when(F.col("event_id") % 3 == i, F.format_string(f, "user_id", "k")) for i, f in enumerate(forms)]).alias("path"))
    files = e.where("event_id % 2 = 0").select(F.format_string("/tmp/d%d/f%d", "user_id", "k").alias("path"), F.lit("file").alias("kind"))
    folders = e.select(F.format_string("/tmp/d%d", "user_id").alias("path"), F.lit("directory").alias("kind"))
    return wt.locate_paths(paths, _trees(spark, sf_dir), files.union(folders).distinct())
