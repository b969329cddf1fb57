"""Paths to repositories and worktrees: listings of worktrees, what holds a path, and what that says of an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import absolute_path, path_prefixes


def worktree_records(listings: DataFrame) -> DataFrame:
    """(repo, path, branch, head, detached, bare, prunable) from (repo, listing): git's porcelain list of worktrees.

    A blank line parts the worktrees. A block without an absolute path, a null listing and a
    repository whose folder is not absolute give no rows; a worktree listed twice is one.
    """
    blocks = F.explode(F.split(F.replace("listing", F.lit("\r\n"), F.lit("\n")), "\n\n"))
    lines = F.filter(F.transform(F.split("block", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    value = lambda name: F.get(F.transform(F.filter("lines", lambda x: x.startswith(f"{name} ")), lambda x: F.substr(x, F.lit(len(name) + 2))), F.lit(0))
    rows = listings.select(absolute_path(F.col("repo")).alias("repo"), blocks.alias("block")).select("repo", lines.alias("lines"))
    records = rows.select(
        "repo", absolute_path(value("worktree")).alias("path"), F.regexp_replace(value("branch"), "^refs/heads/", "").alias("branch"), value("HEAD").alias("head"),
        F.array_contains("lines", "detached").alias("detached"), F.array_contains("lines", "bare").alias("bare"),
        F.exists("lines", lambda x: (x == "prunable") | x.startswith("prunable ")).alias("prunable"),
    )
    named = records.where("repo is not null and path is not null")
    return named.groupBy("repo", "path").agg(F.min(F.struct("branch", "head", "detached", "bare", "prunable")).alias("x")).select("repo", "path", "x.*")


def _within(path: Column, root: Column) -> Column:
    return (path == root) | F.startswith(path, F.when(root.endswith("/"), root).otherwise(F.concat(root, F.lit("/"))))


def _holders(clean: DataFrame, worktrees: DataFrame) -> DataFrame:
    """Clean paths with the worktrees above them, by an equi-join on their prefixes; what lies in a repository's own folder is in none of its worktrees."""
    trees = worktrees.where("not bare").select("repo", F.col("path").alias("worktree"), "branch", "head", "detached")
    above = clean.select("clean").where("clean is not null").distinct().withColumn("worktree", F.explode(path_prefixes(F.col("clean"))))
    return above.join(trees, "worktree").where(~_within(F.col("clean"), F.col("repo")))


def resolve_paths(paths: DataFrame, worktrees: DataFrame) -> DataFrame:
    """(path, status, repo, worktree, relative) of the distinct paths of (path): the deepest worktree that holds it.

    ``status`` is matched, outside (no worktree holds it), ambiguous (repositories share the
    deepest one) or invalid (null, empty or not absolute).
    """
    clean = paths.select("path").distinct().withColumn("clean", absolute_path(F.col("path")))
    deepest = _holders(clean, worktrees).groupBy("clean", "worktree").agg(F.count("*").alias("n"), F.min("repo").alias("repo"))
    best = deepest.groupBy("clean").agg(F.max(F.struct(F.length("worktree").alias("depth"), "worktree", "n", "repo")).alias("x"))
    found = clean.join(best, "clean", "left")
    status = F.when(F.col("clean").isNull(), "invalid").when(F.col("x").isNull(), "outside").when(F.col("x.n") > 1, "ambiguous").otherwise("matched")
    only = lambda c: F.when(F.col("x.n") == 1, c)
    relative = F.ltrim(F.substr("clean", F.col("x.depth") + 1), F.lit("/"))
    return found.select("path", status.alias("status"), only(F.col("x.repo")).alias("repo"), only(F.col("x.worktree")).alias("worktree"), only(relative).alias("relative"))


def locate_paths(paths: DataFrame, worktrees: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """(path, kind, repo, worktree, branch, head) of the distinct paths of (path), files and lost folders included.

    ``kinds`` has (path, kind) of what is on disk, directory or file; without it every path is
    taken for a directory. A file or a path that is gone belongs where the nearest folder above
    it does. ``kind`` is repo, outside, or missing for what is in no repository and on no disk.
    """
    clean = paths.select("path").distinct().withColumn("clean", absolute_path(F.col("path")))
    known = clean.where("clean is not null").select("clean").distinct()
    if kinds is None:
        folders, own = known.withColumn("folder", F.col("clean")), known.withColumn("own", F.lit("directory"))
    else:
        disk = kinds.select(absolute_path(F.col("path")).alias("folder"), "kind").where("folder is not null")
        # A worktree is a folder, listed or not.
        there = disk.where("kind = 'directory'").select("folder").union(worktrees.select("path")).distinct()
        above = known.withColumn("folder", F.explode(path_prefixes(F.col("clean"))))
        folders = above.join(there, "folder").groupBy("clean").agg(F.max_by("folder", F.length("folder")).alias("folder"))
        own = disk.groupBy(F.col("folder").alias("clean")).agg(F.min("kind").alias("own"))
    placed = _holders(folders.select(F.col("folder").alias("clean")), worktrees)
    best = placed.groupBy("clean").agg(F.max(F.struct(F.length("worktree").alias("depth"), "repo", "worktree", "branch", "head")).alias("x")).withColumnRenamed("clean", "folder")
    found = clean.join(folders, "clean", "left").join(best, "folder", "left").join(own, "clean", "left")
    kind = F.when(F.col("x").isNotNull(), "repo").when(F.col("own").isNotNull(), "outside").otherwise("missing")
    return found.select("path", kind.alias("kind"), "x.repo", "x.worktree", "x.branch", "x.head")


def correlate_contexts(events: DataFrame, observed: DataFrame, worktrees: DataFrame) -> DataFrame:
    """(event_id, assignment, repo, worktree, branch, head, relative): what an event's observed paths say of where it was.

    ``events`` has (event_id, repo, worktree, branch, head), what is known of each, and
    ``observed`` (event_id, nth, path). Paths in no worktree say nothing: without others the
    event is unassigned. Paths in several worktrees are multi-root, those elsewhere than the
    event says a conflict; both leave it as it was. Else the worktree fills what is null:
    assigned, or detached where it has no branch to give. ``relative`` has the paths within it.
    """
    seen = observed.select("event_id", "nth", "path").join(resolve_paths(observed, worktrees).where("status = 'matched'"), "path")
    told = seen.groupBy("event_id").agg(
        F.min("repo").alias("__repo"), F.min("worktree").alias("__tree"), F.max("worktree").alias("__high"), F.array_sort(F.collect_list(F.struct("nth", "relative"))).alias("__rel")
    )
    state = worktrees.select(F.col("repo").alias("__repo"), F.col("path").alias("__tree"), F.col("branch").alias("__branch"), F.col("head").alias("__head"), (F.col("detached") | F.col("branch").isNull()).alias("__loose"))
    x = events.select("event_id", "repo", "worktree", "branch", "head").join(told.join(state, ["__repo", "__tree"]), "event_id", "left")
    differs = lambda mine, theirs: F.coalesce(absolute_path(F.col(mine)) != F.col(theirs), F.lit(False))
    assignment = (
        F.when(F.col("__tree").isNull(), "unassigned").when(F.col("__tree") != F.col("__high"), "multi-root")
        .when(differs("repo", "__repo") | differs("worktree", "__tree"), "conflict")
        .when(F.col("__loose") & F.col("branch").isNull(), "detached").otherwise("assigned")
    )
    placed = F.col("assignment").isin("assigned", "detached")
    fill = lambda mine, theirs: F.when(placed, theirs).otherwise(F.col(mine)).alias(mine)
    return x.withColumn("assignment", assignment).select(
        "event_id", "assignment", fill("repo", F.col("__repo")), fill("worktree", F.col("__tree")),
        fill("branch", F.coalesce("branch", F.when(~F.col("__loose"), F.col("__branch")))), fill("head", F.coalesce("head", "__head")),
        F.when(placed, F.col("__rel.relative")).otherwise(F.array().cast("array<string>")).alias("relative"),
    )
