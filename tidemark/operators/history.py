"""Fork points of branches over a commit graph.

The graph is dealt into chains: paths of first parents, followed inside parts of a history and
found between them by pointer doubling, in as many rounds as the logarithm of the most parts that
a path goes through. What a commit reaches on a chain is all of it up to some
place. What it reaches beyond its first parent is kept (``ancestry``), so walks look up how far
another commit, or enough tips, reach, and go down only where a branch is alone. Every round is a
table in the shared folder and serves all repositories at once.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ancestry import as_of, blocks, borders, crowds, fresh, holding, latest, ordered, tops, tour
from tidemark.session import drop_path, materialize

#: Branches that are bases of others and have no fork of their own, and whose claim to a fork counts first.
DEFAULT_NAMES = ("main", "master")
METHOD_RANK = {"explicit": 0, "reflog": 0, "ancestor-branch": 1, "default": 2}
#: Commits of a part, in which a task follows lines of first parents.
PART = 1 << 14
#: Tables of so many repositories or fewer are broadcast.
REPOS = 1 << 18
PARTED = "repo string, part struct<__stretch bigint, __nth bigint>, sha string"
FOLLOWED = f"{PARTED}, root string, depth long, parent string, away string, height long, leaf string"
PLACED = "repo string, sha string, chain string, pos long"


class _Tables:
    """Tables of one computation, dropped when its result stands."""

    def __init__(self, spark):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        out, path = materialize(df, name)
        self.paths.append(path)
        return out

    def drop(self) -> None:
        for path in self.paths:
            drop_path(self.spark, path)


def commit_chains(commits: DataFrame, tables: _Tables | None = None) -> tuple[DataFrame, DataFrame]:
    """((repo, sha, chain, pos) of all commits, (repo, chain, pos, to_chain, to_pos, first) of the parent links between chains; ``first`` marks first parents).

    ``commits`` has (repo, sha, parents), first parents first. A commit goes on the chain of the
    longest line of first parents above it, ties to the greater sha; ``pos`` counts the first
    parents below. Parents that are not among the commits (a shallow clone) are not followed.
    Rows of one commit count once; a null repo or sha is no commit; a cycle is an error.
    """
    places, _, across, _ = _chains(commits, tables or _Tables(commits.sparkSession))
    return places, across


def _chains(commits: DataFrame, tables: _Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The tables of ``commit_chains`` with (repo, parent, sha, nth), the links to known parents, between them, and the commits last.

    Lines are followed inside parts of a repository, stretches of its clock, by the task that has
    a part; only the commits at which lines leave a part are doubled.
    """
    clock = F.max(F.col("clock").cast("long")) if "clock" in commits.columns else F.lit(None).cast("long")
    known = commits.where("repo is not null and sha is not null").groupBy("repo", "sha").agg(F.first("parents").alias("parents"), clock.alias("clock"))
    known = tables.keep(known, "commits")
    links = known.select("repo", "sha", F.posexplode("parents").alias("nth", "parent")).where("parent <> sha")
    links = tables.keep(links.join(known.select("repo", F.col("sha").alias("parent")), ["repo", "parent"]), "links")
    # A first parent that is not known leaves a root; the others are links like any.
    local = tables.keep(_parted(known, tables).groupBy("repo", "part").applyInArrow(_followed, FOLLOWED), "lines")
    if not local.where("root is null").isEmpty():
        raise ValueError("the commits' parents form a cycle")
    roots = local.where("sha = root").select("repo", "sha", "part", "away", "height", "leaf")
    hangs = roots.where("away is not null").select("repo", "sha", "away")
    hangs = tables.keep(hangs.join(local.select("repo", F.col("sha").alias("away"), F.col("part").alias("on"), F.col("root").alias("jump"), F.col("depth") + 1), ["repo", "away"]).toDF("repo", "away", "sha", "on", "jump", "pos"), "hangs")
    state = roots.select("repo", "sha", F.struct("height", "leaf").alias("top")).join(hangs.select("repo", "sha", "jump", "pos"), ["repo", "sha"], "left").fillna(0, ["pos"])
    state = tables.keep(state, "chains")
    rounds, total = 0, state.count()
    while not state.where("jump is not null").isEmpty():
        if 1 << rounds > total:
            raise ValueError("the commits' parents form a cycle")
        below = state.select("repo", F.col("sha").alias("jump"), F.col("jump").alias("__jump"), F.col("pos").alias("__pos"))
        above = state.where("jump is not null").groupBy("repo", F.col("jump").alias("sha")).agg(F.max(F.struct((F.col("top.height") + F.col("pos")).alias("height"), F.col("top.leaf").alias("leaf"))).alias("__top"))
        state = tables.keep(
            state.join(below, ["repo", "jump"], "left").join(above, ["repo", "sha"], "left")
            .select("repo", "sha", F.col("__jump").alias("jump"), (F.col("pos") + F.coalesce("__pos", F.lit(0))).alias("pos"), F.greatest("top", "__top").alias("top")),
            "chains",
        )
        rounds += 1
    # Back in its part a commit has the place of its line's end there, and what hangs on the part's commits.
    none = lambda kind: F.lit(None).cast(kind)
    own = local.select("repo", "part", "sha", "root", "depth", "parent", none("long").alias("height"), none("string").alias("leaf"))
    ends = state.join(roots.select("repo", "sha", "part"), ["repo", "sha"]).select("repo", "part", "sha", none("string"), "pos", none("string"), none("long"), none("string"))
    hung = hangs.join(state.select("repo", "sha", "top"), ["repo", "sha"]).select("repo", F.col("on"), "away", none("string"), none("long"), none("string"), F.col("top.height") + 1, F.col("top.leaf"))
    places = tables.keep(own.union(ends).union(hung).groupBy("repo", "part").applyInArrow(_placed, PLACED), "places")
    to = places.select("repo", F.col("sha").alias("parent"), F.col("chain").alias("to_chain"), F.col("pos").alias("to_pos"))
    crossing = links.join(places, ["repo", "sha"]).join(to, ["repo", "parent"])
    # A link inside a chain says nothing new: what is below on a chain is reached anyhow.
    across = crossing.where("chain <> to_chain").groupBy("repo", "chain", "pos", "to_chain", "to_pos").agg(F.max(F.col("nth") == 0).alias("first"))
    return places, links, tables.keep(across, "crossing"), known


def _parted(known: DataFrame, tables: _Tables) -> DataFrame:
    """(repo, sha, part, parent): parts are stretches of a repository's clock and hold ``PART`` commits or so; any parts give the same chains."""
    span = known.groupBy("repo").agg(F.min("clock").alias("__from"), F.max("clock").alias("__to"), F.ceil(F.count("*") / PART).alias("__n"))
    span = tables.keep(span, "spans")
    span = F.broadcast(span) if span.count() <= REPOS else span
    stretch = F.floor((F.col("clock") - F.col("__from")) / (F.col("__to") - F.col("__from") + 1) * F.col("__n")).cast("long")
    first = F.get("parents", F.lit(0))
    cut = known.join(span, "repo").select("repo", "sha", F.when(first != F.col("sha"), first).alias("parent"), F.coalesce(stretch, F.lit(-1).cast("long")).alias("__stretch"))
    # Where a clock stands still its commits are dealt by their names; there are fewer such stretches than commits by PART.
    crowd = cut.groupBy("repo", "__stretch").agg(F.ceil(F.count("*") / (2 * PART)).alias("__n")).where("__n > 1")
    nth = F.pmod(F.xxhash64("sha"), F.coalesce("__n", F.lit(1).cast("long")))
    return cut.join(F.broadcast(crowd), ["repo", "__stretch"], "left").select("repo", "sha", "parent", F.struct("__stretch", nth.alias("__nth")).alias("part"))


def _followed(table: pa.Table) -> pa.Table:
    """A part's commits with the root of their line in it, how far above they are, and of roots the longest line above and the parent away."""
    shas, parents = table.column("sha").to_pylist(), table.column("parent").to_pylist()
    at = {s: i for i, s in enumerate(shas)}
    below = [at.get(p, -1) for p in parents]
    root, depth = [-1 if b >= 0 else i for i, b in enumerate(below)], [0] * len(shas)
    for i in range(len(shas)):
        line = []
        while root[i] == -1:
            root[i] = -2  # on this line: met again, it is a cycle
            line.append(i)
            i = below[i]
        for j in reversed(line):
            root[j], depth[j] = (root[i], depth[i] + 1) if root[i] >= 0 else (-2, 0)
            i = j
    top = {}
    for i, r in enumerate(root):
        if r >= 0:
            top[r] = max(top.get(r, (-1, "")), (depth[i], shas[i]))
    none = [None] * len(shas)
    away, height, leaf = none[:], none[:], none[:]
    for r, (h, s) in top.items():
        away[r], height[r], leaf[r] = parents[r], h, s
    inside = [p if b >= 0 else None for p, b in zip(parents, below, strict=True)]
    made = [pa.array([shas[r] if r >= 0 else None for r in root], pa.string()), pa.array(depth, pa.int64()), pa.array(inside, pa.string()), pa.array(away, pa.string()), pa.array(height, pa.int64()), pa.array(leaf, pa.string())]
    part = table.column("part").combine_chunks()
    part = pa.StructArray.from_arrays(part.flatten(), ["__stretch", "__nth"])
    return pa.table([table.column("repo"), part, table.column("sha"), *made], ["repo", "part", "sha", "root", "depth", "parent", "away", "height", "leaf"])


def _placed(table: pa.Table) -> pa.Table:
    """A part's commits with their chain and place, from its own rows, those of its roots' places and those of what hangs on it."""
    rows = list(zip(*(table.column(c).to_pylist() for c in ("sha", "root", "depth", "parent", "height", "leaf")), strict=True))
    own = sorted((r for r in rows if r[1] is not None), key=lambda r: -r[2])
    place = {r[0]: r[2] for r in rows if r[1] is None and r[4] is None}
    top = {}
    for sha, root, _, _, height, leaf in rows:
        if root is None and height is not None:
            top[sha] = max(top.get(sha, (-1, "")), (height, leaf))
    for sha, _, _, parent, _, _ in own:
        height, leaf = top[sha] = max(top.get(sha, (0, sha)), (0, sha))
        if parent is not None:
            top[parent] = max(top.get(parent, (-1, "")), (height + 1, leaf))
    repo = table.column("repo")[0].as_py()
    made = [[repo] * len(own), [r[0] for r in own], [top[r[0]][1] for r in own], [place[r[1]] + r[2] for r in own]]
    return pa.table([pa.array(x, k) for x, k in zip(made, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], ["repo", "sha", "chain", "pos"])


def fork_points(commits: DataFrame, branches: DataFrame, bases: DataFrame, created: DataFrame) -> DataFrame:
    """(repo, branch, method, ref, fork, distance): where each branch left the history it came from; nulls where nothing tells.

    ``commits`` has (repo, sha, parents); ``branches`` (repo, branch, sha, at), a tip and its
    time; ``bases`` (repo, branch, ref, sha, explicit), the base of a branch, one row at most;
    ``created`` (repo, branch, sha, ref, ref_sha), the oldest reflog entry of a branch and what
    it says the branch was made from, ``ref_sha`` null if that is no known commit.

    A branch has as candidates what its reflog tells, else its best common ancestors with all
    other branches that do not hold it, and those with its base; of a branch that the base has
    merged, those with the base's first parent before the merge. A default branch and one with
    an explicit base have the base alone. The candidate with the fewest commits after it wins,
    a tip itself only if it is alone; ties go by method, then to the branch with the latest tip,
    then by name. Where two histories cross and have several best common ancestors, all are
    candidates. Tips outside ``commits`` have nulls. ``commits`` may have a number ``clock``, such
    as commit times (see ``ancestry.ordered``); results do not depend on it.
    """
    tables = _Tables(commits.sparkSession)
    places, links, across, known = _chains(commits, tables)
    key, place = ["repo", "branch"], ["repo", "chain", "pos"]
    clock = known.select("repo", "sha", "clock") if "clock" in commits.columns else None
    numbered = ordered(places, across, tables, clock)
    entries, firsts = fresh(numbered, links, tables)
    tips = branches.where("repo is not null and branch is not null").groupBy(*key).agg(F.max(F.struct("at", "sha")).alias("x")).select(*key, F.col("x.sha").alias("head"), F.col("x.at").alias("at"))
    tips = tables.keep(tips, "tips")
    others = tips.where(~F.col("branch").isin(*DEFAULT_NAMES))
    nodes = tour(numbered, across, entries, others, tables)
    held = tables.keep(entries.join(nodes.select("repo", "rank", "enter", "leave", "tip_enter", "tip_leave"), ["repo", "rank"]), "held")
    steps = tops(held).withColumn("kind", F.lit(0)).unionByName(crowds(held).withColumn("kind", F.lit(1)))
    steps = tables.keep(steps, "steps")
    reached = steps.where("kind = 0")

    at = lambda df, name, *more: df.join(nodes.select("repo", F.col("sha").alias(name), *more), ["repo", name])
    heads = at(tips, "head", "chain", "pos", "rank", "enter", F.col("n").alias("all")).withColumn("main", F.col("branch").isin(*DEFAULT_NAMES))
    heads = tables.keep(heads, "heads")
    there = lambda name: [F.col(c).alias(f"{name}_{c}") for c in ("chain", "pos", "rank", "enter")]
    base = at(bases.select(*key, "ref", F.col("sha").alias("base"), F.coalesce("explicit", F.lit(False)).alias("explicit")), "base", *there("base"))
    base = tables.keep(base, "bases")
    made = tables.keep(created.select(*key, F.col("sha").alias("oldest"), F.col("ref").alias("made_from"), "ref_sha").where("made_from is not null"), "made")
    free = tables.keep(heads.where("not main").join(base.where("explicit").select(*key), key, "left_anti"), "free")
    self = free.select(*key, F.struct("chain", "pos").alias("self"))

    # Whose additions hold a tip: they tell how many tips reach it, and which merge its base has it by.
    dealt, levels = _dealt(held, tables)
    bearers = tables.keep(holding(free.select("repo", "head", "chain", "pos").distinct(), dealt, levels).select("repo", "head", "rank", "enter", "leave", "tip_enter", "tip_leave"), "bearers")
    count = bearers.groupBy("repo", "head").agg(F.sum(F.col("tip_leave") - F.col("tip_enter")).alias("tips"))

    # The base; what the reflog names; of branches that the base has merged, the base's first
    # parent before the merge; other branches. What holds a tip holds all below it, so a commit
    # below is held by a branch that does not hold the tip if and only if more tips reach it.
    ask = lambda df, use, *more: df.select(*key, F.lit(use).alias("use"), *more)
    of_base = heads.join(base, key)
    named = at(made.where("ref_sha is not null and made_from <> 'HEAD'").join(free, key), "ref_sha", *there("ref"))
    merge = free.drop("rank").join(base, key).join(bearers.select("repo", "head", "rank", F.col("enter").alias("__in"), F.col("leave").alias("__out")), ["repo", "head"]).where("__in <= base_enter and base_enter < __out and __in <> enter")
    before = firsts.join(nodes.select("repo", F.col("rank").alias("first"), F.col("enter").alias("first_enter")), ["repo", "first"]).drop("first")
    merge = merge.join(before, ["repo", "rank"])
    walk = ["repo", "head", "kind", "at"]
    look = lambda kind, c: (F.col("ref"), F.lit(kind).alias("kind"), c.cast("long").alias("at"), F.col("head"), F.col("chain"), F.col("pos"))

    def meet(name, sha):  # The earlier of the two walks: what the later one is beyond it may be all the history.
        low = F.col(f"{name}_rank") < F.col("rank")
        earlier = lambda c, there: F.when(low, F.col(there)).otherwise(F.col(c)).alias(c)
        until = F.when(low, F.col("enter")).otherwise(F.col(f"{name}_enter")).alias("at")
        return F.col("ref"), F.lit(0).alias("kind"), until, earlier("head", sha), earlier("chain", f"{name}_chain"), earlier("pos", f"{name}_pos")

    asked = ask(of_base, "base", *meet("base", "base"))
    asked = asked.union(ask(named.withColumn("ref", F.col("made_from")), "named", *meet("ref", "ref_sha")))
    asked = asked.union(ask(merge, "merged", *look(0, F.col("first_enter"))))
    asked = asked.union(ask(free.join(count, ["repo", "head"]).withColumn("ref", F.lit(None).cast("string")), "others", *look(1, -F.col("tips") - 1)))
    asked = tables.keep(asked, "asked")
    border = borders(asked.select(*walk, "chain", "pos"), across, steps, walk, tables)
    border = tables.keep(border.join(nodes.select(*place, "enter", F.col("sha").alias("fork"), "n"), place), "borders")
    border = tables.keep(latest(border, reached, walk), "latest")
    hits = tables.keep(asked.select(*key, "use", "ref", *walk[1:]).join(border, walk), "hits")
    found = []

    def candidates(df: DataFrame, method, ref) -> None:
        found.append(df.select(*key, method.alias("method"), ref.alias("ref"), F.col("fork").alias("sha"), F.col("n").alias("below")))

    # A branch that lies in its base's history is its own common ancestor with it.
    candidates(hits.where("use = 'base'").join(base.select(*key, "explicit"), key), F.when(F.col("explicit"), "explicit").otherwise("default"), F.col("ref"))
    beyond = tables.keep(hits.where("use in ('named', 'merged')").join(self, key).where(F.struct("chain", "pos") != F.col("self")), "beyond")
    candidates(beyond.where("use = 'merged'"), F.lit("default"), F.col("ref"))

    # The reflog's oldest entry if the branch still holds it, and the fork from what it names.
    oldest = at(made.join(free.select(*key, F.col("enter").alias("at")), key), "oldest", "chain", "pos", F.col("sha").alias("fork"), "n").withColumn("kind", F.lit(0))
    oldest = as_of(oldest, reached, "top").where("pos <= top").select(*key, F.col("made_from").alias("ref"), "fork", "n")
    told = tables.keep(oldest.union(beyond.where("use = 'named'").select(*key, "ref", "fork", "n")), "told")
    candidates(told, F.lit("reflog"), F.col("ref"))

    # Of the other branches that hold a fork, the one with the latest tip.
    silent = hits.where("use = 'others'").join(told.select(*key).distinct(), key, "left_anti")
    silent = tables.keep(silent.select(*key, "head", "fork", "chain", "pos", "n"), "silent")
    late = (-F.unix_micros("at")).alias("late")
    by_tip = others.join(nodes.where("here > 0").select("repo", F.col("sha").alias("head"), "tip_enter"), ["repo", "head"])
    by_tip = by_tip.withColumn("tip", F.col("tip_enter") + F.row_number().over(Window.partitionBy("repo", "head").orderBy("branch")) - 1).select("repo", "tip", F.struct(late, F.col("branch").alias("ref")).alias("who"))
    first = _latest_between(silent, bearers, by_tip, dealt, levels, tables)
    candidates(silent.join(first, ["repo", "head", "fork"]), F.lit("ancestor-branch"), F.col("who.ref"))

    # How many commits come after a candidate: all of the tip's less all of its own.
    claims = reduce(DataFrame.union, found).join(heads.select(*key, "head", "all"), key)
    claims = claims.join(tips.select("repo", F.col("branch").alias("ref"), late), ["repo", "ref"], "left")
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in METHOD_RANK.items() for x in kv]), F.col("method"))
    order = F.struct((F.col("sha") == F.col("head")).alias("itself"), (F.col("all") - F.col("below")).alias("distance"), rank.alias("rank"), F.coalesce("late", F.lit(0)).alias("late"), "ref", "method", "sha")
    best = claims.groupBy(*key).agg(F.min(order).alias("x"))
    out = tips.select(*key).join(best, key, "left").select(*key, "x.method", "x.ref", F.col("x.sha").alias("fork"), "x.distance")
    result, _ = materialize(out, "fork-points")
    tables.drop()
    return result


def _dealt(held: DataFrame, tables: _Tables) -> tuple[DataFrame, list[int]]:
    """``held`` by the blocks of places that its rows are made of, and the levels of these."""
    cut = held.withColumn("__b", F.explode(blocks(F.col("low") + 1, F.col("high") + 1)))
    dealt = tables.keep(cut.select("repo", "chain", "__b.level", "__b.block", "rank", "enter", "leave", "tip_enter", "tip_leave"), "dealt")
    return dealt, sorted(r[0] for r in dealt.select("level").distinct().collect())


def _latest_between(silent: DataFrame, bearers: DataFrame, by_tip: DataFrame, dealt: DataFrame, levels: list[int], tables: _Tables) -> DataFrame:
    """(repo, head, fork, who): the least ``who`` of the tips that reach a fork and do not reach the head.

    Tips are numbered along the tour, so those that reach a commit are intervals, and those that
    reach a head lie in those of all below it; what is between them is cut into blocks.
    """
    pair = ["repo", "head", "fork"]
    asked = tables.keep(silent.select(*pair, "chain", "pos").distinct(), "pairs")
    some = lambda df: df.where("tip_enter < tip_leave")
    of_fork = some(holding(asked.select("repo", "fork", "chain", "pos").distinct(), dealt, levels)).select("repo", "fork", "tip_enter", "tip_leave")
    of_fork = asked.select(*pair).join(of_fork, ["repo", "fork"])
    of_head = asked.select(*pair).join(some(bearers).select("repo", "head", "tip_enter", "tip_leave"), ["repo", "head"])
    edges = lambda df, d: [df.select(*pair, F.col("tip_enter").alias("from"), F.lit(d).alias("d")), df.select(*pair, F.col("tip_leave").alias("from"), F.lit(-d).alias("d"))]
    ends = reduce(DataFrame.union, edges(of_fork, 1) + edges(of_head, -1)).groupBy(*pair, "from").agg(F.sum("d").alias("d")).where("d <> 0")
    along = Window.partitionBy(*pair).orderBy("from")
    gaps = ends.select(*pair, "from", F.sum("d").over(along).alias("in"), F.lead("from").over(along).alias("to")).where("in > 0")
    gaps = tables.keep(gaps.select(*pair, F.explode(blocks(F.col("from"), F.col("to"))).alias("b")).select(*pair, "b.level", "b.block"), "gaps")
    level = F.explode(F.array(*[F.lit(r[0]) for r in gaps.select("level").distinct().collect()]).cast("array<int>"))
    least = by_tip.withColumn("level", level).groupBy("repo", "level", F.call_function("shiftright", F.col("tip"), F.col("level")).alias("block")).agg(F.min("who").alias("who"))
    return tables.keep(gaps.join(least, ["repo", "level", "block"]).groupBy(*pair).agg(F.min("who").alias("who")), "first")
