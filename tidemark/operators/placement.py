"""Where work belongs: branch, worktree and repository of events, from evidence of several kinds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_join, interval_pairs, nearest_join
from tidemark.operators.carry import carry_last
from tidemark.session import drop_path, materialize

#: The confidence of a branch taken from a linked event is at most this; parents are followed so many levels.
LINK_CONFIDENCE = 0.8
#: How sure a branch is that a move tells, and one that owns a detached stretch.
MOVE_CONFIDENCE, OWNER_CONFIDENCE = 0.95, 0.6
PARENT_LEVELS = 8


def head_moves(reflog: DataFrame, branches: DataFrame) -> DataFrame:
    """(worktree, at, branch, detached, owner, renamed_from) from (worktree, at, seq, target, returning, renamed_from).

    ``branches`` has the local branch names of each worktree as (worktree, name); a target that
    is none of them is a detached head. Rows without a target tell nothing and are dropped, and
    so is a row that leaves head where it was. A detached head belongs to the branch that the
    next move returns to, else to the last branch before it, else to the first one after.
    """
    known = branches.select("worktree", F.col("name").alias("target"), F.lit(True).alias("__local")).distinct()
    states = reflog.where("target is not null").join(known, ["worktree", "target"], "left").select(
        "worktree", "at", "seq", F.when(F.col("__local"), F.col("target")).alias("branch"), F.col("__local").isNull().alias("detached"), F.coalesce("returning", F.lit(False)).alias("returning"), "renamed_from"
    )
    # A worktree's rows are dealt by days, and each look back or ahead is one carry over them.
    carried = lambda df, values, ahead=False: carry_last(df.withColumn("__tree", F.struct("worktree")), ["__tree"], F.struct("at", "seq"), values, before=True, stretch=_day("at"), ahead=ahead)
    state = F.struct("branch", "detached")
    moved = carried(states, {"__before": state}).where(F.col("__before").isNull() | ~state.eqNullSafe(F.col("__before")))
    # Once as a table: every carry reads its rows twice.
    moved, _ = materialize(moved.drop("__before", "__tree"), "head-moves")
    around = carried(carried(moved, {"__last": F.col("branch")}), {"__first": F.col("branch"), "__next": F.struct("returning", "branch")}, ahead=True)
    owner = F.when(F.col("detached"), F.coalesce(F.when(F.col("__next.returning"), F.col("__next.branch")), "__last", "__first"))
    return around.select("worktree", "at", "seq", "branch", "detached", owner.alias("owner"), "renamed_from")


def _day(at: str):
    """The stretch of time that rows of a key are dealt by; rows without a time stand before all."""
    return F.coalesce(F.floor(F.col(at).cast("timestamp").cast("double") / 86_400), F.lit(-(2**62)))


def follow_renames(moves: DataFrame, column: str = "branch") -> DataFrame:
    """Moves with the name their branch has now: each later rename of that name carries it on, until none does.

    The next rename of a name is carried back to the moves and renames before it; the links from
    rename to rename are doubled, so rounds are the logarithm of the longest chain.
    Renames at a move's own instant are later ones if their ``seq`` is higher.
    """
    spark = moves.sparkSession
    key = ["worktree", "__name"]
    told = moves.where("worktree is not null and renamed_from is not null and branch is not null")
    renames, _ = materialize(told.groupBy("worktree", F.col("renamed_from").alias("__name"), F.struct("at", "seq").alias("__when")).agg(F.min("branch").alias("__to")), "renames")

    def following(asking: DataFrame) -> DataFrame:
        """``asking`` (worktree, __name, __when, ...) with the first rename of the name after that."""
        step = F.struct("__when", "__to").alias("__step")
        both = renames.select(*key, "__when", step, F.lit(1).alias("__side")).unionByName(asking.withColumn("__side", F.lit(0)), allowMissingColumns=True)
        # Seen from the end, what asks stands before a rename of its own instant.
        found = carry_last(both, key, F.struct(F.col("__when"), (1 - F.col("__side")).alias("side")), {"__next": F.col("__step")}, before=True, stretch=_day("__when.at"), ahead=True)
        return found.where("__side = 0").drop("__side", "__step")

    links = following(renames.select("worktree", F.col("__to").alias("__name"), "__when", F.col("__name").alias("__from")))
    state, path = materialize(links.select("worktree", F.col("__from").alias("__name"), "__when", F.col("__name").alias("__to"), F.col("__next.__when").alias("__jump")), "rename-links")
    while not state.where("__jump is not null").isEmpty():
        above = state.select("worktree", F.col("__name").alias("__to"), F.col("__when").alias("__jump"), F.col("__to").alias("__last"), F.col("__jump").alias("__more"))
        jumping = state.where("__jump is not null").join(above, ["worktree", "__to", "__jump"])
        doubled = jumping.select("worktree", "__name", "__when", F.col("__last").alias("__to"), F.col("__more").alias("__jump")).union(state.where("__jump is null"))
        following_state, next_path = materialize(doubled, "rename-links")
        drop_path(spark, path)
        state, path = following_state, next_path
    first = following(moves.select("worktree", F.col(column).alias("__name"), F.struct("at", "seq").alias("__when"), F.struct(*moves.columns).alias("__move")))
    ends = state.select("worktree", "__name", F.col("__when").alias("__first"), F.col("__to").alias("__now"))
    named = first.withColumn("__first", F.col("__next.__when")).join(ends, [*key, "__first"], "left").select("__move.*", "__now")
    return named.withColumn(column, F.coalesce("__now", column)).select(*moves.columns)


def merge_histories(stored: DataFrame, live: DataFrame) -> DataFrame:
    """(worktree, incarnation, at, branch): one timeline per worktree from its stored moves and its reflog.

    ``stored`` has (worktree, incarnation, at, branch), ``live`` (worktree, at, branch). A path
    that was made anew is another incarnation; each begins with its first move and tells up to
    where the next one does, and none beyond where the live reflog begins. Live moves have no
    incarnation. Of stored moves of one incarnation and instant the least branch counts.
    """
    live_from = live.groupBy("worktree").agg(F.min("at").alias("__live"))
    begins = stored.groupBy("worktree", "incarnation").agg(F.min("at").alias("__start")).join(live_from, "worktree", "left").where("__live IS NULL OR __start < __live")
    following = F.lead("__start").over(Window.partitionBy("worktree").orderBy("__start", "incarnation"))
    until = begins.select("worktree", "incarnation", F.least(following, F.col("__live")).alias("__until"))
    older = stored.join(until, ["worktree", "incarnation"]).where("__until IS NULL OR at < __until")
    kept = older.groupBy("worktree", "incarnation", "at").agg(F.min("branch").alias("branch"))
    none = F.lit(None).cast(stored.schema["incarnation"].dataType).alias("incarnation")
    return kept.unionByName(live.groupBy("worktree", "at").agg(F.min("branch").alias("branch")).select("worktree", none, "at", "branch"))


def branch_at(probes: DataFrame, moves: DataFrame, current: DataFrame) -> DataFrame:
    """Probes (worktree, ts, ...) with the branch that was checked out, by what method and how sure.

    ``moves`` has (worktree, at, branch) and may have (detached, owner, seq): a detached head
    belongs to its owner, which is less sure, or to no branch. Without any move of the
    worktree, its current branch counts from ``since`` on; ``current`` has one row a worktree:
    (worktree, current_branch, since).
    """
    if "detached" not in moves.columns:
        moves = moves.withColumn("detached", F.lit(False)).withColumn("owner", F.lit(None).cast(moves.schema["branch"].dataType))
    told = F.struct(F.col("branch").alias("branch"), F.coalesce("detached", F.lit(False)).alias("detached"), F.col("owner").alias("owner"))
    found = asof_join(probes, moves.withColumn("__told", told), ["worktree"], "ts", "at", ["__told"], ["seq"] if "seq" in moves.columns else None)
    having = moves.select("worktree").distinct().withColumn("__moved", F.lit(True))
    joined = found.join(current, "worktree", "left").join(having, "worktree", "left")
    fallback = F.when(F.col("__moved").isNull() & (F.col("ts") >= F.col("since")), F.col("current_branch"))
    loose = F.coalesce("__told.detached", F.lit(False))
    branch = F.when(loose, F.col("__told.owner")).otherwise(F.coalesce("__told.branch", fallback))
    method = F.when(loose & branch.isNotNull(), "owner").when(~loose & F.col("__told.branch").isNotNull(), "move").when(~loose & fallback.isNotNull(), "current")
    sure = F.when(method == "owner", OWNER_CONFIDENCE).when(method == "move", MOVE_CONFIDENCE)
    return joined.select(*probes.columns, branch.alias("branch"), method.alias("method"), sure.alias("confidence"))


def scored_commits(events: DataFrame, commits: DataFrame) -> DataFrame:
    """(event_id, branch, confidence) of events whose commit is on exactly one branch."""
    only = commits.groupBy("sha").agg(F.min("branch").alias("branch"), F.max("branch").alias("__high")).where("branch = __high").select("sha", "branch")
    return events.where("sha is not null").join(only, "sha").select("event_id", "branch", F.lit(0.9).alias("confidence"))


def first_rule(candidates: dict[str, DataFrame]) -> DataFrame:
    """(event_id, branch, confidence, method): what the first rule that finds anything says, in the order given.

    All rules' rows meet in one aggregation, so a rule more is no join more.
    """
    rows = [c.where("branch is not null").select("event_id", F.lit(i).alias("rule"), F.lit(name).alias("method"), "branch", "confidence") for i, (name, c) in enumerate(candidates.items())]
    best = F.min(F.struct("rule", (-F.col("confidence")).alias("less"), "branch", "method", "confidence")).alias("best")
    return reduce(DataFrame.unionByName, rows).groupBy("event_id").agg(best).select("event_id", "best.branch", "best.confidence", "best.method")


def by_links(events: DataFrame, found: DataFrame) -> DataFrame:
    """Events (event_id, session, request, ts) with ``found`` and, where it has nothing, a linked event's branch.

    First the surest branch of the same request, then that of the nearest event of the session.
    """
    found, _ = materialize(found, "found-branches")
    placed = events.join(found, "event_id")
    per_request = placed.where("request is not null").groupBy("request").agg(F.min(F.struct((-F.col("confidence")).alias("less"), "branch")).alias("__r"))
    open_events = events.join(found.select("event_id"), "event_id", "left_anti").join(per_request, "request", "left")
    at_request = open_events.where("__r is not null").select("event_id", F.col("__r.branch").alias("branch"), F.least(-F.col("__r.less"), F.lit(LINK_CONFIDENCE)).alias("confidence"), F.lit("request").alias("method"))
    rest = open_events.where("__r is null and session is not null").select("event_id", "session", "ts")
    near = nearest_join(rest, placed.where("session is not null").select("session", F.col("ts").alias("at"), "branch", "confidence", "event_id"), ["session"], "ts", "at", ["branch", "confidence"], 10**9, ["event_id"])
    at_session = near.where("branch is not null").select("event_id", "branch", F.least("confidence", F.lit(LINK_CONFIDENCE)).alias("confidence"), F.lit("session").alias("method"))
    return found.unionByName(at_request).unionByName(at_session)


def single_place(places: DataFrame, by: str) -> DataFrame:
    """(by, repo, worktree) where all places of a key are in one repository; the worktree only if that is one too."""
    one = places.where("repo is not null").groupBy(by).agg(F.min("repo").alias("repo"), F.max("repo").alias("__high"), F.min("worktree").alias("worktree"), F.max("worktree").alias("__w"), F.count_if(F.col("worktree").isNull()).alias("__none"))
    return one.where("repo = __high").select(by, "repo", F.when((F.col("worktree") == F.col("__w")) & (F.col("__none") == 0), F.col("worktree")).alias("worktree"))


def attribute_repos(events: DataFrame, touched: DataFrame, levels: int = PARENT_LEVELS) -> DataFrame:
    """(event_id, repo, worktree, method) from events (event_id, ts, self, parent, turn, repo, worktree).

    An event's own place comes first. Then that of its turn: the own places of all the turn's
    events and those of the paths it touched, (turn, repo, worktree), if they are together in
    one repository. Then the place of the nearest event of its parent, level by level. Events
    that none of it places have no repository. With a column ``kept``, events it is true for
    stay where their source put them: they get no place here and give none.
    """
    kept = F.coalesce("kept", F.lit(False)) if "kept" in events.columns else F.lit(False)
    open_events = events.where(~kept)
    pooled = touched.select("turn", "repo", "worktree").unionByName(open_events.where("repo is not null").select("turn", "repo", "worktree"))
    by_turn = single_place(pooled, "turn").select("turn", F.col("repo").alias("__repo"), F.col("worktree").alias("__tree"))
    first = open_events.join(by_turn, "turn", "left")
    method = F.when(F.col("repo").isNotNull(), "own").when(F.col("__repo").isNotNull(), "paths")
    place = F.when(F.col("repo").isNotNull(), F.struct("repo", "worktree")).when(F.col("__repo").isNotNull(), F.struct(F.col("__repo").alias("repo"), F.col("__tree").alias("worktree")))
    state, _ = materialize(first.select("event_id", "ts", "self", "parent", place.alias("place"), method.alias("method")), "places")
    for _ in range(levels):
        placed = state.where("place is not null and self is not null").select(F.col("self").alias("parent"), F.col("ts").alias("at"), "event_id", F.col("place").alias("found"))
        asked = state.where("place is null and parent is not null").select("event_id", "ts", "parent")
        near, _ = materialize(nearest_join(asked, placed, ["parent"], "ts", "at", ["found"], 10**9, ["event_id"]).where("found is not null").select("event_id", "found"), "parents")
        if near.isEmpty():
            break
        state, _ = materialize(
            state.join(near, "event_id", "left")
            .select("event_id", "ts", "self", "parent", F.coalesce("place", "found").alias("place"), F.when(F.col("place").isNotNull(), F.col("method")).when(F.col("found").isNotNull(), "parent").alias("method")),
            "places",
        )
    none = F.lit(None)
    stays = events.where(kept).select("event_id", none.cast(events.schema["repo"].dataType).alias("repo"), none.cast(events.schema["worktree"].dataType).alias("worktree"), F.lit("kept").alias("method"))
    return state.select("event_id", "place.repo", "place.worktree", F.coalesce("method", F.lit("none")).alias("method")).unionByName(stays)


def subagent_shares(turns: DataFrame, children: DataFrame) -> DataFrame:
    """(turn, place, weight): how a turn's usage splits over the places its subagents worked in.

    ``turns`` has (turn, self, start, end), ``children`` (parent, ts, place, tokens). The
    children inside the turn's span count, or all of the parent's where none is inside. Weights
    are shares of their tokens, or of their number where they have no tokens.
    """
    placed = children.where("place is not null").select(F.col("parent").alias("self"), "ts", "place", F.coalesce("tokens", F.lit(0)).alias("tokens"))
    sums = (F.count("*").alias("n"), F.sum("tokens").alias("t"))
    # Only pairs inside a span are made; a parent's children as a whole are summed before any turn meets them.
    inside, _ = materialize(interval_pairs(placed, turns.select("self", "turn", "start", "end"), ["self"], "ts", "start", "end").groupBy("turn", "place").agg(*sums), "turn-children")
    whole = turns.select("self", "turn").join(inside.select("turn").distinct(), "turn", "left_anti").join(placed.groupBy("self", "place").agg(*sums), "self").select("turn", "place", "n", "t")
    counted = inside.unionByName(whole)
    total = Window.partitionBy("turn")
    weight = F.when(F.sum("t").over(total) > 0, F.col("t") / F.sum("t").over(total)).otherwise(F.col("n") / F.sum("n").over(total))
    return counted.withColumn("weight", weight).where("weight > 0").select("turn", "place", "weight")


def split_usage(usage: DataFrame, shares: DataFrame, by: str, amounts: list[str]) -> DataFrame:
    """One row per share with the amounts scaled, and an id ``#split:i/n`` in order of place; rows without shares stay whole."""
    numbered = shares.select(by, "place", "weight", F.row_number().over(Window.partitionBy(by).orderBy("place")).alias("__i"), F.count("*").over(Window.partitionBy(by)).alias("__n"))
    joined = usage.join(numbered, by, "left")
    name = F.when(F.col("__n") > 1, F.concat(F.col("event_id").cast("string"), F.lit("#split:"), (F.col("__i") - 1).cast("string"), F.lit("/"), F.col("__n").cast("string"))).otherwise(F.col("event_id").cast("string"))
    scaled = [(F.col(a) * F.coalesce("weight", F.lit(1.0))).alias(a) for a in amounts]
    return joined.select(name.alias("share_id"), "event_id", "place", *scaled)


def place_same_chat(events: DataFrame) -> DataFrame:
    """Events (event_id, session, worktree): one without a worktree takes that of its chat, if the chat has exactly one."""
    only = events.where("worktree is not null and session is not null").groupBy("session").agg(F.min("worktree").alias("__tree"), F.max("worktree").alias("__high")).where("__tree = __high").select("session", "__tree")
    return events.join(only, "session", "left").select("event_id", F.coalesce("worktree", "__tree").alias("worktree"), F.when(F.col("worktree").isNotNull(), "own").when(F.col("__tree").isNotNull(), "chat").alias("method"))


def session_weights(children: DataFrame) -> DataFrame:
    """(session, worktree, weight): an orchestrator's usage over its children's worktrees by their tokens, rows without a worktree apart."""
    sums = children.where("worktree is not null").groupBy("session", "worktree").agg(F.sum(F.coalesce("tokens", F.lit(0))).alias("t"), F.count("*").alias("n"))
    total = Window.partitionBy("session")
    weight = F.when(F.sum("t").over(total) > 0, F.col("t") / F.sum("t").over(total)).otherwise(F.col("n") / F.sum("n").over(total))
    return sums.withColumn("weight", weight).where("weight > 0").select("session", "worktree", "weight")
