"""The attribution ladder against a plain walk over the events, and rows that none of it should trip over."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import folds, ledgers, placement, selection
from tidemark.plans.base import events
from tidemark.plans.placement import ladder_tables

SF = "/root/testdata/sf0.001"


def ladder_brute(rows, touched, levels=8):
    by_turn = {}
    for t in touched:
        by_turn.setdefault(t.turn, []).append((t.repo, t.worktree))
    for r in rows:
        if r.repo is not None:
            by_turn.setdefault(r.turn, []).append((r.repo, r.worktree))
    place, method = {}, {}
    for r in rows:
        places = by_turn.get(r.turn, [])
        if r.repo is not None:
            place[r.event_id], method[r.event_id] = (r.repo, r.worktree), "own"
        elif places and len({p for p, _ in places}) == 1:
            trees = {w for _, w in places}
            place[r.event_id], method[r.event_id] = (places[0][0], places[0][1] if len(trees) == 1 else None), "paths"
    for _ in range(levels):
        found = {}
        for r in rows:
            if r.event_id in place or r.parent is None:
                continue
            kin = [x for x in rows if x.self == r.parent and x.event_id in place]
            before = [x for x in kin if x.ts <= r.ts]
            after = [x for x in kin if x.ts >= r.ts]
            b = max(before, key=lambda x: (x.ts, x.event_id), default=None)
            a = min(after, key=lambda x: (x.ts, x.event_id), default=None)
            if b is not None and (a is None or r.ts - b.ts <= a.ts - r.ts):
                found[r.event_id] = place[b.event_id]
            elif a is not None:
                found[r.event_id] = place[a.event_id]
        if not found:
            break
        place.update(found)
        method.update(dict.fromkeys(found, "parent"))
    return {(r.event_id, *(place.get(r.event_id) or (None, None)), method.get(r.event_id, "none")) for r in rows}


def test_the_ladder_is_the_plain_walk(spark):
    rows, touched = ladder_tables(events(spark, SF))
    rows = rows.where("event_id < 600")
    got = {tuple(r) for r in placement.attribute_repos(rows, touched).collect()}
    assert got == ladder_brute(rows.collect(), touched.collect())
    assert len({m for *_, m in got}) >= 3


def test_a_turn_pools_its_events_places_with_touched_paths(spark):
    rows = [(1, None, "a", None, 1, "r1", "w1"), (2, None, "a", None, 1, None, None), (3, None, "a", None, 2, "r1", "w1"), (4, None, "a", None, 2, None, None), (5, None, "a", None, 3, "r1", "w1"), (6, None, "a", None, 3, "r1", "w2"), (7, None, "a", None, 3, None, None)]
    events_ = spark.createDataFrame(rows, "event_id long, ts timestamp, self string, parent string, turn long, repo string, worktree string")
    touched = spark.createDataFrame([(2, "r2", "w9")], "turn long, repo string, worktree string")
    got = {r.event_id: tuple(r)[1:] for r in placement.attribute_repos(events_, touched).collect()}
    assert got[2] == ("r1", "w1", "paths")  # where the turn's other event was
    assert got[4] == (None, None, "none")  # two repositories
    assert got[7] == ("r1", None, "paths")  # one repository, two worktrees
    stays = placement.attribute_repos(events_.selectExpr("*", "event_id IN (1, 2) AS kept"), touched).collect()
    assert {r.event_id for r in stays if r.method == "kept"} == {1, 2} and len(stays) == 7


def test_histories_keep_all_incarnations(spark):
    """Each tells up to the start of the next, and none beyond where the live reflog begins."""
    stored = spark.createDataFrame([("w", 1, 10, "a"), ("w", 1, 30, "late"), ("w", 2, 20, "b"), ("w", 2, 25, "c"), ("w", 2, 60, "beyond"), ("w", 3, 55, "unseen"), ("x", 1, 5, "only")], "worktree string, incarnation long, at long, branch string")
    live = spark.createDataFrame([("w", 50, "live"), ("w", 50, "zlive"), ("y", 1, "new")], "worktree string, at long, branch string")
    got = sorted(map(tuple, placement.merge_histories(stored, live).collect()), key=str)
    assert got == sorted([("w", 1, 10, "a"), ("w", 2, 20, "b"), ("w", 2, 25, "c"), ("w", None, 50, "live"), ("x", 1, 5, "only"), ("y", None, 1, "new")], key=str)


def test_empty_tables_and_nulls(spark):
    none = lambda s: spark.createDataFrame([], s)
    reflog = none("worktree string, at timestamp, seq long, target string, returning boolean, renamed_from string")
    assert placement.follow_renames(placement.head_moves(reflog, none("worktree string, name string"))).count() == 0
    rows = spark.createDataFrame([(1, None, None, None, None, None, None)], "event_id long, ts timestamp, self long, parent long, turn long, repo string, worktree string")
    assert [tuple(r) for r in placement.attribute_repos(rows, none("turn long, repo string, worktree string")).collect()] == [(1, None, None, "none")]
    assert placement.subagent_shares(none("turn long, self long, start timestamp, end timestamp"), none("parent long, ts timestamp, place string, tokens long")).count() == 0
    facts = spark.createDataFrame([(1, None, 2.0), (2, "s", 3.0)], "id long, session string, figure double")
    assert {r.id: r.figure for r in ledgers.without_ledgered_figures(facts, facts.where("session = 's'"), "session", "figure").collect()} == {1: 2.0, 2: None}
    assert folds.entry_owners(none("file string, entry string, seq long"), none("file string, parent string")).count() == 0


def test_renames_are_followed_to_the_end(spark):
    rows = [("w", 1, 1, "a", None), ("w", 2, 2, "b", "a"), ("w", 3, 3, "c", "b"), ("w", 4, 4, "a", None), ("v", 1, 5, "a", None)]
    moves = spark.createDataFrame(rows, "worktree string, at long, seq long, branch string, renamed_from string")
    got = {(r.worktree, r.seq): r.branch for r in placement.follow_renames(moves).collect()}
    assert got == {("w", 1): "c", ("w", 2): "c", ("w", 3): "c", ("w", 4): "a", ("v", 5): "a"}


def test_digest_does_not_depend_on_the_order_of_columns(spark):
    t = spark.createDataFrame([(1, "x", None), (1, None, "x")], "b long, a string, c string")
    both = t.select(selection.content_digest("a", "b", "c").alias("x"), selection.content_digest("c", "a", "b").alias("y")).collect()
    assert all(r.x == r.y for r in both) and both[0].x != both[1].x
    assert t.where(selection.usage_bearing(F.lit("ai.session"), F.col("b"))).count() == 0


def test_heads_are_carried_over_days(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["w", "v", None]), datetime(2024, 1, 1) + timedelta(hours=rng.randrange(24 * 9)), i, rng.choice(["a", "b", "c", "x1", "x2"]), rng.random() < 0.3, None) for i in range(120)]
    names = [(w, n) for w in ("w", "v") for n in "abc"]
    got = placement.head_moves(spark.createDataFrame(rows, "worktree string, at timestamp, seq long, target string, returning boolean, renamed_from string"), spark.createDataFrame(names, "worktree string, name string"))
    want = []
    for tree in ("w", "v", None):
        states = [(t if (w, t) in names else None, (w, t) not in names, back, s) for w, _, s, t, back, _ in sorted((r for r in rows if r[0] == tree), key=lambda r: (r[1], r[2]))]
        moved = [m for i, m in enumerate(states) if i == 0 or states[i - 1][:2] != m[:2]]
        for i, (branch, detached, _, seq) in enumerate(moved):
            following, known = moved[i + 1 : i + 2], lambda part: [m[0] for m in part if m[0]]
            owner = (following and following[0][2] and following[0][0]) or next(iter(known(reversed(moved[:i]))), None) or next(iter(known(moved[i + 1 :])), None)
            want.append((tree, seq, branch, detached, owner if detached else None))
    assert sorted(map(tuple, got.select("worktree", "seq", "branch", "detached", "owner").collect()), key=str) == sorted(want, key=str)
    assert "unboundedfollowing" not in got._jdf.queryExecution().toString().lower()


def test_rounds_of_renames_are_the_logarithm_of_the_chain(spark, monkeypatch):
    n, rounds = 200, []
    rows = [("w", i, i, f"n{i}", f"n{i - 1}" if i else None) for i in range(n)] + [("v", 0, n, "n3", None)]
    moves = spark.createDataFrame(rows, "worktree string, at long, seq long, branch string, renamed_from string")
    keep = placement.materialize
    monkeypatch.setattr(placement, "materialize", lambda df, name: rounds.append(name) or keep(df, name))
    assert {r.seq: r.branch for r in placement.follow_renames(moves).collect()} == {i: f"n{n - 1}" for i in range(n)} | {n: "n3"}
    assert len(rounds) < 15
