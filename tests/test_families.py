"""Facts refreshed by family: only what a changed history can touch is derived, and the result is that of everything."""

import random
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators.asof import asof_join
from tidemark.session import new_path
from tidemark.streaming import families

START = datetime(2024, 1, 1, tzinfo=UTC)
EVENT, MOVE = "session string, worktree string, ts timestamp, tokens long", "worktree string, at timestamp, branch string, seq long"
FACT = "session string, branch string, tokens long"


def hours(n):
    return START + timedelta(hours=n)


def derive_with(moves):
    def derive(events):
        placed = asof_join(events, moves, ["worktree"], "ts", "at", ["branch"], ["seq"])
        return placed.groupBy("session", "branch").agg(F.sum("tokens").alias("tokens"))

    return derive


def facts(df):
    return sorted(map(tuple, df.collect()), key=str)


def differing(before, after):
    """Hour by hour, for each worktree: where the two histories say different things."""
    def said(moves, tree, t):
        known = [(at, seq, b) for w, at, b, seq in moves if w == tree and at <= t]
        return max(known, key=lambda x: x[:2])[2] if known else None

    return {(w, n) for w in {m[0] for m in [*before, *after]} for n in range(-1, 130) if said(before, w, hours(n)) != said(after, w, hours(n))}


def test_stretches_that_changed(spark):
    rng = random.Random(2)
    move = lambda i: (f"w{rng.randrange(6)}", hours(rng.randrange(120)), rng.choice("abc"), i)
    before = [move(i) for i in range(60)]
    after = [m for m in before if rng.random() < 0.8] + [move(100 + i) for i in range(10)]
    got = families.changed_stretches(spark.createDataFrame(before, MOVE), spark.createDataFrame(after, MOVE), ["worktree"], "at", "branch", ["seq"]).collect()
    naive = lambda t: t.replace(tzinfo=UTC) if t.year < 9999 else hours(10**5)
    hit = {(r.worktree, n) for r in got for n in range(-1, 130) if naive(r.start) <= hours(n) < naive(r.end)}
    assert hit == differing(before, after) and hit
    same = spark.createDataFrame(before, MOVE)
    assert families.changed_stretches(same, same, ["worktree"], "at", "branch", ["seq"]).count() == 0


def test_a_new_history_derives_only_what_it_touches(spark):
    rng = random.Random(5)
    events = [(f"s{rng.randrange(40)}", f"w{rng.randrange(6)}", hours(rng.randrange(120)), rng.randrange(9)) for _ in range(600)]
    events = [(s, f"w{int(s[1:]) % 6}", t, n) for s, _, t, n in events]
    before = [(f"w{w}", hours(h), f"b{h % 3}", i) for i, (w, h) in enumerate((w, h) for w in range(6) for h in range(0, 120, 20))]
    # One worktree has another branch for a few hours, one has a move that says nothing new.
    after = [*before, ("w2", hours(30), "other", 100), ("w2", hours(33), "b2", 101), ("w3", hours(25), "b2", 102)]
    ev, old, new = spark.createDataFrame(events, EVENT), spark.createDataFrame(before, MOVE), spark.createDataFrame(after, MOVE)
    log = families.FactLog(spark, new_path(spark, "facts"), FACT, ["session"])
    assert log.read().count() == 0
    assert log.refresh(ev, ev.select("session"), derive_with(old)) == len({e[0] for e in events})
    assert facts(log.read()) == facts(derive_with(old)(ev))
    changed = families.changed_stretches(old, new, ["worktree"], "at", "branch", ["seq"])
    touched = families.affected_families(ev, changed, ["worktree"], "ts", ["session"])
    stretches = differing(before, after)
    want = {s for s, w, t, _ in events if (w, (t - START).total_seconds() // 3600) in stretches}
    assert {r.session for r in touched.collect()} == want and 0 < len(want) < 10
    assert log.refresh(ev, touched, derive_with(new)) == len(want)
    assert facts(log.read()) == facts(derive_with(new)(ev))
    # The last version holds the facts of those families alone.
    assert {r.session for r in spark.read.parquet(f"{log.path}/facts/version=2").collect()} <= want
    packed = log.compact(new_path(spark, "facts"))
    assert facts(packed.read()) == facts(log.read()) and packed.latest() == 1


def test_a_refresh_that_is_cut_off_changes_nothing(spark):
    log = families.FactLog(spark, new_path(spark, "facts"), FACT, ["session"])
    one = spark.createDataFrame([("s", "b", 1), ("t", "b", 2)], FACT)
    log.write(one, one)
    two = spark.createDataFrame([("s", "c", 9)], FACT)
    two.write.parquet(f"{log.path}/facts/version=2")  # the facts were written, their index was not
    assert facts(log.read()) == facts(one)
    log.write(two.limit(0), two)  # a family that has no facts any more
    assert facts(log.read()) == [("t", "b", 2)]
