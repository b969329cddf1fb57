"""Session logs folded by carries, against one walk of each session's rows."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import rollout
from tidemark.operators.carry import carry_last, carry_sum

COLUMNS = [c.split()[0] for c in rollout.ROW.split(", ")]


def row(session, seq, kind, **fields):
    return tuple({"session": session, "seq": seq, "kind": kind, **fields}.get(c) for c in COLUMNS)


def walk(rows):
    """The same results, row by row."""
    requests, turns = [], []
    for session in sorted({r[0] for r in rows}):
        log = sorted((dict(zip(COLUMNS, r, strict=True)) for r in rows if r[0] == session), key=lambda r: r["seq"])
        head, replaying, current, record_seen, last_total = None, False, None, False, None
        settings = dict.fromkeys(rollout.FACTS)
        facts = dict.fromkeys(rollout.FACTS)
        open_turns, ended, seen_keys, seen_counts, tools, searches, out = {}, {}, set(), set(), 0, 0, []

        def end(turn, status, at=None):
            ended[turn["turn"]] = turn | {"status": status, "completed_at": at}
            del open_turns[turn["turn"]]

        def enter(r, turn):
            nonlocal current, replaying
            current = turn
            own = head is None or head["born"] is None or (r["born"] is not None and r["born"] >= head["born"])
            if r["turn"] is not None and own:
                replaying = False

        def opened(turn, at):
            if turn in ended:
                return None
            if turn not in open_turns:
                cwd = facts["cwd"] if facts["cwd"] is not None else head and head["cwd"]
                either = {c: settings[c] if settings[c] is not None else facts[c] for c in ("effort", "model")}
                open_turns[turn] = {"turn": turn, "started_at": at, "requests": 0, "tool_calls": 0, "facts": {"cwd": cwd, **either, "provider": settings["provider"], "tier": settings["tier"]}}
            return open_turns[turn]

        def push(r, key, source, turn):
            nonlocal tools, searches
            t = open_turns.get(turn)
            if t:
                t["requests"] += 1
            out.append({"session": session, "seq": r["seq"], "at": r["at"], "key": key, "source": source, "turn": turn, "spent": r["spent"], "tool_calls": tools, "searches": searches, "facts": dict(t["facts"] if t else facts)})
            tools = searches = 0

        for r in log:
            kind, turn = r["kind"], r["turn"]
            if kind == "head" and head is None:
                head, replaying = r, bool(r["forked"])
                if r["provider"] is not None:
                    settings["provider"] = r["provider"]
                facts |= {"cwd": r["cwd"] if r["cwd"] is not None else facts["cwd"], "provider": r["provider"]}
            elif kind == "settings" and (r["thread"] is None or head is None or r["thread"] == head["thread"]):
                settings |= {c: r[c] for c in ("model", "effort", "provider", "tier") if r[c] is not None}
            elif kind == "context" and (turn or current):
                turn = turn or current
                enter(r, turn)
                if not replaying:
                    first = lambda *x: next((v for v in x if v is not None), None)
                    facts = {"cwd": first(r["cwd"], facts["cwd"]), "provider": settings["provider"], "tier": settings["tier"]} | {c: first(r[c], settings[c], facts[c]) for c in ("effort", "model")}
                    if t := opened(turn, r["at"]):
                        t["facts"] = facts
            elif kind == "started" and turn:
                enter(r, turn)
                if not replaying:
                    for t in list(open_turns.values()):
                        if t["turn"] != turn:
                            end(t, "unfinished")
                    tools = searches = 0
                    opened(turn, r["at"])
            elif kind in rollout.ENDS and not replaying:
                turn = turn or (current if kind == "aborted" else None)
                if turn in open_turns:
                    end(open_turns[turn], kind, r["at"])
            elif kind == "tool" and not replaying and current is not None:
                if current in open_turns:
                    open_turns[current]["tool_calls"] += 1
                tools, searches = tools + 1, searches + bool(r["search"])
            elif kind == "record" and head is not None and r["thread"] == head["thread"]:
                key = r["key"] or f"ord-{r['seq']}"
                if key not in seen_keys:
                    seen_keys.add(key)
                    record_seen, replaying = True, False
                    if r["spent"] and r["spent"] > 0:
                        push(r, key, "record", turn or current)
            elif kind == "count" and r["spent"] is not None:
                key = f"ord-{r['seq']}" if r["total"] is None else r["signature"]
                again = (r["total"] is not None and r["total"] == last_total) or key in seen_counts
                last_total = r["total"] if r["total"] is not None else last_total
                seen_counts.add(key)
                if not (replaying or record_seen or again) and r["spent"] > 0:
                    push(r, f"tc-{key}", "count", current)
        for t in list(open_turns.values()):
            ended[t["turn"]] = t | {"status": "open", "completed_at": None}
        for q in out:
            t = ended.get(q["turn"])
            chosen = t["facts"] if q["facts"]["model"] is None and t else q.pop("facts")
            requests.append((session, q["seq"], q["at"], q["key"], q["source"], q["turn"], q["spent"], q["tool_calls"], q["searches"], *[chosen[c] for c in rollout.FACTS]))
        turns += [(session, t["turn"], t["started_at"], t["completed_at"], t["status"], t["requests"], t["tool_calls"]) for t in ended.values()]
    return requests, turns


def both(spark, rows, size=1 << 16):
    got = rollout.fold_sessions(spark.createDataFrame(rows, rollout.ROW), size)
    key = lambda r: tuple(map(str, r))
    return [sorted(map(tuple, df.collect()), key=key) for df in got], [sorted(x, key=key) for x in walk(rows)]


def made(rng, session, n):
    """A log of rows of all kinds, with parent history, foreign threads, repeats and gaps."""
    pick = lambda *x: rng.choice(x)
    maybe = lambda x: x if rng.random() < 0.6 else None
    rows = [row(session, 3, "head", thread="me", born=pick(None, 10), forked=rng.random() < 0.6, cwd=maybe("/home"), provider=maybe("p0"))]
    for i in range(n):
        t = rng.randrange(16)
        turn, born = f"t{t}", t
        kind = pick("settings", "started", "context", "completed", "failed", "aborted", "tool", "tool", "record", "record", "count", "count", "head")
        fields = {
            "settings": lambda: {"thread": pick(None, "me", "other"), "model": maybe(f"m{i}"), "effort": maybe(f"e{i}"), "provider": maybe(f"p{i}"), "tier": maybe(f"s{i}")},
            "started": lambda: {"turn": turn, "born": born}, "context": lambda: {"turn": maybe(turn), "born": born, "cwd": maybe(f"/c{i}"), "model": maybe(f"x{i}"), "effort": maybe(f"y{i}")},
            "completed": lambda: {"turn": maybe(turn)}, "failed": lambda: {"turn": turn}, "aborted": lambda: {"turn": maybe(turn)},
            "tool": lambda: {"search": pick(None, True, False)}, "record": lambda: {"thread": pick("me", "me", "other", None), "key": pick(None, f"k{i % 25}"), "turn": maybe(turn), "spent": pick(0, None, i + 1)},
            "count": lambda: {"total": pick(None, 100 + i // 3), "signature": f"s{i % 7}", "spent": pick(0, None, 7)}, "head": lambda: {"thread": "late", "forked": True},
        }[kind]()
        rows.append(row(session, 2 * i + (0 if rng.random() < 0.5 and i < 1 else 4), kind, **fields))
    return rows


def test_fold_equals_the_walk_on_many_sessions(spark):
    rng = random.Random(7)
    rows = [r for s in range(150) for r in made(rng, f"s{s:03}", rng.choice([1, 5, 20, 60]))]
    rows += [row("headless", i, k, turn="t", thread="me", spent=3, model="m") for i, k in enumerate(["started", "context", "record", "count", "tool", "completed"])]
    for size in (1 << 16, 16):
        (requests, turns), (want_requests, want_turns) = both(spark, rows, size)
        assert requests == want_requests and len(requests) > 80
        assert turns == want_turns and {t[4] for t in turns} == {"completed", "failed", "aborted", "unfinished", "open"}


def test_a_replayed_prefix_gives_nothing(spark):
    """A forked file repeats its parent's turns and counters up to its first own turn."""
    rows = [
        row("s", 0, "head", thread="me", born=10, forked=True), row("s", 1, "started", turn="parent", born=5), row("s", 2, "count", total=1000, signature="a", spent=1000),
        row("s", 3, "started", turn="unborn"), row("s", 4, "count", total=2000, signature="b", spent=1000), row("s", 5, "started", turn="own", born=11),
        row("s", 6, "count", total=2000, signature="b", spent=1000), row("s", 7, "count", total=2500, signature="c", spent=500),
    ]
    (requests, turns), want = both(spark, rows)
    assert [requests, turns] == want
    assert [(r[3], r[5], r[6]) for r in requests] == [("tc-c", "own", 500)] and [(t[1], t[4], t[5]) for t in turns] == [("own", "open", 1)]


def test_settings_inside_a_turn_hold_from_its_next_context(spark):
    rows = [
        row("s", 0, "head", thread="me", provider="p"), row("s", 1, "settings", model="m1", tier="fast"), row("s", 2, "started", turn="t"), row("s", 3, "record", thread="me", key="a", spent=1),
        row("s", 4, "settings", model="m2", thread="other"), row("s", 5, "settings", model="m3", effort="high"), row("s", 6, "record", thread="me", key="b", spent=1),
        row("s", 7, "context", turn="t"), row("s", 8, "record", thread="me", key="c", spent=1), row("s", 9, "record", thread="me", key="a", spent=9),
    ]
    (requests, turns), want = both(spark, rows)
    assert [requests, turns] == want
    assert [(r[3], r[11], r[10], r[13]) for r in requests] == [("a", "m1", None, "fast"), ("b", "m1", None, "fast"), ("c", "m3", "high", "fast")]


def test_a_crashed_turn_closes_when_the_next_one_starts(spark):
    rows = [
        row("s", 0, "head", thread="me"), row("s", 1, "started", turn="crashed"), row("s", 2, "record", thread="me", key="a", spent=1), row("s", 3, "record", thread="me", key="b", spent=2),
        row("s", 4, "started", turn="resumed"), row("s", 5, "tool"), row("s", 6, "record", thread="me", key="c", spent=3), row("s", 7, "completed", turn="resumed"),
        row("s", 8, "context", turn="crashed"), row("s", 9, "completed", turn="crashed"),
    ]
    (requests, turns), want = both(spark, rows)
    assert [requests, turns] == want
    assert [(t[1], t[4], t[5], t[6]) for t in turns] == [("crashed", "unfinished", 2, 0), ("resumed", "completed", 1, 1)]


def test_fold_of_nothing(spark):
    requests, turns = rollout.fold_sessions(spark.createDataFrame([], rollout.ROW))
    assert requests.count() == turns.count() == 0


@pytest.mark.parametrize("size", [3, 1000])
def test_carries_do_not_depend_on_the_stretch(spark, size):
    rng = random.Random(size)
    rows = [(rng.choice("ab"), i, rng.choice([None, i])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, at long, v long")
    back = {r.at: (r.upto, r.total) for r in carry_sum(carry_last(df, ["k"], F.col("at"), {"upto": F.col("v")}, size=size), ["k"], F.col("at"), {"total": F.col("v")}, size=size).collect()}
    ahead = {r.at: r.next for r in carry_last(df, ["k"], -F.col("at"), {"next": F.col("v")}, before=True, size=size).collect()}
    for k, at, _ in rows:
        known = [(a, v) for g, a, v in rows if g == k and v is not None]
        assert back[at] == (max((v for a, v in known if a <= at), default=None), sum(v for a, v in known if a <= at))
        assert ahead[at] == min((v for a, v in known if a > at), default=None)
