"""What commits of a graph reach, told as what each reaches beyond its first parent.

First parents make a tree; a merge adds to it stretches of chains that its first parent does not
reach. All of them together grow with the history, where what every tip reaches grows with its
square. A tour of the tree numbers the commits so that those above a commit are an interval;
how far up a chain a commit reaches is then a step function of that number, looked up as of it.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.carry import carry_last, carry_max, carry_sum

#: Commits of the first stretch of an order that walks are kept to, and how much wider the next ones are.
WIDTH, WIDER = 512, 4
#: Places of a chain, as a power of two, that links are dealt by.
BUCKET = 6
FRESH = "repo string, rank long, chain string, low long, high long, open boolean"


def ordered(places: DataFrame, across: DataFrame, tables, clock: DataFrame | None = None) -> DataFrame:
    """``places`` with ``rank``, from 0 a repository: parents come before children.

    ``clock`` (repo, sha, clock) has numbers that mostly rise from parents to children, such as
    commit times; where they do not, they are raised, in as many rounds as raises follow each
    other from chain to chain. Without it a commit's first parents below are counted.
    """
    held = places.withColumn("clock", F.lit(0).cast("long")) if clock is None else places.join(clock, ["repo", "sha"], "left")
    # Along a chain a clock goes on by one at least: what is carried is the clock less the place.
    held = held.withColumn("shift", F.coalesce(F.col("clock") - F.col("pos"), F.lit(0)) if clock is not None else F.lit(0).cast("long")).drop("clock")
    rounds, most = 0, None
    while True:
        timed = tables.keep(carry_max(held, ["repo", "chain"], F.col("pos"), {"shift": F.col("shift")}), "clock")
        at = timed.select("repo", "chain", "pos", (F.col("pos") + F.col("shift")).alias("__at"))
        to = at.select("repo", F.col("chain").alias("to_chain"), F.col("pos").alias("to_pos"), F.col("__at").alias("__below"))
        late = across.join(at, ["repo", "chain", "pos"]).join(to, ["repo", "to_chain", "to_pos"]).where("__below >= __at")
        late = tables.keep(late.groupBy("repo", "chain", "pos").agg(F.max(F.col("__below") + 1 - F.col("pos")).alias("__raised")), "late")
        if late.isEmpty():
            break
        most = across.count() if most is None else most
        rounds += 1
        if rounds > most:
            raise ValueError("the commits' parents form a cycle")
        held = timed.join(late, ["repo", "chain", "pos"], "left").withColumn("shift", F.greatest("shift", "__raised")).drop("__raised")
    timed = timed.withColumn("__t", F.col("pos") + F.col("shift")).drop("shift")
    # Stretches of the clock's span deal the rows of a repository.
    span = timed.groupBy("repo").agg(F.min("__t").alias("__from"), F.max("__t").alias("__to"))
    stretch = F.floor((F.col("__t") - F.col("__from")) / (F.col("__to") - F.col("__from") + 1) * 1024)
    counted = carry_sum(timed.join(span, "repo"), ["repo"], F.struct("__t", "sha"), {"rank": F.lit(1).cast("long")}, stretch=stretch)
    return tables.keep(counted.select(*places.columns, (F.col("rank") - 1).alias("rank")), "ordered")


def _beyond(first, others: list[int], parents: dict, low: int) -> list[int] | None:
    """The ranks that ``others`` reach and ``first`` does not; None if ranks below ``low`` may be among them.

    Goes down by rank, so a commit comes after all its children; it ends when all that wait are reached from ``first``.
    """
    marks = {r: 2 for r in others}
    if first is not None:
        marks[first] = 1
    waiting = [-r for r in marks]
    heapify(waiting)
    open_, out = sum(m == 2 for m in marks.values()), []
    while open_:
        r = -heappop(waiting)
        if r < low:
            return None
        mark = marks.pop(r)
        if mark == 2:
            open_ -= 1
            out.append(r)
        for p in parents[r]:
            had = marks.get(p)
            if had is None:
                heappush(waiting, -p)
                marks[p] = mark
                open_ += mark == 2
            elif had != mark and had == 2:
                marks[p] = 3
                open_ -= 1
            elif had != mark:
                marks[p] = 3
    return out


def fresh(numbered: DataFrame, links: DataFrame, tables) -> tuple[DataFrame, DataFrame]:
    """((repo, rank, chain, low, high): a commit reaches these places above ``low`` up to ``high`` and its first parent does not, (repo, rank, first): first parents).

    A walk down from a merge's parents stays inside a stretch of the order and the one before;
    those that have not ended there are taken again in stretches ``WIDER`` times as wide.
    """
    child = numbered.select("repo", "sha", "rank")
    known = links.join(child, ["repo", "sha"]).join(child.select("repo", F.col("sha").alias("parent"), F.col("rank").alias("__parent")), ["repo", "parent"])
    parents = known.groupBy("repo", "rank").agg(F.max(F.when(F.col("nth") == 0, F.col("__parent"))).alias("first"), F.collect_set(F.when(F.col("nth") > 0, F.col("__parent"))).alias("others"))
    rows = tables.keep(numbered.select("repo", "rank", "chain", "pos").join(parents, ["repo", "rank"], "left"), "parents")
    own = rows.select("repo", "rank", "chain", (F.col("pos") - 1).alias("low"), F.col("pos").alias("high"))
    asked, found, width = rows.where("size(others) > 0").select("repo", "rank"), [own], WIDTH
    while not asked.isEmpty():
        here = rows.withColumn("window", F.explode(F.array(F.floor(F.col("rank") / width), F.floor(F.col("rank") / width) + 1)))
        here = here.join(asked.select("repo", F.floor(F.col("rank") / width).alias("window")).distinct(), ["repo", "window"], "left_semi")
        here = here.join(asked.withColumn("asked", F.lit(True)), ["repo", "rank"], "left")
        step = tables.keep(here.groupBy("repo", "window").applyInPandas(_walks(width), FRESH), "fresh")
        found.append(step.where("not open").drop("open"))
        asked, width = step.where("open").select("repo", "rank"), width * WIDER
    entries = found[0]
    for more in found[1:]:
        entries = entries.union(more)
    return entries, rows.select("repo", "rank", "first")


def _walks(width: int):
    def walks(key, pdf):
        repo, low = key[0], (key[1] - 1) * width
        ranks = pdf["rank"].tolist()
        firsts = [None if x is None or x != x else int(x) for x in pdf["first"].tolist()]
        others = [[] if x is None else [int(o) for o in x] for x in pdf["others"].tolist()]
        place = dict(zip(ranks, zip(pdf["chain"], pdf["pos"].tolist(), strict=True), strict=True))
        parents = {r: ([] if f is None else [f]) + o for r, f, o in zip(ranks, firsts, others, strict=True)}
        out = []
        for r, f, o, asked in zip(ranks, firsts, others, pdf["asked"].tolist(), strict=True):
            if asked is not True or r // width != key[1]:
                continue
            got = _beyond(f, [x for x in o if x != f], parents, low)
            if got is None:
                out.append((repo, r, None, None, None, True))
                continue
            spans = {}
            for x in got:
                chain, pos = place[x]
                lo, hi = spans.get(chain, (pos - 1, pos))
                spans[chain] = (min(lo, pos - 1), max(hi, pos))
            out += [(repo, r, chain, lo, hi, False) for chain, (lo, hi) in spans.items()]
        made = pd.DataFrame(out, columns=["repo", "rank", "chain", "low", "high", "open"])
        return made.astype({"low": "Int64", "high": "Int64"})

    return walks


def tour(numbered: DataFrame, across: DataFrame, entries: DataFrame, heads: DataFrame, tables) -> DataFrame:
    """(repo, sha, chain, pos, rank, enter, leave, tip_enter, tip_leave, here, n) of all commits.

    The commits above one in the tree of first parents are those entered from ``enter`` up to
    ``leave``; ``heads`` (repo, head, each row a tip) are numbered along, ``here`` of them on
    the commit itself. ``n`` counts what a commit reaches.
    """
    chain, at = ["repo", "chain"], ["repo", "chain", "pos"]
    tips = heads.groupBy("repo", F.col("head").alias("sha")).agg(F.count("*").alias("here"))
    news = entries.groupBy("repo", "rank").agg(F.sum(F.col("high") - F.col("low")).alias("news"))
    node = tables.keep(numbered.join(tips, ["repo", "sha"], "left").join(news, ["repo", "rank"]).fillna(0, ["here"]), "nodes")
    hangs = across.where("first").select(*chain, F.col("to_chain").alias("jump"), F.col("to_pos").alias("at_pos"))
    parts = node.groupBy(*chain).agg(F.count("*").alias("size"), F.sum("here").alias("tips")).join(hangs, chain, "left")
    # What hangs on a chain, with itself: sums over a tree by doubling.
    state = parts = tables.keep(parts, "parts")
    state = state.drop("at_pos")
    while not state.where("jump is not null").isEmpty():
        more = state.where("jump is not null").groupBy("repo", F.col("jump").alias("chain")).agg(F.sum("size").alias("__size"), F.sum("tips").alias("__tips"))
        up = state.select("repo", F.col("chain").alias("jump"), F.col("jump").alias("__jump"))
        state = state.join(more, chain, "left").join(up, ["repo", "jump"], "left")
        state = tables.keep(state.select(*chain, F.col("__jump").alias("jump"), (F.col("size") + F.coalesce("__size", F.lit(0))).alias("size"), (F.col("tips") + F.coalesce("__tips", F.lit(0))).alias("tips")), "totals")
    total = parts.select(*chain, "jump", "at_pos").join(state.select(*chain, "size", "tips"), chain)
    hung = total.where("jump is not null").groupBy("repo", F.col("jump").alias("chain"), F.col("at_pos").alias("pos")).agg(F.sum("size").alias("h_size"), F.sum("tips").alias("h_tips"))
    local = node.join(hung, at, "left").fillna(0, ["h_size", "h_tips"])
    local = carry_sum(local, chain, F.col("pos"), {"enter": F.col("h_size") + 1, "tip_enter": F.col("h_tips") + F.col("here"), "n": F.col("news")})
    local = tables.keep(local.withColumn("enter", F.col("enter") - F.col("h_size") - 1).withColumn("tip_enter", F.col("tip_enter") - F.col("h_tips") - F.col("here")).drop("h_size", "h_tips", "news"), "local")
    # Where a chain begins: after the commit it hangs on and its siblings before.
    siblings = Window.partitionBy("repo", "jump", "at_pos").orderBy("chain").rowsBetween(Window.unboundedPreceding, -1)
    under = local.select("repo", F.col("chain").alias("jump"), F.col("pos").alias("at_pos"), F.col("enter") + 1, F.col("tip_enter") + F.col("here"), "n").toDF("repo", "jump", "at_pos", "u_size", "u_tips", "u_n")
    before = lambda c: F.coalesce(F.sum(c).over(siblings), F.lit(0))
    base = total.withColumn("b_size", before("size")).withColumn("b_tips", before("tips")).join(under, ["repo", "jump", "at_pos"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    base = tables.keep(base.select(*chain, "jump", "size", "tips", (F.col("b_size") + zero("u_size")).alias("b_size"), (F.col("b_tips") + zero("u_tips")).alias("b_tips"), zero("u_n").alias("b_n")), "base")
    while not base.where("jump is not null").isEmpty():
        up = base.select("repo", F.col("chain").alias("jump"), F.col("jump").alias("__jump"), *[F.col(c).alias(f"__{c}") for c in ("b_size", "b_tips", "b_n")])
        base = base.join(up, ["repo", "jump"], "left").select(*chain, F.col("__jump").alias("jump"), "size", "tips", *[(F.col(c) + zero(f"__{c}")).alias(c) for c in ("b_size", "b_tips", "b_n")])
        base = tables.keep(base, "base")
    out = local.join(base.drop("jump"), chain).select(
        "repo", "sha", "chain", "pos", "rank", (F.col("enter") + F.col("b_size")).alias("enter"), (F.col("b_size") + F.col("size")).alias("leave"),
        (F.col("tip_enter") + F.col("b_tips")).alias("tip_enter"), (F.col("b_tips") + F.col("tips")).alias("tip_leave"), "here", (F.col("n") + F.col("b_n")).alias("n"),
    )
    return tables.keep(out, "tour")


def tops(held: DataFrame) -> DataFrame:
    """(repo, chain, at, value): how far up a chain a commit reaches that is entered at ``at``, as steps; below the chain if not at all.

    ``held`` are rows of ``fresh`` with ``enter`` and ``leave`` of their commits. What a commit
    adds holds for those above it; after the last of them the chain falls back to what was
    reached before, the least where several end at once.
    """
    into = held.select("repo", "chain", F.col("enter").alias("at"), F.col("high").alias("up"), F.lit(None).cast("long").alias("down"))
    end = held.select("repo", "chain", F.col("leave").alias("at"), F.lit(None).cast("long").alias("up"), F.col("low").alias("down"))
    return into.union(end).groupBy("repo", "chain", "at").agg(F.coalesce(F.max("up"), F.min("down")).alias("value"))


def crowds(held: DataFrame) -> DataFrame:
    """(repo, chain, at, value): the last place on a chain, ``value``, that as many tips reach as ``at`` less its sign, as steps."""
    tips = held.withColumn("w", F.col("tip_leave") - F.col("tip_enter")).where("w > 0")
    change = tips.select("repo", "chain", (F.col("low") + 1).alias("pos"), "w").union(tips.select("repo", "chain", F.col("high") + 1, -F.col("w")))
    change = change.groupBy("repo", "chain", "pos").agg(F.sum("w").alias("d")).where("d <> 0")
    counted = carry_sum(change, ["repo", "chain"], F.col("pos"), {"n": F.col("d")}).select("repo", "chain", (F.col("d") - F.col("n")).alias("at"), (F.col("pos") - 1).alias("value"))
    return counted.where("at < 0").groupBy("repo", "chain", "at").agg(F.max("value").alias("value"))


def as_of(asked: DataFrame, steps: DataFrame, name: str) -> DataFrame:
    """Rows of ``asked`` (repo, kind, chain, at, ...) with the step at or before ``at`` as ``name``, -1 if there is none."""
    key = ["repo", "kind", "chain"]
    rest = [c for c in asked.columns if c not in (*key, "at")]
    q = asked.select(*key, "at", F.lit(1).alias("__side"), F.lit(None).cast("long").alias("__value"), F.struct(F.lit(0).alias("__"), *rest).alias("__rest"))
    s = steps.join(asked.select(*key).distinct(), key, "left_semi").select(*key, "at", F.lit(0).alias("__side"), F.col("value").alias("__value"))
    both = s.unionByName(q, allowMissingColumns=True)
    out = carry_last(both, key, F.struct("at", "__side"), {"__value": F.col("__value")}, stretch=F.floor(F.col("at") / 65536)).where("__side = 1")
    return out.select(*key, "at", *[F.col(f"__rest.{c}").alias(c) for c in rest], F.coalesce("__value", F.lit(-1)).alias(name))


def blocks(first: Column, end: Column) -> Column:
    """The aligned blocks of a power of two, (level, block), that make up [first, end): two a level at most."""
    level = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(end - first, F.lit(1)) + 1)).cast("int"))

    def at(j):
        size = F.call_function("shiftleft", F.lit(1).cast("long"), j)
        lo, hi = F.call_function("shiftright", first + size - 1, j), F.call_function("shiftright", end, j)
        some = lo < hi
        block = lambda b: F.struct(j.alias("level"), b.alias("block"))
        return F.array_compact(F.array(F.when(some & (lo % 2 == 1), block(lo)), F.when(some & (hi % 2 == 1), block(hi - 1))))

    return F.flatten(F.transform(level, at))


def holding(asked: DataFrame, dealt: DataFrame, levels: list[int]) -> DataFrame:
    """Rows of ``asked`` (repo, chain, pos, ...) with the rows of ``dealt`` whose block holds their place."""
    level = F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>"))
    points = asked.withColumn("level", level).withColumn("block", F.call_function("shiftright", F.col("pos"), F.col("level")))
    return points.join(dealt, ["repo", "chain", "level", "block"]).drop("level", "block")


def borders(starts: DataFrame, across: DataFrame, steps: DataFrame, by: list[str], tables) -> DataFrame:
    """(by, chain, pos): the first places below that the steps hold, of each chain the uppermost.

    ``starts`` has (by, chain, pos); ``by`` has (repo, kind, at), what is asked of the steps.
    Walks go down only while they are above what the steps hold.
    """
    links = across.select("repo", "chain", F.call_function("shiftright", F.col("pos"), F.lit(BUCKET)).alias("__b"), "pos", "to_chain", "to_pos")
    front = starts.select(*by, "chain", F.col("pos").alias("top"), F.lit(None).cast("long").alias("before")).distinct()
    seen = None
    while True:
        looked = tables.keep(as_of(front, steps, "floor").select(*by, "chain", "top", "before", "floor"), "front")
        seen = looked if seen is None else seen.union(looked)
        go = looked.withColumn("__low", F.greatest("floor", "before")).where("top > __low")
        go = go.withColumn("__b", F.explode(F.sequence(F.call_function("shiftright", F.col("__low") + 1, F.lit(BUCKET)), F.call_function("shiftright", F.col("top"), F.lit(BUCKET)))))
        out = go.join(links, ["repo", "chain", "__b"]).where("pos <= top and pos > __low").groupBy(*by, F.col("to_chain").alias("chain")).agg(F.max("to_pos").alias("top"))
        had = seen.groupBy(*by, "chain").agg(F.max("top").alias("before"))
        front = tables.keep(out.join(had, [*by, "chain"], "left").where("before is null or top > before").select(*by, "chain", "top", "before"), "next")
        if front.isEmpty():
            return seen.where("floor >= 0").groupBy(*by, "chain").agg(F.max(F.least("top", "floor")).alias("pos"))


def latest(found: DataFrame, steps: DataFrame, by: list[str]) -> DataFrame:
    """Of ``found`` (by, chain, pos, enter, ...) those that no other one of their ``by`` reaches; ``steps`` are tops."""
    other = found.select(*by, F.col("chain").alias("__chain"), F.col("enter").alias("__enter"))
    pairs = found.select(*by, "chain", "pos").join(other, by).where("chain <> __chain")
    pairs = pairs.select(*[F.col(c).alias(f"__by_{c}") for c in by], "repo", "chain", "pos", F.col("__enter").alias("at")).withColumn("kind", F.lit(0))
    below = as_of(pairs, steps, "top").where("top >= pos").select(*[F.col(f"__by_{c}").alias(c) for c in by], "chain").distinct()
    return found.join(below, [*by, "chain"], "left_anti")
