"""Session logs whose rows change state: turns that open and close, settings, replayed prefixes.

A log row's meaning depends on all rows before it, yet each part of that state is the last
known value, a running count, or the first row of a kind. So the state at every row comes from
carries along the session (``operators.carry``), a few passes for all sessions at once, and no
task walks a session.

Rows have (session, seq, kind) and, by kind:

==========  ==============================================================================
head        thread, born, forked, cwd, provider; the first one of a session counts
settings    thread, model, effort, provider, tier: what holds from here on; null leaves as is
started     turn, born, at: a turn opens, and every other open one is left unfinished
context     turn (null: the one entered last), born, cwd, model, effort: the turn's facts
completed   turn; so are failed and aborted (null: the one entered last)
tool        a tool call of the turn entered last; ``search`` if it is a web search
record      thread, key, turn, spent: exact usage of one response
count       total, signature, spent: the running counter, where no records are kept
==========  ==============================================================================

A forked session begins with its parent's history. It lasts until a turn is entered that was
born when the thread was or later, or an own record comes; what stands there gives neither
turns, tool calls nor requests, but its settings and counters are known.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.carry import STRETCH, carry_last, carry_sum
from tidemark.session import materialize

FACTS = ("cwd", "effort", "model", "provider", "tier")
ENDS = ("completed", "failed", "aborted")
ROW = "session string, seq long, kind string, at timestamp, thread string, born long, forked boolean, turn string, cwd string, model string, effort string, provider string, tier string, key string, total long, signature string, spent long, search boolean"


def _is(*kinds: str):
    return F.col("kind").isin(*kinds)


def session_state(rows: DataFrame, size: int = STRETCH) -> DataFrame:
    """Every row with the state it meets: own history, settings, the turn entered last, facts, counters."""
    # Rows cross one exchange, to their stretch; what holds for a session comes to its stretches.
    by, stretch = ["session", "__stretch"], F.col("__stretch")
    rows = rows.withColumn("__stretch", F.floor(F.col("seq") / size))
    spread = lambda df: parts.join(df, "session").hint("merge")
    parts = rows.select(*by).distinct()
    head = F.min_by(F.struct("seq", "thread", "born", "forked", "cwd", "provider"), F.when(_is("head"), F.col("seq")))
    heads = rows.groupBy("session").agg(head.alias("head"))
    known = rows.join(spread(heads), by)
    after_head = F.col("seq") > F.col("head.seq")
    own_record = _is("record") & after_head & (F.col("thread") == F.col("head.thread"))
    own_turn = _is("started", "context") & after_head & F.col("turn").isNotNull() & (F.col("head.born").isNull() | F.coalesce(F.col("born") >= F.col("head.born"), F.lit(False)))
    firsts = known.groupBy("session").agg(F.min(F.when(own_record | own_turn, F.col("seq"))).alias("own_from"), F.min(F.when(own_record, F.col("seq"))).alias("record_from"))
    replayed = F.coalesce("head.forked", F.lit(False)) & F.coalesce(after_head, F.lit(False)) & (F.col("own_from").isNull() | (F.col("seq") < F.col("own_from")))
    marked = known.join(spread(firsts), by).select(*known.columns, "record_from", F.coalesce(own_record, F.lit(False)).alias("own_record"), replayed.alias("replayed"))
    at = F.col("seq")
    applies = _is("settings") & (F.col("thread").isNull() | F.col("head").isNull() | ~F.coalesce(after_head, F.lit(False)) | (F.col("thread") == F.col("head.thread")))
    first_head = _is("head") & (F.col("seq") == F.col("head.seq"))
    settings = {f"set_{c}": F.when(applies, F.col(c)) for c in ("model", "effort", "tier")} | {"set_provider": F.when(applies | first_head, F.col("provider"))}
    entered = F.when(_is("started", "context"), F.col("turn"))
    with_settings = carry_last(marked, ["session"], at, settings | {"current": entered}, stretch=stretch)
    turn = F.coalesce("turn", F.when(_is("context", "aborted", "record", "count"), F.col("current")))
    turned = with_settings.withColumn("turn", turn)
    context = _is("context") & F.col("turn").isNotNull() & ~F.col("replayed")
    facts = {
        "at_cwd": F.when(context | first_head, F.col("cwd")),
        "at_effort": F.when(context, F.coalesce("effort", "set_effort")),
        "at_model": F.when(context, F.coalesce("model", "set_model")),
        "at_fixed": F.when(context, F.struct(F.col("set_provider").alias("provider"), F.col("set_tier").alias("tier"))).when(first_head, F.struct(F.col("provider").alias("provider"), F.lit(None).cast("string").alias("tier"))),
    }
    counted = _is("count")
    return carry_last(
        carry_last(turned, ["session"], at, facts, stretch=stretch), ["session"], at, {"total_before": F.when(counted, F.col("total"))}, before=True, stretch=stretch
    ).drop("__stretch").select("*", F.struct(F.col("at_cwd").alias("cwd"), F.col("at_effort").alias("effort"), F.col("at_model").alias("model"), F.col("at_fixed.provider").alias("provider"), F.col("at_fixed.tier").alias("tier")).alias("facts"))


def turn_spans(state: DataFrame, size: int = STRETCH) -> DataFrame:
    """(session, turn, opened, started_at, opening, ended, status): each turn from the row that opens it to the one that ends it.

    A turn ends with its own end, or when another one starts; ended, it never opens again.
    """
    own = state.where(~F.col("replayed") & F.col("turn").isNotNull())
    starts = own.where(_is("started")).select("session", "seq", "turn")
    back, ahead = F.col("seq"), -F.col("seq")
    changes = carry_last(starts, ["session"], back, {"before": F.col("turn")}, before=True, size=size).withColumn("changed", F.when(~F.col("turn").eqNullSafe(F.col("before")), F.col("seq")))
    changes = carry_last(changes, ["session"], ahead, {"next_change": F.col("changed")}, before=True, size=size)
    opens = F.struct(
        F.coalesce("facts.cwd", "head.cwd").alias("cwd"), F.coalesce("set_effort", "facts.effort").alias("effort"), F.coalesce("set_model", "facts.model").alias("model"),
        F.col("set_provider").alias("provider"), F.col("set_tier").alias("tier"),
    )
    opening = own.where(_is("started", "context")).select("session", "turn", "seq", "at", F.when(_is("context"), F.col("facts")).otherwise(opens).alias("opening"))
    first = opening.groupBy("session", "turn").agg(F.min(F.struct("seq", "at", "opening")).alias("o")).select("session", "turn", F.col("o.seq").alias("opened"), F.col("o.at").alias("started_at"), F.col("o.opening").alias("opening"))
    # The next start after a turn's opening, and where the turn of the starts changes after that.
    marks = first.select("session", F.col("opened").alias("seq"), "turn", F.lit(None).cast("struct<seq:bigint,turn:string,next_change:bigint>").alias("start"), F.lit(1).alias("side"))
    marks = marks.union(changes.select("session", "seq", "turn", F.struct("seq", "turn", "next_change").alias("start"), F.lit(0).alias("side")))
    # A turn opens at the row that starts it; that row is behind it, so openings stand just after starts.
    ahead_of = carry_last(marks, ["session"], ahead * 2 - F.col("side"), {"next": F.col("start")}, before=True, size=2 * size).where("side = 1")
    other = F.when(F.col("next.turn") != F.col("turn"), F.col("next.seq")).otherwise(F.col("next.next_change"))
    left = ahead_of.select("session", "turn", other.alias("left_at"))
    ends = own.where(_is(*ENDS)).select("session", "turn", "seq", "kind", F.col("at").alias("ended_at"))
    closed = first.select("session", "turn", "opened").join(ends, ["session", "turn"]).where("seq > opened").groupBy("session", "turn").agg(F.min(F.struct("seq", "kind", "ended_at")).alias("e"))
    spans = first.join(left, ["session", "turn"]).join(closed, ["session", "turn"], "left")
    by_end = F.coalesce(F.col("e.seq") < F.coalesce("left_at", F.lit(2**62)), F.lit(False))
    return spans.select(
        "session", "turn", "opened", "started_at", "opening", F.when(by_end, F.col("e.seq")).otherwise(F.col("left_at")).alias("ended"),
        F.when(by_end, F.col("e.ended_at")).alias("completed_at"), F.when(by_end, F.col("e.kind")).when(F.col("left_at").isNotNull(), "unfinished").otherwise("open").alias("status"),
    )


def fold_sessions(rows: DataFrame, size: int = STRETCH) -> tuple[DataFrame, DataFrame]:
    """(requests, turns) of session logs.

    ``requests``: (session, seq, at, key, source, turn, spent, tool_calls, searches, cwd,
    effort, model, provider, tier). A response counts once by its key, and not if it spent
    nothing. The running counter stands in until the first record: a row of it is a request
    if its total is new and so are its figures. Tool calls belong to the next request, unless
    another turn starts before. Facts are those of the open turn at the time, else of the
    session; without a model then, those the turn had in the end.

    ``turns``: (session, turn, started_at, completed_at, status, requests, tool_calls), status
    completed, failed, aborted, unfinished (another turn started) or open.

    ``seq`` is each row's own within its session. An empty table gives empty results.
    """
    state, _ = materialize(session_state(rows, size), "session-state")
    spans, _ = materialize(turn_spans(state, size), "turn-spans")
    records = state.where("own_record").groupBy("session", F.coalesce("key", F.concat(F.lit("ord-"), "seq")).alias("key")).agg(F.min_by(F.struct("seq", "at", "turn", "spent", "facts"), "seq").alias("r"))
    signature = F.when(F.col("total").isNull(), F.concat(F.lit("ord-"), "seq")).otherwise(F.col("signature"))
    counts = state.where(_is("count") & F.col("spent").isNotNull()).groupBy("session", signature.alias("key")).agg(F.min_by(F.struct("seq", "at", "turn", "spent", "facts", "total", "total_before", "replayed", "record_from"), "seq").alias("r"))
    counts = counts.where("NOT r.replayed AND (r.record_from IS NULL OR r.seq < r.record_from) AND NOT (r.total IS NOT NULL AND r.total <=> r.total_before)")
    shape = lambda df, source: df.where("r.spent > 0").select("session", "r.seq", "r.at", "key", F.lit(source).alias("source"), "r.turn", "r.spent", "r.facts")
    found, _ = materialize(shape(records, "record").union(shape(counts.withColumn("key", F.concat(F.lit("tc-"), "key")), "count")), "session-requests")

    # Tool calls since the last request or start of a turn.
    nothing = F.lit(0).cast("long")
    tools = state.where(_is("tool") & ~F.col("replayed") & F.col("current").isNotNull()).select("session", "seq", F.lit(1).cast("long").alias("tool"), F.coalesce(F.col("search").cast("long"), nothing).alias("search"), F.lit("tool").alias("what"))
    resets = state.where(_is("started") & ~F.col("replayed") & F.col("turn").isNotNull()).select("session", "seq", nothing, nothing, F.lit("start"))
    taken = found.select("session", "seq", nothing, nothing, F.lit("request"))
    at = F.col("seq")
    running = carry_sum(tools.union(resets).union(taken), ["session"], at, {"tools": F.col("tool"), "searches": F.col("search")}, size=size)
    since = carry_last(running, ["session"], at, {"last": F.when(F.col("what") != "tool", F.struct("tools", "searches"))}, before=True, size=size)
    used = since.where("what = 'request'").select("session", "seq", (F.col("tools") - F.coalesce("last.tools", nothing)).alias("tool_calls"), (F.col("searches") - F.coalesce("last.searches", nothing)).alias("searches"))

    # The facts of a turn change with its contexts while it is open.
    contexts = state.where(_is("context") & ~F.col("replayed") & F.col("turn").isNotNull()).select("session", "turn", "seq", F.col("facts").alias("fact")).join(spans.select("session", "turn", "ended"), ["session", "turn"]).where("ended IS NULL OR seq <= ended").drop("ended")
    openings = spans.select("session", "turn", F.col("opened").alias("seq"), F.col("opening").alias("fact"))
    facts = openings.union(contexts.select("session", "turn", "seq", "fact").join(openings.select("session", "turn", "seq"), ["session", "turn", "seq"], "left_anti"))
    last = facts.groupBy("session", "turn").agg(F.max_by("fact", "seq").alias("in_the_end"))
    asked = found.where("turn IS NOT NULL").select("session", "turn", "seq", F.lit(None).cast(facts.schema["fact"].dataType).alias("fact"), F.lit(True).alias("asked"))
    at_request = carry_last(facts.withColumn("asked", F.lit(False)).union(asked), ["session", "turn"], at, {"fact": F.col("fact")}, size=size).where("asked").drop("asked")
    placed = (
        found.join(used, ["session", "seq"]).join(at_request, ["session", "turn", "seq"], "left")
        .join(spans.select("session", "turn", "opened", "ended"), ["session", "turn"], "left").join(last, ["session", "turn"], "left")
    )
    is_open = F.coalesce((F.col("seq") > F.col("opened")) & (F.col("ended").isNull() | (F.col("seq") < F.col("ended"))), F.lit(False))
    then = F.when(is_open, F.col("fact")).otherwise(F.col("facts"))
    chosen = F.when(then["model"].isNull() & F.col("in_the_end").isNotNull(), F.col("in_the_end")).otherwise(then)
    requests = placed.withColumn("fact", chosen).withColumn("is_open", is_open)
    requests, _ = materialize(requests.select("session", "seq", "at", "key", "source", "turn", "spent", "tool_calls", "searches", *[F.col(f"fact.{c}").alias(c) for c in FACTS], "is_open"), "placed-requests")

    per_turn = requests.where("is_open").groupBy("session", "turn").agg(F.count("*").alias("requests"))
    calls = state.where(_is("tool") & ~F.col("replayed")).select("session", F.col("current").alias("turn"), "seq").join(spans.select("session", "turn", "opened", "ended"), ["session", "turn"])
    calls = calls.where("seq > opened AND (ended IS NULL OR seq < ended)").groupBy("session", "turn").agg(F.count("*").alias("tool_calls"))
    turns = reduce(lambda a, b: a.join(b, ["session", "turn"], "left"), [spans, per_turn, calls])
    return requests.drop("is_open"), turns.select("session", "turn", "started_at", "completed_at", "status", F.coalesce("requests", nothing).alias("requests"), F.coalesce("tool_calls", nothing).alias("tool_calls"))
