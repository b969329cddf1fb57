"""Metric modules: churn, friction, provenance, accounts, history and chats."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.facts import one_per_key
from tidemark.session import materialize

# From where on friction is a finding.
THRESHOLDS = {
    "commandRepeatedFailures": 2, "fileReworkEdits": 5, "fileReworkEditsHigh": 10, "maxFindings": 10, "testFailureRate": 0.5,
    "testFailureRateMinRuns": 3, "testRepeatedFailures": 2, "toolFailureRate": 0.2, "toolFailureRateMinFailures": 3,
}


def envelope(df: DataFrame, metric: str, value: Column, unit: str, numerator: Column | None = None, denominator: Column | None = None, reason: Column | None = None) -> DataFrame:
    """A metric as a row: a missing value always has a reason."""
    none = F.lit(None).cast("double")
    return df.select(
        F.lit(metric).alias("metric"), value.cast("double").alias("value"), F.lit(unit).alias("unit"),
        (numerator if numerator is not None else none).cast("double").alias("numerator"),
        (denominator if denominator is not None else none).cast("double").alias("denominator"),
        F.when(value.isNull(), F.coalesce(reason if reason is not None else F.lit(None), F.lit("no observations"))).alias("reason"),
    )


def churn(commits: DataFrame, sha: str, rewrite_key: str, order: list[Column]) -> DataFrame:
    """Distinct commits: first by sha, then by rewrite key, each in the given order."""
    by_sha = one_per_key(commits, [sha], order)
    return one_per_key(by_sha, [rewrite_key], order)


def retouched(touches: DataFrame, path: str, commit: str) -> DataFrame:
    """Paths with the number of distinct commits that touched them, where more than one did."""
    return touches.groupBy(path).agg(F.count_distinct(commit).alias("touches")).where("touches > 1")


def failure_rates(runs: DataFrame, by: list[str], outcome: str) -> DataFrame:
    """Runs, failures and the failed share of the runs with a known outcome."""
    known = F.count_if(F.col(outcome).isin("passed", "failed"))
    failed = F.count_if(F.col(outcome) == "failed")
    return runs.groupBy(*by).agg(F.count("*").alias("runs"), failed.alias("failures"), known.alias("known")).withColumn("rate", F.try_divide(F.col("failures").cast("double"), F.col("known").cast("double")))


def findings(rates: DataFrame, key: str, min_runs: int, rate: float, limit: int = THRESHOLDS["maxFindings"]) -> DataFrame:
    """Keys over the threshold, ranked by failures, then key; the first few. A rate is a medium finding."""
    over = rates.where((F.col("known") >= min_runs) & (F.col("rate") >= rate))
    order = [F.desc("failures"), F.col(key)]
    first = over.withColumn("severity", F.lit("medium")).orderBy(*order).limit(limit)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("rank", key, "severity", "failures", "known", "rate")


def account_summary(rows: DataFrame, origin: str, ts: str, tokens: str, conversation: str) -> DataFrame:
    """Dashboard rows count; export rows only before the dashboard starts."""
    start = rows.where(F.col(origin) == "dashboard").agg(F.min(ts).alias("__start"))
    used = rows.crossJoin(F.broadcast(start)).where((F.col(origin) == "dashboard") | F.col("__start").isNull() | (F.col(ts) < F.col("__start")))
    linked = F.col(conversation).isNotNull()
    return used.agg(
        F.count("*").alias("rows"), F.sum(F.when(linked, F.col(tokens))).alias("linked"), F.sum(F.when(~linked, F.col(tokens))).alias("unlinked"), F.count_distinct(conversation).alias("conversations")
    )


def history(facts: DataFrame, by: list[str], ts: str, measures: list[str], session: str) -> DataFrame:
    return facts.groupBy(*by).agg(F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), F.count("*").alias("facts"), F.count_distinct(session).alias("sessions"), *[F.sum(m).alias(m) for m in measures])


def chat_nodes(turns: DataFrame, chat: str, turn: str, role: str, text: str) -> DataFrame:
    """A node a chat: turns, requests, the first user line as title, characters."""
    first = F.min_by(text, F.when(F.col(role) == "user", F.col(turn)))
    return turns.groupBy(chat).agg(F.count("*").alias("turns"), F.count_if(F.col(role) == "assistant").alias("requests"), F.substring(first, 1, 40).alias("title"), F.sum(F.length(text)).alias("chars"))


def model_timeline(rows: DataFrame, by: list[str], ts: str, model: str, order: list[str] | None = None) -> DataFrame:
    """Rows where a key's model changes."""
    w = Window.partitionBy(*by).orderBy(ts, *(order or []))
    return rows.withColumn("__before", F.lag(model).over(w)).where(~F.col(model).eqNullSafe(F.col("__before"))).drop("__before")


#: Who wrote a line that the version before has not.
AI, OTHERS = -1, -2


def _chain_lengths(rows: list[list[int]]) -> list[list[int]]:
    """For rows of rising places, the most rows that a rising choice of places, at most one a row, has up to each place."""
    ends: list[int] = []  # the least place that a choice of 1, 2, ... rows can end with
    out = []
    for places in rows:
        before = [bisect_left(ends, place) for place in places]
        for n, place in zip(before, places, strict=True):
            if n == len(ends):
                ends.append(place)
            ends[n] = min(ends[n], place)
        out.append([n + 1 for n in before])
    return out


def sole_alignment(before: list[str], after: list[str]) -> list[tuple[int, int]] | None:
    """The line pairs of the longest common subsequence if only one set of pairs is as long, else None.

    Only pairs of equal lines are looked at. A pair is in some longest alignment if the longest
    chain up to it and the one from it on make up the whole; there is one alignment if such
    pairs are no more than it is long. Time is the number of such pairs, repeats included, by
    the logarithm of the lines.
    """
    places: dict[str, list[int]] = {}
    for j, line in enumerate(after):
        places.setdefault(line, []).append(j)
    at = [i for i, line in enumerate(before) if line in places]
    rows = [places[before[i]] for i in at]
    upto = _chain_lengths(rows)
    mirrored = _chain_lengths([[-j for j in reversed(row)] for row in reversed(rows)])
    onward = [row[::-1] for row in reversed(mirrored)]
    longest = max(map(max, upto), default=0)
    pairs = [(i, j) for i, row, a, b in zip(at, rows, upto, onward, strict=True) for j, x, y in zip(row, a, b, strict=True) if x + y == longest + 1]
    return pairs if len(pairs) == longest else None


#: Steps folded at once; more are folded in further rounds.
FAN = 64


def line_survival(edits: DataFrame, path: str, order: str, text: str, source: str) -> DataFrame:
    """(path, lines, ai_lines, ambiguous): which of a file's last lines came with AI edits, by unique alignment step by step.

    Each pair of neighbouring versions is aligned by itself. A step tells of each line where it
    was before, or who wrote it; steps are composed ``FAN`` at a time, so no task holds a file's
    history. A null text is an empty one; versions of one order go by their text.
    """
    kind = edits.schema[path].dataType.simpleString()
    step = Window.partitionBy(path).orderBy(order, text)
    ai = F.coalesce(F.col(source) == "ai", F.lit(False))
    versions = edits.select(path, (F.row_number().over(step) - 1).cast("long").alias("__n"), F.lag(F.coalesce(text, F.lit(""))).over(step).alias("__before"), F.coalesce(text, F.lit("")).alias("__after"), ai.alias("__ai"))

    def align(frames):
        for frame in frames:
            origins, unclear = [], []
            for before, after, by_ai in zip(frame["__before"], frame["__after"], frame["__ai"], strict=True):
                old, new = (body.split("\n") if body else [] for body in (before, after))
                pairs = sole_alignment(old, new)
                kept = {j: i for i, j in pairs or []}
                origins.append([kept.get(j, AI if by_ai else OTHERS) for j in range(len(new))])
                unclear.append(pairs is None)
            yield pd.DataFrame({path: frame[path], "__n": frame["__n"], "__from": origins, "__unclear": unclear})

    steps, _ = materialize(versions.mapInPandas(align, f"`{path}` {kind}, __n long, __from array<int>, __unclear boolean"), "alignments")
    left = (steps.agg(F.max("__n")).first()[0] or 0) + 1
    composed = lambda parts: F.aggregate(F.slice(parts, 2, FAN), F.get(parts, F.lit(0))["__from"], lambda before, x: F.transform(x["__from"], lambda i: F.when(i >= 0, F.get(before, i)).otherwise(i)))
    while left > 1:
        parts = steps.groupBy(path, F.floor(F.col("__n") / FAN).alias("__n")).agg(F.sort_array(F.collect_list(F.struct("__n", "__from"))).alias("__parts"), F.bool_or("__unclear").alias("__unclear"))
        steps = parts.select(path, "__n", composed(F.col("__parts")).alias("__from"), "__unclear")
        left = -(-left // FAN)
    written = F.size(F.filter("__from", lambda i: i == AI)).cast("double")
    return steps.select(path, F.size("__from").cast("long").alias("lines"), F.when(~F.col("__unclear"), written).alias("ai_lines"), F.col("__unclear").alias("ambiguous"))
