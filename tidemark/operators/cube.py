"""The grouped usage query: filter, window, one group, one stack, top N with the rest, time series.

Totals and rests are computed from the facts, never by adding groups, because sessions count
distinct. The rows are aggregated once at the finest level with the distinct sessions kept as
rows, so one pass over the facts serves all levels.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.times import bucket_label, in_window

NONE = "(none)"
OTHER = "(other)"


@dataclass(frozen=True)
class UsageQuery:
    """What to ask. ``measures`` are summed columns, ``session`` counts distinct, ``group`` may be null in facts."""

    measures: tuple[str, ...]
    session: str
    ts: str
    group: str | None = None
    stack: str | None = None
    filters: dict[str, tuple[str, ...]] = field(default_factory=dict)
    since: str | None = None
    until: str | None = None
    zone: str = "UTC"
    bucket: str | None = None
    sort: str | None = None
    limit: int | None = None
    scope: str | None = None


def matches(filters: dict[str, tuple[str, ...]]) -> Column:
    """Every filtered dimension has one of its values; ``(none)`` stands for null."""
    ok = F.lit(True)
    for dimension, values in filters.items():
        known = [v for v in values if v != NONE]
        some = F.col(dimension).isin(*known) if known else F.lit(False)
        ok = ok & (some | F.col(dimension).isNull() if NONE in values else some)
    return ok


def select_facts(facts: DataFrame, q: UsageQuery) -> DataFrame:
    """The facts that count. Account buckets are left out unless the filter asks for them."""
    out = facts.where(matches(q.filters))
    if q.since or q.until:
        bound = lambda v: F.lit(v).cast("timestamp") if v else None
        out = out.where(in_window(F.col(q.ts), bound(q.since), bound(q.until)))
    if q.scope and q.scope not in q.filters:
        out = out.where(F.coalesce(F.col(q.scope) != "account-bucket", F.lit(True)))
    return out


def _sums(q: UsageQuery, session: Column) -> list[Column]:
    return [*[F.sum(m).alias(m) for m in q.measures], F.count("*").alias("facts"), F.count_distinct(session).alias("sessions")]


def totals(facts: DataFrame, q: UsageQuery) -> DataFrame:
    """Grand total; a sum of nothing known is null, and so are the sessions of no facts."""
    out = select_facts(facts, q).agg(*_sums(q, F.col(q.session)))
    return out.withColumn("sessions", F.when(F.col("facts") > 0, F.col("sessions")))


def groups(facts: DataFrame, q: UsageQuery) -> DataFrame:
    """Known groups alone, before any limit."""
    return select_facts(facts, q).where(F.col(q.group).isNotNull()).groupBy(F.col(q.group).alias("key")).agg(*_sums(q, F.col(q.session)))


def unattributed(facts: DataFrame, q: UsageQuery) -> DataFrame:
    return select_facts(facts, q).where(F.col(q.group).isNull()).agg(*_sums(q, F.col(q.session)))


def top_groups(facts: DataFrame, q: UsageQuery) -> DataFrame:
    """(rank, key, ...): the first ``limit`` groups by the sort measure, nulls last, then ``(other)`` over the facts of the rest."""
    chosen = select_facts(facts, q).where(F.col(q.group).isNotNull())
    ranking = chosen.groupBy(F.col(q.group).alias("key")).agg(F.sum(q.sort).alias("__by"))
    labels = _leading(ranking, q.limit).select(F.col("key").alias("__key"), "rank")
    labelled = chosen.join(F.broadcast(labels), F.col(q.group) == F.col("__key"), "left")
    rank = F.coalesce("rank", F.lit(q.limit + 1))
    key = F.when(F.col("rank").isNull(), OTHER).otherwise(F.col(q.group).cast("string"))
    return labelled.withColumn("key", key).withColumn("rank", rank).groupBy("rank", "key").agg(*_sums(q, F.col(q.session)))


def _leading(ranking: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` keys with their rank: each task keeps its own first ones, and only those kept are numbered in one."""
    first = ranking.orderBy(F.desc_nulls_last("__by"), "key").limit(limit)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("__by"), "key")))


def series(facts: DataFrame, q: UsageQuery) -> DataFrame:
    """(bucket, stack, ...) and per bucket its whole (stack null); stacks beyond the limit, chosen over the whole series, are one."""
    chosen = select_facts(facts, q).where(F.col(q.ts).isNotNull()).withColumn("bucket", bucket_label(F.col(q.ts), q.bucket, q.zone))
    if q.stack is None:
        return chosen.groupBy("bucket").agg(*_sums(q, F.col(q.session)))
    ranking = chosen.where(F.col(q.stack).isNotNull()).groupBy(F.col(q.stack).alias("key")).agg(F.sum(q.sort).alias("__by"))
    keep = (_leading(ranking, q.limit) if q.limit else ranking).select(F.col("key").alias("__key"))
    labelled = chosen.join(keep, F.col(q.stack) == F.col("__key"), "left").withColumn(
        "stack", F.when(F.col(q.stack).isNull(), NONE).when(F.col("__key").isNull(), OTHER).otherwise(F.col(q.stack).cast("string"))
    )
    return labelled.groupingSets([["bucket", "stack"], ["bucket"]], "bucket", "stack").agg(*_sums(q, F.col(q.session)))


def session_spans(facts: DataFrame, session: list[str], ts: str, dimensions: list[str], match: Column | None = None) -> DataFrame:
    """Per session: first and last instant, each dimension's common value (null when mixed), and whether all or any facts match."""
    common = [
        F.when(F.count_distinct(F.coalesce(F.col(d).cast("string"), F.lit("\x00"))) == 1, F.first(d)).alias(d) for d in dimensions
    ]
    ok = F.lit(True) if match is None else match
    return facts.groupBy(*session).agg(F.min(ts).alias("from_ts"), F.max(ts).alias("to_ts"), *common, F.bool_and(ok).alias("match_all"), F.bool_or(ok).alias("match_any"))


def place_figures(figures: DataFrame, spans: DataFrame, session: list[str], since: Column | None, until: Column | None) -> DataFrame:
    """A session figure counts only where its whole session does: ``included``, or ``cut`` where a part of it overlaps."""
    joined = figures.join(spans, session, "left")
    inside, overlaps = F.lit(True), F.lit(True)
    if since is not None:
        inside, overlaps = inside & (F.col("from_ts") >= since), overlaps & (F.col("to_ts") >= since)
    if until is not None:
        inside, overlaps = inside & (F.col("to_ts") < until), overlaps & (F.col("from_ts") < until)
    included = F.coalesce(inside & F.col("match_all"), F.lit(False))
    return joined.withColumn("included", included).withColumn("cut", F.coalesce(overlaps & F.col("match_any"), F.lit(False)) & ~included).withColumn("at", F.col("to_ts"))


def facts_to_read(facts: DataFrame, figures: DataFrame, session: list[str], ts: str, since: Column, until: Column) -> DataFrame:
    """The facts a windowed answer needs: those in the window, and all of the sessions that have a figure."""
    open_sessions = figures.select(*session).distinct()
    inside = in_window(F.col(ts), since, until)
    return facts.where(inside).unionByName(facts.where(~F.coalesce(inside, F.lit(False))).join(open_sessions, session, "left_semi"))
