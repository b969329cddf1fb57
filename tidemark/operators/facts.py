"""Several reports of one request become one fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.graph import connected_components


def one_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key by an explicit order."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rank = 1").drop("__rank")


def group_reports(events: DataFrame, event_id: str, keys: str) -> DataFrame:
    """(event_id, component): events that share a match key, directly or over others, are one request.

    A key that joins many events is a star of edges to its smallest event, never all pairs.
    """
    links = events.select(F.col(event_id).alias("id"), F.explode_outer(keys).alias("k"))
    hubs = links.where("k is not null").groupBy("k").agg(F.min("id").alias("hub"))
    edges = links.join(hubs, "k", "left").select(F.col("id").alias("src"), F.coalesce("hub", "id").alias("dst"))
    return connected_components(edges).withColumnRenamed("node", event_id)


def bridge_sessionless(events: DataFrame, request: str, session: str) -> DataFrame:
    """The session of events without one, where exactly one session has their request id."""
    owners = (
        events.where(F.col(session).isNotNull()).groupBy(request).agg(F.min(session).alias("__low"), F.max(session).alias("__high"))
        .where("__low = __high").select(F.col(request).alias("__request"), F.col("__low").alias("__owner"))
    )
    return events.join(owners, F.col(request) == F.col("__request"), "left").withColumn(session, F.coalesce(session, "__owner")).drop("__request", "__owner")


def reconcile(reports: DataFrame, group: list[str], fields: list[str], order: list[Column], whole: list[list[str]] | None = None) -> DataFrame:
    """One row per group: each field's first known value by precedence; ``whole`` sets of fields from one report."""
    ordering = F.struct(*order)
    first = [F.min_by(f, F.when(F.col(f).isNotNull(), ordering)).alias(f) for f in fields]
    sets = []
    for i, columns in enumerate(whole or []):
        value = F.struct(*[F.col(c) for c in columns])
        sets.append(F.min_by(value, F.when(F.coalesce(*[F.col(c) for c in columns]).isNotNull(), ordering)).alias(f"__set{i}"))
    out = reports.groupBy(*group).agg(F.count("*").alias("members"), *first, *sets)
    spread = [F.col(f"__set{i}.{c}").alias(c) for i, columns in enumerate(whole or []) for c in columns]
    return out.select(*group, "members", *fields, *spread)


def disagreements(reports: DataFrame, group: list[str], channel: str, fields: list[str], order: list[Column]) -> DataFrame:
    """(group..., field, values): fields on which channels report more than one value."""
    text = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    long = reports.select(*group, channel, F.struct(*order).alias("__order"), F.explode(text).alias("f")).select(*group, channel, "__order", "f.field", "f.value").where("value is not null")
    per_channel = long.groupBy(*group, "field", channel).agg(F.min_by("value", "__order").alias("value"))
    return (
        per_channel.groupBy(*group, "field").agg(F.array_sort(F.collect_set("value")).alias("values"), F.count("*").alias("channels"))
        .where(F.size("values") > 1)
    )


def explain_fields(reports: DataFrame, group: list[str], channel: str, fields: list[str], order: list[Column]) -> DataFrame:
    """(group..., field, winner, candidates): who said what, in order of precedence."""
    text = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    long = reports.select(*group, channel, F.struct(*order).alias("rank"), F.explode(text).alias("f"))
    listed = long.groupBy(*group, "f.field").agg(F.array_sort(F.collect_list(F.when(F.col("f.value").isNotNull(), F.struct("rank", F.col(channel).alias("channel"), F.col("f.value").alias("value"))))).alias("candidates"))
    return listed.withColumn("winner", F.get("candidates", F.lit(0))["value"])


def best_row(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The best row per request: the largest output, then one with a cache split, then the later one."""
    return one_per_key(rows, keys, order)


def carry_forward(rows: DataFrame, by: list[str], order: list[str], column: str) -> DataFrame:
    """The last known value up to each row, as a turn that a user row opens."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(w))


def counter_requests(rows: DataFrame, by: list[str], order: list[str], total: str, signature: str, exact: str) -> DataFrame:
    """Rows of a cumulative counter that stand for a request: a changed total with a new signature, before any exact record."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    changed = F.col(total).isNotNull() & ~F.col(total).eqNullSafe(F.lag(total).over(w))
    nth = F.row_number().over(Window.partitionBy(*by, signature).orderBy(*order))
    seen_exact = F.coalesce(F.max(F.col(exact).cast("int")).over(before), F.lit(0)) > 0
    return rows.withColumn("__ok", changed & (nth == 1) & ~seen_exact & ~F.col(exact)).where("__ok").drop("__ok")


def backfill(rows: DataFrame, by: list[str], order: list[str], column: str) -> DataFrame:
    """A missing value from the first known one of its turn."""
    first = F.first(column, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn(column, F.coalesce(column, first))


def session_remainder(sessions: DataFrame, requests: DataFrame, session: str, total: str, amount: str) -> DataFrame:
    """What a session's stored total leaves after its requests; an over-count is flagged, not negative."""
    sums = requests.groupBy(session).agg(F.sum(amount).alias("__sum"))
    return sessions.join(sums, session, "left").select(
        session,
        F.greatest(F.col(total) - F.coalesce("__sum", F.lit(0)), F.lit(0)).alias("overhead"),
        (F.coalesce("__sum", F.lit(0)) > F.col(total)).alias("over_count"),
    )


def without_replaced(events: DataFrame, key: str, replaces: str, source: str, generation: str, observed: str) -> DataFrame:
    """Requests that nothing supersedes: no later row replaces their key, re-reads them, or split them anew."""
    # Ids are not unique by promise, so rows are ranked rather than joined to themselves.
    gone = events.where(F.col(replaces).isNotNull()).select(F.col(replaces).alias(key)).distinct()
    live = events.join(gone, key, "left_anti")
    by_key = Window.partitionBy(key, source)
    newest = F.max(observed).over(by_key)
    last_split = F.max_by(generation, observed).over(by_key)
    return live.withColumn("__newest", newest).withColumn("__split", last_split).where((F.col(observed) == F.col("__newest")) | F.col(generation).eqNullSafe(F.col("__split"))).drop("__newest", "__split")


def largest_figure(readings: DataFrame, session: list[str], reading: str, amount: str) -> DataFrame:
    """The largest cumulative figure of a session; the shares of one reading add up first."""
    sums = readings.groupBy(*session, reading).agg(F.sum(amount).alias(amount))
    return sums.groupBy(*session).agg(F.max_by(reading, F.struct(amount, reading)).alias(reading), F.max(amount).alias(amount))


def split_figure(figures: DataFrame, amount: str, per_model: str, tolerance: float = 1e-6) -> DataFrame:
    """A figure split by its map of costs per model where the map adds up to it, else whole."""
    total = F.aggregate(F.map_values(per_model), F.lit(0.0), lambda a, x: a + x)
    adds_up = F.coalesce((F.size(per_model) > 0) & (F.abs(total - F.col(amount)) <= tolerance * F.greatest(F.lit(1.0), F.abs(F.col(amount)))), F.lit(False))
    pieces = F.when(adds_up, F.transform(F.map_entries(per_model), lambda e: F.struct(e["key"].alias("model"), e["value"].alias("amount")))).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("model"), F.col(amount).cast("double").alias("amount"))))
    return figures.withColumn("__piece", F.explode(pieces)).withColumn("model", F.col("__piece.model")).withColumn(amount, F.col("__piece.amount")).drop("__piece", per_model)


def overlaps_keyed(reports: DataFrame, session: str, channel: str, key: str) -> DataFrame:
    """Keyless reports whose session has keyed reports of another channel: they stay unresolved."""
    keyed = reports.where(F.col(key).isNotNull()).groupBy(session).agg(F.min(channel).alias("__low"), F.max(channel).alias("__high")).withColumnRenamed(session, "__s")
    free = reports.where(F.col(key).isNull())
    return free.join(keyed, F.col(session) == F.col("__s")).where((F.col("__low") != F.col(channel)) | (F.col("__high") != F.col(channel))).drop("__s", "__low", "__high")
