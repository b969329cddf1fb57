"""Ledgers and readings: several sources tell of the same usage, and each figure counts once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The rank of a source that no precedence names, and the name of usage without a branch.
UNKNOWN_RANK = 10_000
NO_BRANCH = "(no branch)"


def ranked(rows: DataFrame, precedence: DataFrame, on: list[str]) -> DataFrame:
    """Rows with ``rank`` from a precedence table (*on, rank); what it doesn't name comes last."""
    return rows.join(precedence.select(*on, "rank"), on, "left").withColumn("rank", F.coalesce("rank", F.lit(UNKNOWN_RANK)))


def without_ledgered_figures(facts: DataFrame, ledgers: DataFrame, session: str, figure: str) -> DataFrame:
    """Facts whose session has a ledger of its own lose their per-request figure, which the ledger holds already."""
    has = ledgers.where(F.col(session).isNotNull()).select(F.col(session).alias("__s")).distinct().withColumn("__ledger", F.lit(True))
    return facts.join(has, F.col(session) == F.col("__s"), "left").withColumn(figure, F.when(F.col("__ledger").isNull(), F.col(figure))).drop("__s", "__ledger")


def account_remainder(observed: DataFrame, allocated: DataFrame, account: str, row_id: str, amount: str) -> DataFrame:
    """(account, observed, allocated, remainder, open_rows): what an account reported and no fact has taken.

    ``allocated`` names the rows that facts took; naming one twice takes it once.
    """
    taken = allocated.select(F.col(row_id).alias("__id")).distinct().withColumn("__taken", F.lit(True))
    held = observed.join(taken, F.col(row_id) == F.col("__id"), "left")
    is_open = F.col("__taken").isNull()
    return held.groupBy(account).agg(
        F.sum(amount).alias("observed"), F.coalesce(F.sum(F.when(~is_open, F.col(amount))), F.lit(0)).alias("allocated"),
        F.coalesce(F.sum(F.when(is_open, F.col(amount))), F.lit(0)).alias("remainder"), F.count_if(is_open).alias("open_rows"),
    )


def best_per_slot(rows: DataFrame, group: str, slot: list[str], order: list[Column]) -> DataFrame:
    """The best row of each group and slot, with ``collapsed``: how many others it stands for."""
    every = Window.partitionBy(group, *slot)
    return rows.withColumn("__n", F.row_number().over(every.orderBy(*order))).withColumn("collapsed", F.count("*").over(every) - 1).where("__n = 1").drop("__n")


def usage_ledger(rows: DataFrame, group: str, slot: list[str], order: list[Column], amount: str) -> DataFrame:
    """(slot, amount, groups, collapsed): each request's best row a slot, summed by slot.

    Rows without a group are unresolved and left out here; ``unresolved`` counts them.
    """
    best = best_per_slot(rows.where(F.col(group).isNotNull()), group, slot, order)
    return best.groupBy(*slot).agg(F.sum(amount).alias(amount), F.count("*").alias("groups"), F.sum("collapsed").alias("collapsed"))


def unresolved(rows: DataFrame, group: str, slot: list[str], amount: str) -> DataFrame:
    return rows.where(F.col(group).isNull()).groupBy(*slot).agg(F.sum(amount).alias(amount), F.count("*").alias("rows"))


def branch_of_group(rows: DataFrame, group: str, branch: str, rank: str) -> DataFrame:
    """(group, branch): the one branch its rows name, else the one its strongest rows name, else none."""
    best = rows.groupBy(group).agg(F.min(rank).alias("__best"))
    strongest = F.when(F.col(rank) == F.col("__best"), F.col(branch))
    seen = rows.join(best, group).groupBy(group).agg(F.min(branch).alias("lo"), F.max(branch).alias("hi"), F.min(strongest).alias("slo"), F.max(strongest).alias("shi"))
    return seen.select(group, F.when(F.col("lo") == F.col("hi"), F.col("lo")).when(F.col("slo") == F.col("shi"), F.col("slo")).alias(branch))


def by_branch(rows: DataFrame, assigned: DataFrame, group: str, branch: str, amount: str) -> DataFrame:
    """(branch, amount, rows): sums by the branch of each row's group, by its own where it has no group."""
    of_group = assigned.select(F.col(group).alias("__g"), F.col(branch).alias("__b"))
    name = F.when(F.col(group).isNotNull(), F.col("__b")).otherwise(F.col(branch))
    joined = rows.join(of_group, F.col(group) == F.col("__g"), "left").withColumn("__name", F.coalesce(name, F.lit(NO_BRANCH)))
    return joined.groupBy(F.col("__name").alias(branch)).agg(F.sum(amount).alias(amount), F.count("*").alias("rows"))


def preferred_readings(readings: DataFrame, key: list[str], tool: str, kind: str, order: list[Column]) -> DataFrame:
    """Readings once a key by precedence, and of each tool only those of its best source: (…, collapsed).

    ``rank`` is the precedence of the reading's source; of equal ranks the earlier by ``order``.
    """
    every = Window.partitionBy(*key)
    first = readings.withColumn("__n", F.row_number().over(every.orderBy("rank", *order))).withColumn("collapsed", F.count("*").over(every) - 1).where("__n = 1").drop("__n")
    best = first.groupBy(tool).agg(F.min(F.struct("rank", kind)).alias("__best")).select(F.col(tool).alias("__tool"), F.col(f"__best.{kind}").alias("__kind"))
    return first.join(best, F.col(tool).eqNullSafe(F.col("__tool"))).where(F.col(kind).eqNullSafe(F.col("__kind"))).drop("__tool", "__kind")


def tool_calls(reports: DataFrame, sessions: DataFrame, component: str, session: str, rank: str, calls: str) -> DataFrame:
    """(session, calls, source): distinct tool calls of a session.

    Reports of one call share a component and count once, by its best source; a session's own
    total counts only where no report of its calls is there.
    """
    best = reports.withColumn("__n", F.row_number().over(Window.partitionBy(component).orderBy(rank, session))).where("__n = 1")
    detail = best.groupBy(session).agg(F.count("*").alias(calls))
    alone = sessions.join(detail.select(session), session, "left_anti").groupBy(session).agg(F.max(calls).alias(calls))
    return detail.withColumn("source", F.lit("detail")).unionByName(alone.withColumn("source", F.lit("session")))


def session_usage(facts: DataFrame, session: str, scope: str, amounts: list[str]) -> DataFrame:
    """Totals per session over its requests; a sum of nothing known is null."""
    return facts.where((F.col(scope) == "request") & F.col(session).isNotNull()).groupBy(session).agg(F.count("*").alias("requests"), *[F.sum(a).alias(a) for a in amounts])


def usage_results(rows: DataFrame, category: str, amount: str, ledgers: dict[str, str]) -> DataFrame:
    """(name, value): tokens of each category, money of each ledger, and the number of requests; ledgers are never added."""
    tokens = rows.where(F.col(category).isNotNull()).groupBy(F.concat(F.lit("tokens."), F.col(category)).alias("name")).agg(F.sum(amount).cast("double").alias("value"))
    wide = rows.agg(F.count_distinct("request").cast("double").alias("requests"), *[F.sum(c).cast("double").alias(f"ledger.{n}") for n, c in ledgers.items()])
    names = wide.columns
    money = wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("value")) for n in names])).alias("x")).select("x.name", "x.value")
    return tokens.unionByName(money)
