"""Requests priced from date-versioned rate tables. Prices are rows, never constants here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.tokens import round_half_up, sum_known
from tidemark.operators.asof import version_at

PER_MILLION = 1_000_000.0
# Multiples of the input rate where one maker lists no cache-write rates.
CACHE_WRITE_DEFAULTS = {"anthropic": (1.25, 2.0)}


def context_tier(tiers: Column, prompt: Column) -> Column:
    """The last tier whose threshold the whole prompt exceeds, or null."""
    return F.get(F.reverse(F.filter(tiers, lambda t: prompt > t["above"])), F.lit(0))


def write_split(total: Column, five: Column, hour: Column) -> tuple[Column, Column]:
    """(5-minute, 1-hour) cache writes; what no share claims counts as 5-minute."""
    known5, known1 = F.coalesce(five, F.lit(0)), F.coalesce(hour, F.lit(0))
    return known5 + F.greatest(F.coalesce(total, F.lit(0)) - known5 - known1, F.lit(0)), known1


def cache_write_rates(input_rate: Column, listed5: Column, listed1: Column, maker: Column) -> tuple[Column, Column]:
    five, hour = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, (m5, m1) in CACHE_WRITE_DEFAULTS.items():
        five = F.when(maker == name, input_rate * m5).otherwise(five)
        hour = F.when(maker == name, input_rate * m1).otherwise(hour)
    rate5 = F.coalesce(listed5, five, input_rate)
    return rate5, F.coalesce(listed1, hour, rate5)


def token_line(count: Column, usd_per_million: Column, multiplier: Column) -> Column:
    """Rounded to 1e-9 a line; null where there is nothing to price."""
    return F.when(count > 0, round_half_up(count * usd_per_million * multiplier / PER_MILLION))


def price_lines(lines: list[Column]) -> Column:
    return round_half_up(sum_known(*lines))


def tier_multiplier(requests: DataFrame, multipliers: DataFrame, on: list[str]) -> DataFrame:
    """Service-tier and speed multipliers from a dated table; ``unpriced_tier`` where the table has no row for a set tier."""
    joined = requests.join(multipliers, on, "left")
    tier = F.lower(F.trim(F.col("service_tier")))
    plain = F.coalesce(tier, F.lit("")).isin("", "standard", "default", "auto", "on_demand")
    return joined.withColumn("unpriced_tier", F.when(~plain & F.col("multiplier").isNull(), tier)).withColumn("multiplier", F.when(plain, F.lit(1.0)).otherwise(F.coalesce("multiplier", F.lit(1.0))))


def lookup_price(requests: DataFrame, prices: DataFrame, keys: str, ts: str, request_id: str) -> DataFrame:
    """The price in force from the best sheet: the lowest sheet rank, then the first of the request's keys."""
    tried = requests.select(request_id, F.col(ts).alias("__ts"), F.posexplode(keys).alias("key_pos", "model_key"))
    sheets = prices.select("sheet_rank", "model_key").distinct()
    hits = tried.join(sheets, "model_key")
    priced = version_at(hits, prices, ["sheet_rank", "model_key"], "__ts", "effective_from", ["input", "output", "cached_input"])
    hit = F.struct("model_key", "sheet_rank", "input", "output", "cached_input")
    best = priced.groupBy(request_id).agg(F.min_by(hit, F.struct("sheet_rank", "key_pos")).alias("hit"))
    return requests.join(best, request_id, "left").select(*requests.columns, "hit.*")


def estimate(kind_local: Column, has_usage: Column, has_parts: Column, hit: Column, usd: Column) -> Column:
    """struct(usd, method, reason): local runs cost nothing, and every missing price has its reason."""
    row = lambda u, m, r: F.struct(u.cast("double").alias("usd"), F.lit(m).alias("method"), F.lit(r).alias("reason"))
    none = F.lit(None)
    return (
        F.when(kind_local, row(F.lit(0.0), "local", None))
        .when(~has_usage, row(none, None, "no-usage"))
        .when(~has_parts, row(none, None, "total-only"))
        .when(~hit, row(none, None, "model-unpriced"))
        .otherwise(row(usd, "price-book", None))
    )


def unit_line(count: Column, usd_per_unit: Column) -> Column:
    """A charge by count (web searches, premium requests); null where nothing was counted or no price is known."""
    return F.when(count > 0, round_half_up(count * usd_per_unit))


def unpriced_units(count: Column, usd_per_unit: Column) -> Column:
    """Counted units that no price is known for: with any the estimate is not complete."""
    return (F.coalesce(count, F.lit(0)) > 0) & usd_per_unit.isNull()


def unit_charges(lines: list[tuple[Column, Column]]) -> tuple[Column, Column]:
    """(usd, complete) of charges by count: what is priced adds up, and anything counted without a price leaves it incomplete."""
    usd, complete = F.lit(0.0), F.lit(True)
    for count, usd_per_unit in lines:
        usd = usd + F.coalesce(unit_line(count, usd_per_unit), F.lit(0.0))
        complete = complete & ~unpriced_units(count, usd_per_unit)
    return round_half_up(usd), complete


def with_fallback(estimated: Column, list_price: Column, premium_usd: Column) -> Column:
    """``estimated`` as struct(usd, method, reason, complete), or without a price the tool's own list price, else its premium requests.

    Premium requests leave the estimate incomplete; the reason of the missing price stays.
    """
    row = lambda usd, method, complete: F.struct(usd.cast("double").alias("usd"), method.alias("method"), estimated["reason"].alias("reason"), complete.alias("complete"))
    return (
        F.when(estimated["method"].isNotNull(), row(estimated["usd"], estimated["method"], F.lit(True)))
        .when(list_price.isNotNull(), row(list_price, F.lit("list-price"), F.lit(True)))
        .when(premium_usd.isNotNull(), row(premium_usd, F.lit("premium-requests"), F.lit(False)))
        .otherwise(row(F.lit(None), F.lit(None).cast("string"), F.lit(False)))
    )


def peak_multiplier(ts: Column, since: Column, hours: list[tuple[int, int]], multiplier: float) -> Column:
    """``multiplier`` within the hours (UTC, end exclusive) of weekdays from ``since`` on, else 1. The session's time zone must be UTC."""
    within = F.lit(False)
    for start, end in hours:
        within |= (F.hour(ts) >= start) & (F.hour(ts) < end)
    return F.when((ts >= since) & (F.weekday(ts) < 5) & within, F.lit(multiplier)).otherwise(F.lit(1.0))


def expand_prices(prices: DataFrame, observed: DataFrame, model: str, keys: str) -> DataFrame:
    """``prices`` and, for each observed model without rows of its own, the rows of the first of its ``keys`` that has some."""
    listed = prices.select(F.col(model).alias("__key")).distinct()
    unknown = observed.groupBy(model).agg(F.first(keys).alias(keys)).join(listed, F.col(model) == F.col("__key"), "left_anti")
    tried = unknown.select(F.col(model).alias("__model"), F.posexplode(keys).alias("__pos", "__key")).join(listed, "__key")
    best = tried.groupBy("__model").agg(F.min_by("__key", "__pos").alias("__key"))
    found = prices.join(best, F.col(model) == F.col("__key"))
    return prices.unionByName(found.withColumn(model, F.col("__model")).select(*prices.columns))


def sheet_from_catalogs(catalogs: DataFrame, model: str, fetched: str, rates: list[str]) -> DataFrame:
    """Price versions from daily catalogs: a row where a model's rates change; the first is open at its start."""
    w = Window.partitionBy(model).orderBy(fetched)
    now = F.struct(*rates)
    before = F.lag(now).over(w)
    nth = F.row_number().over(w)
    changed = catalogs.withColumn("__first", nth == 1).withColumn("__changed", (nth == 1) | ~now.eqNullSafe(before)).where("__changed")
    return changed.select(model, F.when(~F.col("__first"), F.col(fetched)).alias("effective_from"), *rates)


def ledgers(estimate_usd: Column, billed: Column, tool: Column) -> list[Column]:
    """Three columns side by side. There is no column of their sum."""
    return [estimate_usd.alias("estimate_usd"), billed.alias("billed_usd"), tool.alias("tool_usd")]


def book_or_table(book: Column, reason: Column, table: Column) -> Column:
    """The user's table only where the book does not know the model."""
    return F.coalesce(book, F.when(reason == "model-unpriced", table))


def subscription_share(own: Column, plan_amount: Column, period_total: Column) -> Column:
    return F.when(period_total > 0, round_half_up(plan_amount * own / period_total, 6))
