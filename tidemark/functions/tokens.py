"""Columns over token counters and money. Unknown is null, never zero."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = ("input_fresh", "cache_read", "cache_write", "output")


def round_half_up(x: Column, digits: int = 9) -> Column:
    """Half towards plus infinity, unlike ``round``."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / F.lit(scale)


def sum_known(*parts: Column) -> Column:
    """The sum of what is known; null where nothing is."""
    total = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0)) for p in parts])
    return F.when(F.coalesce(*parts).isNotNull(), total)


def cache_writes(total: Column, five_minutes: Column, one_hour: Column) -> Column:
    """The larger of the reported total and the sum of its two known shares."""
    split = sum_known(five_minutes, one_hour)
    return F.when(split.isNull(), total).otherwise(F.greatest(total, split))


def token_total(total: Column, *parts: Column) -> Column:
    return F.coalesce(total, sum_known(*parts))


def token_categories(tokens: dict[str, Column]) -> Column:
    """(category, value) pairs of the known counters, for ``explode``."""
    pairs = F.array(*[F.struct(F.lit(k).alias("category"), v.cast("double").alias("value")) for k, v in tokens.items()])
    return F.filter(pairs, lambda p: p["value"].isNotNull())


def fresh_input(gross: Column, cache_read: Column, cache_write: Column) -> Column:
    """Gross input without its cached shares, at least 0; null unless all three are known."""
    known = gross.isNotNull() & cache_read.isNotNull() & cache_write.isNotNull()
    return F.when(known, F.greatest(gross - cache_read - cache_write, F.lit(0)))


def usd_of(amount: Column, currency: Column) -> Column:
    return F.when(F.upper(currency) == "USD", amount)


def is_foreign(amount: Column, currency: Column) -> Column:
    return amount.isNotNull() & F.coalesce(F.upper(currency) != "USD", F.lit(True))


def figure_ledger(kind: Column) -> Column:
    """Which ledger a money figure belongs to: a charge is billed, any other is the tool's own."""
    return F.when(kind == "charge", "billed").when(kind.isNotNull(), "tool")


def split_integer(tokens: Column, shares: Column) -> Column:
    """An integer split by an array of shares that add to 1; the first piece takes the remainder."""
    floors = F.transform(shares, lambda s: F.floor(tokens * s).cast("long"))
    given = F.aggregate(floors, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(floors, lambda x, i: F.when(i == 0, x + tokens - given).otherwise(x))


def digest_id(ids: Column, prefix: str = "uf_", digits: int = 24) -> Column:
    """A stable id of a set of ids: the head of the digest of its sorted members."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.array_join(F.array_sort(F.array_distinct(ids)), "\n"), 256), 1, digits))


def split_generation(placements: Column) -> Column:
    return F.substring(F.sha2(F.array_join(F.array_sort(placements), "\n"), 256), 1, 12)


def request_key(tool: Column, session: Column, request: Column, generation: Column) -> Column:
    """Request id within its session, else generation id within its session, else null."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    own = F.coalesce(F.concat(F.lit("r:"), blank(request)), F.concat(F.lit("g:"), blank(generation)))
    return F.when(own.isNotNull(), F.concat_ws("|", tool, F.coalesce(blank(session), F.lit("-")), own))


def match_keys(**keys: Column) -> Column:
    """All keys under which reports of one request can meet, blanks left out."""
    return F.array_compact(F.array(*[F.concat(F.lit(f"{k}:"), F.nullif(F.trim(v), F.lit(""))) for k, v in keys.items()]))
