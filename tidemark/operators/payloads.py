"""Usage payloads of any shape as rows: tokens by category, money by ledger, and what is not understood.

A payload is parsed once into a VARIANT, and an ordered table of shapes says where money may
stand in it; a new shape is a row of the table. Values that are no numbers, ledgers that are
unknown and payloads that are no JSON give no row and stop nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The ledgers that money stands in; they are never added. Tokens are a ledger of their own.
LEDGERS = ("charge", "list-price-estimate", "metered", "unallocated", "plan-included", "credits")
TOKENS = "tokens"
#: Token categories as payloads name them.
CATEGORIES = {"inputFresh": "input", "cacheRead": "cache-read", "cacheWrite": "cache-write", "output": "output", "reasoning": "reasoning", "total": "total"}
#: Units of a hundredth.
CENTS = "usd-cents"
ROW = "struct<ledger:string,category:string,raw_category:string,currency:string,method:string,value:double>"


@dataclass(frozen=True)
class Shape:
    """Money at ``value``: its ledger is fixed or stands at ``ledger_at``, where only ``allowed`` ones count."""

    raw: str
    value: str
    method: str
    ledger: str | None = None
    ledger_at: str | None = None
    allowed: tuple[str, ...] = LEDGERS
    currency_at: str | None = None
    method_at: str | None = None


# Where payloads keep money, in order.
SHAPES = (
    Shape("charge", "$.charge", "source-reported", ledger="charge", currency_at="$.currency"),
    Shape("listPriceEstimateUsd", "$.listPriceEstimateUsd", "estimated", ledger="list-price-estimate"),
    Shape("costUsd", "$.costUsd", "source-reported", ledger_at="$.costLedger", allowed=("metered", "unallocated"), currency_at="$.currency"),
    Shape("cost", "$.cost.value", "source-reported", ledger_at="$.cost.ledger", currency_at="$.cost.currency", method_at="$.cost.method"),
)


def _text(v: Column, path: str | None) -> Column:
    return F.try_variant_get(v, path, "string") if path else F.lit(None).cast("string")


def _number(v: Column, path: str) -> Column:
    """The number at a path; text and truth values are none, even where they could be cast."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"), F.try_variant_get(v, path, "double"))


def _row(ledger: Column, category: Column, raw: Column, currency: Column, method: Column, value: Column) -> Column:
    return F.struct(ledger.alias("ledger"), category.alias("category"), raw.alias("raw_category"), currency.alias("currency"), method.alias("method"), value.alias("value")).cast(ROW)


def money_rows(v: Column) -> Column:
    """The money of a payload by the table of shapes, as an array of rows."""
    rows = []
    for s in SHAPES:
        ledger = F.lit(s.ledger) if s.ledger else F.when(_text(v, s.ledger_at).isin(*s.allowed), _text(v, s.ledger_at))
        value = _number(v, s.value)
        row = _row(ledger, F.lit("other"), F.lit(s.raw), F.coalesce(_text(v, s.currency_at), F.lit("USD")), F.coalesce(_text(v, s.method_at), F.lit(s.method)), value)
        rows.append(F.when(ledger.isNotNull() & value.isNotNull(), row))
    return F.filter(F.array(*rows), lambda r: r.isNotNull())


def measurement_rows(v: Column) -> Column:
    """The entries of ``measurements`` that name a money ledger and a number; hundredths become dollars."""

    def one(m: Column) -> Column:
        ledger, value, cents = _text(m, "$.ledger"), _number(m, "$.value"), F.coalesce(_text(m, "$.unit") == CENTS, F.lit(False))
        row = _row(ledger, F.lit("other"), _text(m, "$.rawCategory"), F.when(cents, F.lit("USD")).otherwise(_text(m, "$.currency")), F.coalesce(_text(m, "$.method"), F.lit("source-reported")), F.when(cents, value / 100).otherwise(value))
        return F.when(ledger.isin(*LEDGERS) & value.isNotNull(), row)

    entries = F.coalesce(F.try_variant_get(v, "$.measurements", "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(F.transform(entries, one), lambda r: r.isNotNull())


def token_rows(v: Column) -> Column:
    """Known categories of ``tokens`` in their order; of hook payloads the fresh input is derived, not reported."""
    hook = F.coalesce(F.try_variant_get(v, "$.rawUsage", "variant").isNotNull(), F.lit(False))
    rows = []
    for name, category in CATEGORIES.items():
        value = _number(v, f"$.tokens.{name}")
        method = F.when(hook, F.lit("derived")).otherwise(F.lit("source-reported")) if category == "input" else F.lit("source-reported")
        rows.append(F.when(value.isNotNull(), _row(F.lit(TOKENS), F.lit(category), F.lit(category), F.lit(None), method, value)))
    return F.filter(F.array(*rows), lambda r: r.isNotNull())


def figure_rows(v: Column) -> Column:
    """The tool's own figure, which counts where a payload tells no other money."""
    value, charge = _number(v, "$.toolFigure.amount"), F.coalesce(_text(v, "$.toolFigure.kind") == "charge", F.lit(False))
    ledger = F.when(charge, F.lit("charge")).otherwise(F.lit("list-price-estimate"))
    row = _row(ledger, F.lit("other"), F.lit("toolFigure"), F.coalesce(_text(v, "$.toolFigure.currency"), F.lit("USD")), F.when(charge, F.lit("source-reported")).otherwise(F.lit("estimated")), value)
    return F.filter(F.array(F.when(value.isNotNull(), row)), lambda r: r.isNotNull())


def uncovered_fields(v: Column) -> Column:
    """Fields of ``rawUsage`` that nothing verified says the meaning of, sorted; none where all are said to be verified."""
    fields = F.map_keys(F.coalesce(F.try_variant_get(v, "$.rawUsage", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    listed = F.try_variant_get(v, "$.verifiedRawFields", "array<string>")
    verified = F.when(F.coalesce(F.try_variant_get(v, "$.semanticsVerified", "boolean"), F.lit(False)), F.coalesce(listed, fields)).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_except(fields, verified))


def normalize_usage(events: DataFrame, key: str = "event_id", payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(rows, uncovered) of events with a JSON payload.

    ``rows``: (key, nth, ledger, category, raw_category, currency, method, value) in the order
    tokens, then measurements, money by the table of shapes, or without either the tool's
    figure. ``uncovered``: (key, fields), where raw fields are not understood. Null payloads
    and those that are no JSON objects have neither.
    """
    parsed = events.select(key, F.try_parse_json(payload).alias("__v"))
    v = F.col("__v")
    money = F.concat(measurement_rows(v), money_rows(v))
    every = F.concat(token_rows(v), F.when(F.size(money) > 0, money).otherwise(figure_rows(v)))
    rows = parsed.select(key, F.posexplode(every).alias("nth", "row")).select(key, "nth", "row.*")
    return rows, parsed.select(key, uncovered_fields(v).alias("fields")).where(F.size("fields") > 0)
