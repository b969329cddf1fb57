"""Payloads of five shapes, made from the events, as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import payloads
from tidemark.plans.base import EVENTS_SQL, events, registry

QUERIES, ORACLES, query = registry()


def _payloads(spark, sf_dir):
    """One shape an event type: measurements, plain money, a cost with its ledger, a hook's raw usage, a tool's figure."""
    k, cents = F.col("k"), (F.col("k") * 100 + F.col("event_id") % 100).cast("long")
    entry = lambda ledger, value, unit=None, currency=None: F.struct(ledger.alias("ledger"), value.cast("long").alias("value"), F.lit(unit).cast("string").alias("unit"), F.lit(currency).cast("string").alias("currency"))
    shapes = {
        "purchase": F.to_json(F.struct(F.array(entry(F.when(k % 4 == 0, "nonsense").otherwise("charge"), cents, unit="usd-cents"), entry(F.lit("credits"), k, currency="CR")).alias("measurements"))),
        "view": F.to_json(F.struct(F.when(k % 3 == 0, k).alias("charge"), F.lit("EUR").alias("currency"), k.alias("costUsd"), F.when(k % 2 == 0, "metered").otherwise("else").alias("costLedger"))),
        "error": F.to_json(F.struct(F.struct(F.lit("unallocated").alias("ledger"), k.alias("value")).alias("cost"), F.struct(k.alias("inputFresh"), (k * 2).alias("output")).alias("tokens"))),
        "click": F.to_json(F.struct(F.struct(k.alias("b"), k.alias("a")).alias("rawUsage"), (k % 2 == 0).alias("semanticsVerified"), F.array(F.lit("a")).alias("verifiedRawFields"), F.struct(k.alias("inputFresh")).alias("tokens"))),
    }
    figure = F.when(k % 5 == 0, F.lit("no json")).otherwise(F.to_json(F.struct(F.struct(k.alias("amount"), F.when(k % 2 == 0, "charge").alias("kind")).alias("toolFigure"), F.lit("7").alias("charge"))))
    payload = figure
    for kind, shape in shapes.items():
        payload = F.when(F.col("event_type") == kind, shape).otherwise(payload)
    return events(spark, sf_dir).select("event_id", payload.alias("payload"))


@query(f"""WITH {EVENTS_SQL}, r AS (
  SELECT event_id, 0 AS o, 'charge' AS ledger, 'other' AS category, NULL AS raw_category, 'USD' AS currency, 'source-reported' AS method, (k * 100 + event_id % 100) / 100.0 AS value FROM e WHERE event_type = 'purchase' AND k % 4 <> 0
  UNION ALL SELECT event_id, 1, 'credits', 'other', NULL, 'CR', 'source-reported', k FROM e WHERE event_type = 'purchase'
  UNION ALL SELECT event_id, 0, 'charge', 'other', 'charge', 'EUR', 'source-reported', k FROM e WHERE event_type = 'view' AND k % 3 = 0
  UNION ALL SELECT event_id, 1, 'metered', 'other', 'costUsd', 'EUR', 'source-reported', k FROM e WHERE event_type = 'view' AND k % 2 = 0
  UNION ALL SELECT event_id, 0, 'tokens', 'input', 'input', NULL, 'source-reported', k FROM e WHERE event_type = 'error'
  UNION ALL SELECT event_id, 1, 'tokens', 'output', 'output', NULL, 'source-reported', k * 2 FROM e WHERE event_type = 'error'
  UNION ALL SELECT event_id, 2, 'unallocated', 'other', 'cost', 'USD', 'source-reported', k FROM e WHERE event_type = 'error'
  UNION ALL SELECT event_id, 0, 'tokens', 'input', 'input', NULL, 'derived', k FROM e WHERE event_type = 'click'
  UNION ALL SELECT event_id, 0, CASE WHEN k % 2 = 0 THEN 'charge' ELSE 'list-price-estimate' END, 'other', 'toolFigure', 'USD', CASE WHEN k % 2 = 0 THEN 'source-reported' ELSE 'estimated' END, k FROM e WHERE event_type = 'signup' AND k % 5 <> 0)
SELECT event_id, (row_number() OVER (PARTITION BY event_id ORDER BY o) - 1)::INT AS nth, ledger, category, raw_category, currency, method, value::DOUBLE AS value FROM r""")
def payload_rows(spark, sf_dir):
    rows, _ = payloads.normalize_usage(_payloads(spark, sf_dir))
    return rows


@query(f"WITH {EVENTS_SQL} SELECT event_id, CASE WHEN k % 2 = 0 THEN 'b' ELSE 'a,b' END AS fields FROM e WHERE event_type = 'click'")
def payload_fields_uncovered(spark, sf_dir):
    _, uncovered = payloads.normalize_usage(_payloads(spark, sf_dir))
    return uncovered.select("event_id", F.array_join("fields", ",").alias("fields"))
