"""Payloads that are not as they should be."""

import json

from tidemark.operators import payloads


def test_odd_payloads(spark):
    given = [
        (1, None), (2, "no json"), (3, "[1, 2]"), (4, "{}"), (5, '"text"'),
        (6, json.dumps({"charge": "12", "costUsd": True, "costLedger": "metered"})),
        (7, json.dumps({"measurements": [1, None, {"ledger": "tokens", "value": 5}, {"ledger": "charge", "value": None}, {"ledger": "metered", "value": 2.5, "rawCategory": "x", "method": "estimated"}]})),
        (8, json.dumps({"measurements": "none", "toolFigure": {"amount": 3, "kind": "charge", "currency": "EUR"}})),
        (9, json.dumps({"charge": 0, "toolFigure": {"amount": 3}, "tokens": {"output": 1e300, "total": "9", "unknown": 4}})),
        (10, json.dumps({"rawUsage": {"z": 1, "a": {"b": 2}}, "semanticsVerified": True})),
        (11, json.dumps({"rawUsage": {"z": 1, "a": 2}, "semanticsVerified": True, "verifiedRawFields": ["z", "q"]})),
        (12, json.dumps({"rawUsage": [1]})),
    ]
    rows, uncovered = payloads.normalize_usage(spark.createDataFrame(given, "event_id long, payload string"))
    got = sorted((r.event_id, r.nth, r.ledger, r.category, r.raw_category, r.currency, r.method, r.value) for r in rows.collect())
    assert got == [
        (7, 0, "metered", "other", "x", None, "estimated", 2.5), (8, 0, "charge", "other", "toolFigure", "EUR", "source-reported", 3.0),
        (9, 0, "tokens", "output", "output", None, "source-reported", 1e300), (9, 1, "charge", "other", "charge", "USD", "source-reported", 0.0),
    ]
    assert {r.event_id: r.fields for r in uncovered.collect()} == {11: ["a"]}
