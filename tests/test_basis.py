"""Pages of a pinned selection, put together, are the selection."""

import random
from datetime import datetime, timedelta

import pytest

from tidemark.operators.basis import Basis, basis_id
from tidemark.session import new_path

SCHEMA = "at timestamp, name string, score double, id long"


def made(n):
    rng = random.Random(n)
    start = datetime(2024, 1, 1)
    return [(rng.choice([None, start + timedelta(microseconds=rng.randrange(30))]), rng.choice([None, "", "a", "ä\n\"x"]), rng.choice([None, 0.1 + 0.2, -1e-300, 5.0]), i) for i in range(n)]


@pytest.mark.parametrize("order", [["at", "id"], ["name", "score", "id"], ["score", "at", "name", "id"]])
def test_pages_are_the_whole(spark, order):
    df = spark.createDataFrame(made(137), SCHEMA)
    basis = Basis.pin(df, new_path(spark, "basis"), order)
    cursor, got = None, []
    while True:
        page = basis.page(cursor, 20)
        rows = page.collect()
        if not rows:
            break
        got += rows
        cursor = basis.cursor_after(page)
    assert [r.id for r in got] == [r.id for r in df.orderBy(*[df[c].asc_nulls_last() for c in order]).collect()]


def test_a_later_page_sorts_no_more_than_a_page(spark):
    basis = Basis.pin(spark.createDataFrame(made(100), SCHEMA).where("at IS NOT NULL"), new_path(spark, "basis"), ["at", "id"])
    cursor = basis.cursor_after(basis.page(limit=40))
    plan = basis.page(cursor, 10)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject(limit=10" in plan and "GreaterThanOrEqual(at" in plan


def test_ids_follow_from_the_rows(spark):
    rows = made(50)
    df, turned = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rows[::-1], SCHEMA)
    root = new_path(spark, "basis")
    one = Basis.pin(df, root, ["id"])
    assert Basis.pin(turned.repartition(3), root, ["id"]).name == one.name == basis_id(df)
    assert basis_id(df.union(df.limit(1))) != one.name != basis_id(df.where("id > 0"))
    other = Basis.pin(df.where("id > 0"), root, ["id"])
    with pytest.raises(ValueError, match="another basis"):
        other.page(one.cursor_after(one.page()))
    for cursor, limit in (("nonsense", 5), ("e30=", 5), (None, 0), (None, 501)):
        with pytest.raises(ValueError):
            one.page(cursor, limit)
    assert one.cursor_after(one.page().where("false")) is None
