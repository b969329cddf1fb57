"""Values carried along the rows of a key in their order.

A key's rows are dealt by stretches of their position, so a hot key is as many tasks as it has
stretches: a window carries values inside a stretch, and what a stretch starts with comes from
one row per key and stretch. Rows with a null key carry within a stretch alone.

Where rows are in order by more than a number, ``at`` is a struct and ``stretch`` tells how
they are dealt; it must not fall where ``at`` rises. ``ahead`` goes from the last row to the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRETCH = 1 << 16


def _carried(df: DataFrame, by: list[str], at: Column, size: int, inside, end, over, stretch: Column | None = None, ahead: bool = False) -> DataFrame:
    """``df`` with the columns ``inside`` (name: window -> column), those that stretches start with joined to them."""
    dealt = df.withColumn("__at", at).withColumn("__stretch", F.floor(F.col("__at") / F.lit(size)) if stretch is None else stretch)
    order = F.desc if ahead else F.asc
    w = Window.partitionBy(*by, "__stretch").orderBy(order("__at"))
    before = Window.partitionBy(*by).orderBy(order("__stretch")).rowsBetween(Window.unboundedPreceding, -1)
    ends = dealt.groupBy(*by, "__stretch").agg(*[c.alias(f"__end_{n}") for n, c in end.items()])
    starts = ends.select(*by, "__stretch", *[over(F.col(f"__end_{n}"), before).alias(f"__start_{n}") for n in end])
    return dealt.select("*", *[c(w).alias(f"__in_{n}") for n, c in inside.items()]).join(starts, [*by, "__stretch"], "left")


def carry_last(df: DataFrame, by: list[str], at: Column, values: dict[str, Column], before: bool = False, size: int = STRETCH, stretch: Column | None = None, ahead: bool = False) -> DataFrame:
    """``df`` with the last known value of each expression up to each row, or before it.

    ``at`` is a number by which the rows of a key are in order, each its own; ``size`` is how
    much of it is a stretch. To look ahead give it with a minus.
    """
    end = F.min_by if ahead else F.max_by
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    held = df.select("*", *[v.alias(f"__v_{n}") for n, v in values.items()])
    value = {n: F.col(f"__v_{n}") for n in values}
    found = _carried(
        held, by, at, size,
        {n: (lambda w, v=v: F.last(v, ignorenulls=True).over(upto(w))) for n, v in value.items()},
        {n: end(v, F.when(v.isNotNull(), F.col("__at"))) for n, v in value.items()},
        lambda c, w: F.last(c, ignorenulls=True).over(w), stretch, ahead,
    )
    keep = [c for c in df.columns if c not in values]
    return found.select(*keep, *[F.coalesce(f"__in_{n}", f"__start_{n}").alias(n) for n in values])


def carry_max(df: DataFrame, by: list[str], at: Column, values: dict[str, Column], size: int = STRETCH) -> DataFrame:
    """``df`` with the greatest of each expression up to each row."""
    held = df.select("*", *[v.alias(f"__v_{n}") for n, v in values.items()])
    value = {n: F.col(f"__v_{n}") for n in values}
    found = _carried(
        held, by, at, size,
        {n: (lambda w, v=v: F.max(v).over(w.rowsBetween(Window.unboundedPreceding, 0))) for n, v in value.items()},
        {n: F.max(v) for n, v in value.items()},
        lambda c, w: F.max(c).over(w),
    )
    keep = [c for c in df.columns if c not in values]
    return found.select(*keep, *[F.greatest(f"__in_{n}", f"__start_{n}").alias(n) for n in values])


def carry_sum(df: DataFrame, by: list[str], at: Column, values: dict[str, Column], size: int = STRETCH, stretch: Column | None = None) -> DataFrame:
    """``df`` with the sum of each expression up to each row; nulls add nothing."""
    held = df.select("*", *[F.coalesce(v, F.lit(0)).alias(f"__v_{n}") for n, v in values.items()])
    value = {n: F.col(f"__v_{n}") for n in values}
    found = _carried(
        held, by, at, size,
        {n: (lambda w, v=v: F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, 0))) for n, v in value.items()},
        {n: F.sum(v) for n, v in value.items()},
        lambda c, w: F.sum(c).over(w), stretch,
    )
    keep = [c for c in df.columns if c not in values]
    return found.select(*keep, *[(F.col(f"__in_{n}") + F.coalesce(f"__start_{n}", F.lit(0))).alias(n) for n in values])
