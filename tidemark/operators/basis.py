"""A selection pinned under an id that follows from its rows, and pages of it that cost the same however far in.

A basis is written once, dealt and sorted by its order. A cursor names the basis and the last
row it has shown; the next page is what stands behind that row, so nothing before it is
sorted again, and the first column's bound lets the scan pass over the files before it. A
cursor of another basis is refused.
"""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_PAGE = 500


def basis_id(rows: DataFrame) -> str:
    """The same for the same rows in any order; rows that stand there twice count twice."""
    one = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`").alias("x"))) for c in rows.columns])
    other = F.xxhash64(F.lit("other"), *[F.to_json(F.struct(F.col(f"`{c}`").alias("x"))) for c in rows.columns])
    state = rows.agg(F.count("*"), F.sum(one.cast("decimal(38,0)")), F.sum(other.cast("decimal(38,0)"))).first()
    return rows.sparkSession.range(1).select(F.substring(F.sha2(F.lit("|".join([*rows.columns, *map(str, state)])), 256), 1, 24)).first()[0]


class Basis:
    """Rows at ``root``/basis=``id`` in the order of ``order``, columns ascending with nulls last; together they must tell rows apart."""

    def __init__(self, spark: SparkSession, root: str, name: str, order: list[str]) -> None:
        self.spark, self.name, self.order = spark, name, order
        self.rows = spark.read.parquet(f"{root}/basis={name}")

    @classmethod
    def pin(cls, rows: DataFrame, root: str, order: list[str]) -> Basis:
        """Freezes the rows; to pin the same ones again changes nothing."""
        name = basis_id(rows)
        ascending = [F.col(c).asc_nulls_last() for c in order]
        rows.repartitionByRange(*ascending).sortWithinPartitions(*ascending).write.mode("ignore").parquet(f"{root}/basis={name}")
        return cls(rows.sparkSession, root, name, order)

    def _key(self) -> Column:
        """The order as one value that compares like it and goes through JSON unchanged."""
        fields = []
        for i, c in enumerate(self.order):
            exact = F.unix_micros(F.col(c).cast("timestamp")) if self.rows.schema[c].dataType.typeName().startswith("timestamp") else F.col(c)
            fields += [F.col(c).isNull().alias(f"n{i}"), exact.alias(f"v{i}")]
        return F.struct(*fields)

    def _last(self, cursor: str) -> dict:
        try:
            given = json.loads(base64.urlsafe_b64decode(cursor.encode()))
            name, last = given["basis"], given["last"]
        except (ValueError, KeyError, TypeError) as e:
            raise ValueError("this is no cursor") from e
        if name != self.name:
            raise ValueError("the cursor is of another basis")
        return last

    def page(self, cursor: str | None = None, limit: int = 50) -> DataFrame:
        """The next ``limit`` rows, 1 to ``MAX_PAGE``, after the cursor, or the first ones."""
        if not 1 <= limit <= MAX_PAGE:
            raise ValueError(f"a page has 1 to {MAX_PAGE} rows")
        rows, first = self.rows, self.order[0]
        if cursor is not None:
            last = self._last(cursor)
            key = self._key()
            kind = rows.select(key.alias("k")).schema["k"].dataType.simpleString()
            if "v0" in last:
                bound = F.lit(last["v0"])
                kind0 = rows.schema[first].dataType
                bound = F.timestamp_micros(bound).cast(kind0) if kind0.typeName().startswith("timestamp") else bound.cast(kind0)
                rows = rows.where((F.col(first) >= bound) | F.col(first).isNull())
            rows = rows.where(key > F.from_json(F.lit(json.dumps(last)), kind))
        return rows.orderBy(*[F.col(c).asc_nulls_last() for c in self.order]).limit(limit)

    def cursor_after(self, page: DataFrame) -> str | None:
        """The cursor behind a page's last row; None for a page without rows."""
        last = page.select(F.to_json(F.max(self._key()))).first()[0]
        return base64.urlsafe_b64encode(json.dumps({"basis": self.name, "last": json.loads(last)}).encode()).decode() if last else None
