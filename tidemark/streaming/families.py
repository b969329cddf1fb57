"""Facts kept by family, of which only those are derived anew that a change can touch.

A fact table is a log: each refresh adds the facts of the families it derived under a new
version, and an index row (family, version) for each. A family's facts are those of its latest
version, so a refresh writes what it derived and nothing else; ``compact`` rewrites the log
when it has grown. Facts are written before their index, which is what makes them count, so a
refresh that is cut off changes nothing and may run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidemark.operators.asof import interval_pairs
from tidemark.session import materialize

#: After all instants.
_EVER = "9999-12-31"


class FactLog:
    """Facts at ``path`` by the columns ``family``; ``schema`` is that of the facts, families included."""

    def __init__(self, spark: SparkSession, path: str, schema, family: list[str]) -> None:
        self.spark, self.path, self.family = spark, path.rstrip("/"), family
        self.schema = spark.createDataFrame([], schema).schema
        self._key = [f for f in self.schema if f.name in family]

    def _read(self, part: str, fields) -> DataFrame:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        try:
            return self.spark.read.schema(f"{columns}, version long").option("basePath", f"{self.path}/{part}").parquet(f"{self.path}/{part}")
        except AnalysisException:  # nothing was written yet
            return self.spark.createDataFrame([], f"{columns}, version long")

    def versions(self) -> DataFrame:
        """(family..., version): where each family's facts are."""
        return self._read("index", self._key).groupBy(*self.family).agg(F.max("version").alias("version"))

    def latest(self) -> int:
        return self._read("index", self._key).agg(F.max("version")).first()[0] or 0

    def read(self) -> DataFrame:
        """All families' current facts. Family values must not be null."""
        return self._read("facts", self.schema).join(self.versions(), [*self.family, "version"], "left_semi").select(*self.schema.names)

    def write(self, facts: DataFrame, families: DataFrame) -> int:
        """The facts of ``families``, whose former ones they replace; a family without facts has none from now on."""
        version = self.latest() + 1
        facts.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/facts/version={version}")
        families.select(*self.family).distinct().write.mode("overwrite").parquet(f"{self.path}/index/version={version}")
        return version

    def refresh(self, events: DataFrame, families: DataFrame, derive: Callable[[DataFrame], DataFrame]) -> int:
        """Derives the given families from their events and writes them; returns how many there were."""
        touched, _ = materialize(families.select(*self.family).dropna().distinct(), "touched-families")
        n = touched.count()
        if n:
            self.write(derive(events.join(touched, self.family, "left_semi")), touched)
        return n

    def compact(self, path: str) -> FactLog:
        """The same facts under one version at another path, to be read in place of this one."""
        new = FactLog(self.spark, path, self.schema, self.family)
        new.write(self.read(), self.versions())
        return new


def changed_stretches(before: DataFrame, after: DataFrame, by: list[str], at: str, value: str, order: list[str]) -> DataFrame:
    """(by..., start, end): where two histories differ, end exclusive.

    Both histories' instants cut the time into stretches; each takes what either history said
    last, and those that differ count, neighbours joined.
    """
    tagged = before.withColumn("__old", F.lit(True)).unionByName(after.withColumn("__old", F.lit(False))).where(F.col(at).isNotNull())
    said = F.struct(F.col(value).alias("value"))
    pick = lambda old: F.max_by(F.when(F.col("__old") == old, said), F.when(F.col("__old") == old, F.struct(*order)))
    cuts = tagged.groupBy(*by, F.col(at).alias("start")).agg(pick(True).alias("old"), pick(False).alias("new"))
    upto = Window.partitionBy(*by).orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    held = cuts.select(*by, "start", F.last("old", ignorenulls=True).over(upto)["value"].alias("old"), F.last("new", ignorenulls=True).over(upto)["value"].alias("new"))
    follow = Window.partitionBy(*by).orderBy("start")
    differ = held.withColumn("differ", ~F.col("old").eqNullSafe(F.col("new")))
    edges = differ.withColumn("before", F.lag("differ").over(follow)).where(F.col("before").isNull() | (F.col("before") != F.col("differ")))
    return edges.withColumn("end", F.coalesce(F.lead("start").over(follow), F.lit(_EVER).cast("timestamp"))).where("differ").select(*by, "start", "end")


def affected_families(events: DataFrame, changed: DataFrame, by: list[str], ts: str, family: list[str]) -> DataFrame:
    """(family...): the families with an event in a stretch that changed; dealt by key and stretch of time."""
    last = changed.withColumn("end", F.col("end") - F.expr("INTERVAL 1 MICROSECOND"))
    instants = events.select(*by, ts, F.struct(*family).alias("__family")).where(F.col(ts).isNotNull())
    return interval_pairs(instants, last, by, ts, "start", "end").select("__family.*").distinct()
