"""Sessions folded to requests: titles, copied entries, repeated slots, checkpoints and nested usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.graph import lineage

#: Whose title counts first.
TITLE_RANK = {"custom": 0, "ai": 1, "agent": 2}


def best_title(rows: DataFrame, session: str, source: str, title: str, seq: str) -> DataFrame:
    """(session, title) of the best-ranked source; of one rank the last title counts. Other sources and blank titles count not at all."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in TITLE_RANK.items() for x in kv]), F.col(source))
    known = rows.withColumn("__rank", rank).where("__rank is not null").where(F.trim(title) != "")
    return known.groupBy(session).agg(F.min_by(title, F.struct("__rank", (-F.col(seq)).alias("last"))).alias(title))


def entry_owners(entries: DataFrame, parents: DataFrame) -> DataFrame:
    """(file, entry, seq, ownership) of session files: ``copied`` if an ancestor file holds the entry, ``duplicate`` if the file has it before, else ``own``.

    ``parents`` has (file, parent): a forked file and what it was forked from.
    """
    above = lineage(parents, "file", "parent").select(F.col("node").alias("file"), F.col("ancestor").alias("__above")).distinct()
    held = entries.select(F.col("file").alias("__above"), "entry").distinct()
    copied = above.join(held, "__above").select("file", "entry").distinct().withColumn("__copied", F.lit(True))
    nth = F.row_number().over(Window.partitionBy("file", "entry").orderBy("seq"))
    numbered = entries.select("file", "entry", "seq").withColumn("__nth", nth).join(copied, ["file", "entry"], "left")
    return numbered.select("file", "entry", "seq", F.when(F.col("__copied"), "copied").when(F.col("__nth") > 1, "duplicate").otherwise("own").alias("ownership"))


def slot_requests(rows: DataFrame, slot: list[str], seq: str, buckets: list[str], key: str) -> DataFrame:
    """The requests of slots (turn, step, attempt) with ``replaces``: the key of the record a changed one stands in for.

    A record whose buckets equal those of the one before it in its slot tells nothing new.
    """
    order = Window.partitionBy(*slot).orderBy(seq)
    value = F.struct(*buckets)
    new = rows.withColumn("__before", F.lag(value).over(order)).where(F.col("__before").isNull() | ~value.eqNullSafe(F.col("__before")))
    return new.withColumn("replaces", F.lag(key).over(order)).drop("__before")


def checkpoint_windows(rows: DataFrame, session: str, seq: str, start: str, total: str) -> DataFrame:
    """(session, start, end, total, kind) of a session's checkpoints.

    One checkpoint is a single window. If starts strictly rise, each is a window up to the next
    one with its own total. Otherwise totals are cumulative, and only the latest counts.
    """
    order = Window.partitionBy(session).orderBy(seq)
    every = Window.partitionBy(session)
    rising = F.coalesce(F.col(start) > F.lag(start).over(order), F.row_number().over(order) == 1)
    marked = rows.withColumn("__rising", rising).withColumn("__next", F.lead(start).over(order)).withColumn("__n", F.count("*").over(every)).withColumn("__last", F.row_number().over(Window.partitionBy(session).orderBy(F.desc(seq))) == 1)
    delta = F.min(F.col("__rising").cast("int")).over(every) == 1
    kind = F.when(F.col("__n") == 1, "single").when(F.col("__delta"), "delta").otherwise("cumulative")
    out = marked.withColumn("__delta", delta).withColumn("kind", kind).where("kind <> 'cumulative' or __last")
    return out.select(session, start, F.when(F.col("kind") == "delta", F.col("__next")).alias("end"), total, "kind")


def tree_requests(entries: DataFrame, entry: str, parts: dict[str, str]) -> DataFrame:
    """(entry, part, nth, usage): every request in a nested entry: its own, its tools', its subagents', in that order.

    ``parts`` maps a name to a column, a struct for one request or an array of them; all of one type.
    """
    is_list = {f.name: f.dataType.typeName() == "array" for f in entries.schema}

    def requests(name: str, column: str):
        values = F.filter(F.coalesce(F.col(column) if is_list[column] else F.array(F.col(column)), F.array()), lambda x: x.isNotNull())
        return F.transform(values, lambda x, n: F.struct(F.lit(name).alias("part"), n.alias("nth"), x.alias("usage")))

    every = F.concat(*[requests(name, column) for name, column in parts.items()])
    return entries.select(entry, F.explode(every).alias("x")).select(entry, "x.part", "x.nth", "x.usage")
