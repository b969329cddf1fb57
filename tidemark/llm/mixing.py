"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Each source's documents form a queue in a seeded shuffled order, and may be served
``max_epochs`` times over. A copy's virtual finish time is the source's cumulative words up to
its end, earlier copies included, over the source's target. All copies of all sources are
sorted globally by range of that time, and the running total of their words truncates the mix
at the total budget: copies before the crossing are whole, the crossing one is cut to the
words that are left, the rest is out. So each source ends within a document of its target.

Both running totals are prefix sums of two levels. A source's queue is dealt in buckets of the
shuffle order, whose number follows the source's documents, so one source with a third of all
rows is no larger a task than any other. The global order is dealt in ranges: the words of
each range tell which one the budget ends in, and only that range is summed row by row.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import free_names, materialize

WEIGHTS = (5, 2, 1)
BUDGET = Fraction(3, 2)
MAX_EPOCHS = 2
BUCKET_ROWS = 4096
RANGE_ROWS = 1 << 17
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, budget: Fraction = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``nth`` (the place by name), ``weight`` and ``target`` to (source, source_size, rows).

    Sources in code-point order, null last, take the weights in turn. They share
    ``budget`` x all words by weight; no target exceeds ``max_epochs`` x its source's words,
    and the excess goes to the others by weight until none is above. With the sources sorted
    by words per weight, the capped ones come first, so one running sum finds the level.
    The table has one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.col("nth") - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int"))
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    pool = F.lit(float(budget)) * F.sum("source_size").over(everything)
    ranked = (
        sources.withColumn("nth", F.row_number().over(by_name))
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("pool", pool)
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_after", F.sum("weight").over(after))
        # The level if every source before this one is capped; the first that stays below its cap sets it.
        .withColumn("level", (F.col("pool") - F.col("capped_before")) / F.col("weight_after"))
        .withColumn("free", F.col("cap") >= F.col("weight") * F.col("level"))
    )
    level = F.min(F.when(F.col("free"), F.struct("cap_ratio", "level"))).over(everything)["level"]
    return (
        ranked.withColumn("cap_ratio", F.col("cap") / F.col("weight"))
        .withColumn("the_level", level)
        .withColumn("target", F.when(F.col("weight") * F.coalesce("the_level", F.col("cap_ratio")) < F.col("cap"), F.col("weight") * F.col("the_level")).otherwise(F.col("cap").cast("double")))
        .select("source", "nth", "source_size", "rows", "weight", "target")
    )


def budget_words(words: int, budget: Fraction = BUDGET) -> int:
    return int(words * budget)


def crossing(copies: DataFrame, budget: int, range_rows: int = RANGE_ROWS) -> tuple | None:
    """(finish, nth, served, words left) of the copy in which the budget ends, or None if it never does.

    ``copies`` has (finish, nth, served, size), distinct in the first three. The driver gets a
    row for each range and the crossing one.
    """
    spark = copies.sparkSession
    order = ["finish", "nth", "served"]
    ranges = max(1, -(-copies.count() // range_rows))
    # The ranges are drawn by sampling, so they are written down once.
    dealt, _ = materialize(copies.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "mix-order")
    before = 0
    for r in dealt.groupBy("range").agg(F.sum("size").alias("words")).orderBy("range").collect():
        if before + r["words"] >= budget:
            inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
            found = dealt.where(F.col("range") == r["range"]).withColumn("upto", F.lit(before) + F.sum("size").over(inside))
            row = found.where(F.col("upto") >= budget).orderBy(*order).select(*order, (F.col("size") - F.col("upto") + budget).alias("left")).first()
            return tuple(row)
        before += r["words"]
    return None


def mix_plan(sized: DataFrame, seed: int = 42, weights=WEIGHTS, budget: Fraction = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(doc_id, source, size, row, source_size, target, taken, finish) from (doc_id, source, size, row).

    ``row`` is a hash of the row, which parts rows of one id; ``finish`` is the virtual finish
    time of the document's first copy. Null ids, sources and sizes of zero are rows like
    others; rows alike in all columns are interchangeable, so reruns agree. An empty table
    gives an empty result.
    """
    keyed = sized.withColumn("ticket", F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "row")))
    sources = keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    targets, _ = materialize(source_targets(sources, weights, budget, max_epochs), "targets")
    n = F.greatest(F.lit(1), F.ceil(F.col("rows") / BUCKET_ROWS)).cast("long")
    # The bucket keeps the order of the ticket: its first 32 bits, scaled to the source's bucket count.
    place = F.conv(F.substring("ticket", 1, 8), 16, 10).cast("long")
    joined = (
        keyed.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
        .withColumn("bucket", F.floor(place * n / F.lit(float(2**32))).cast("long"))
    )
    in_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        joined.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
        .withColumn("start", F.coalesce(F.sum("words").over(in_source), F.lit(0)))
        .select(F.col("source").alias("s"), F.col("bucket").alias("b"), "start")
    )
    in_bucket = Window.partitionBy("source", "bucket").orderBy("ticket", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed, _ = materialize(
        joined.join(buckets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .withColumn("end", F.col("start") + F.sum("size").over(in_bucket))
        .select("doc_id", "source", "size", "row", "nth", "source_size", "target", "end"),
        "queues",
    )
    served = lambda e: F.col("end") + F.col("source_size") * e
    copies = placed.where("size > 0").select("size", "nth", "target", F.explode(F.array(*[served(e) for e in range(max_epochs)])).alias("served"))
    words = targets.agg(F.sum("source_size")).first()[0] or 0
    cut = crossing(copies.select((F.col("served") / F.col("target")).alias("finish"), "nth", "served", "size"), budget_words(words, budget))

    def words_of(e: int) -> Column:
        if cut is None:
            return F.col("size")
        here = F.struct((served(e) / F.col("target")).alias("finish"), F.col("nth").alias("nth"), served(e).alias("served"))
        there = F.struct(F.lit(cut[0]).alias("finish"), F.lit(cut[1]).alias("nth"), F.lit(cut[2]).alias("served"))
        return F.when(here < there, F.col("size")).when(here == there, F.lit(cut[3])).otherwise(F.lit(0))

    taken = F.when(F.col("size") > 0, sum((words_of(e) for e in range(1, max_epochs)), words_of(0))).otherwise(F.lit(0))
    return placed.select(
        "doc_id", "source", "size", "row", "source_size", "target",
        taken.cast("long").alias("taken"),
        F.when(F.col("target") > 0, F.col("end") / F.col("target")).alias("finish"),
    )


def _row() -> Column:
    return F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 16)


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _row().alias("row"))


def mix_documents(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The op9 digest of ``documents``: one row per document row, in the order of the mix. Extra columns are not read."""
    sized, _ = materialize(_sized(docs), "sizes")
    plan = mix_plan(sized, seed)
    return plan.select("doc_id", "size", "source_size", "target", "taken", "finish").orderBy("finish", "doc_id")


def mixed_documents(docs: DataFrame, seed: int = 42, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself, with the columns of ``docs``: whole copies, and the cut document's first words.

    Every copy is a row; rows come in order of virtual finish time. A document that the mix
    takes no words of is left out, unless it has no words at all. Rows alike in id, source and
    text are copies of one document, whose other columns are those of one of them.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # Names that no column of the documents has.
    key, copy = free_names(docs.columns, "__key", "__copy")
    sized, _ = materialize(_sized(docs), "sizes")
    plan = mix_plan(sized, seed, max_epochs=max_epochs)
    size = F.col("size")
    words = [F.least(size, F.col("taken") - size * e) for e in range(max_epochs)]
    copies = F.array(*[F.struct(w.alias("words"), (F.col("finish") + F.col("source_size") * e / F.col("target")).alias("finish")) for e, w in enumerate(words)])
    served = F.when(size > 0, F.filter(copies, lambda c: c["words"] > 0)).otherwise(F.slice(copies, 1, 1))
    # One struct is the join key, as structs compare null fields as equal.
    taken = plan.select(F.struct("doc_id", "source", "size", "row").alias(key), F.explode(served).alias(copy))
    keyed = docs.withColumn(key, F.struct("doc_id", "source", word_count(F.col("text")).alias("size"), _row().alias("row")))
    whole = F.col(copy)["words"] == F.col(key)["size"]
    first_words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), 1, F.col(copy)["words"].cast("int")), " ")
    # Texts move twice, by key and into the order of the mix; the plan grows with the corpus, so it is not broadcast.
    out = keyed.dropDuplicates([key]).hint("merge").join(taken, key).withColumn("text", F.when(whole, F.col("text")).otherwise(first_words))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.orderBy(F.col(copy)["finish"], "doc_id").select(*columns)


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('42|' || coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, ''))[:16]) AS ticket
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sized GROUP BY source),
ratios AS (SELECT *, 2 * source_size AS cap, (2 * source_size)::DOUBLE / weight AS ratio FROM sources),
levels AS (
  SELECT *, (1.5 * sum(source_size) OVER ()
             - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ratios),
chosen AS (SELECT arg_min(level, ratio) AS level FROM levels WHERE cap >= weight * level),
targets AS (
  SELECT source, nth, source_size, CASE WHEN weight * chosen.level < cap THEN weight * chosen.level ELSE cap END::DOUBLE AS target
  FROM ratios, chosen),
placed AS (
  SELECT row_number() OVER () AS row_no, s.doc_id, s.size, t.nth, t.source_size, t.target,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.ticket, s.doc_id, s.size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT row_no, size, nth, upto + e * source_size AS served, (upto + e * source_size) / target AS finish
  FROM placed, (VALUES (0), (1)) epochs(e) WHERE size > 0),
served AS (
  SELECT row_no, greatest(0, least(size, (SELECT 3 * sum(size) // 2 FROM placed)
                                         - (sum(size) OVER (ORDER BY finish, nth, served ROWS UNBOUNDED PRECEDING) - size))) AS words
  FROM copies)
SELECT doc_id, size, source_size, target, coalesce(sum(words), 0)::BIGINT AS taken,
       CASE WHEN target > 0 THEN upto / target END AS finish
FROM placed LEFT JOIN served USING (row_no) GROUP BY row_no, doc_id, size, source_size, target, upto
"""
