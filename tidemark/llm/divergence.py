"""How far the sources of a language are from each other, from joint histograms of counts.

A term's share in a group depends on its count there alone, so the divergence of two groups is
a sum over the distinct pairs of counts, times how many terms have them. The terms' counts are
gathered once, terms with equal counts in all sources are one row with a multiplicity, and for
each pair of sources the combinations (count, count) are tallied from the terms that both have.
The cells with a zero are implied: what a source's own histogram has beyond them, and all
terms that neither has. The function is evaluated once per combination.

Pairs are of sources: a row of the result each. No step pairs documents or terms.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

MIN_DOCUMENTS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
#: Distinct terms that a task holds before it sends them on.
HELD_TERMS = 400_000
#: ASCII letters and all that is beyond ASCII, in UTF-8 after lower-casing.
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_COUNTED = ["lang", "source", "term", "n", "docs"]


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group.

    Terms are stretches of letters and of what is beyond ASCII; only A-Z are lower-cased.
    Nulls count as empty strings. Each task counts what it reads, ``HELD_TERMS`` terms at a
    time, so only sums are shuffled: once, by language and term.
    """

    def emit(held: dict[tuple[str, str], tuple[Counter, Counter]]):
        for (lang, source), (n, seen) in held.items():
            terms = pa.array(n.keys(), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang], pa.string()).take(at := pa.array([0] * len(n), pa.int8())), pa.array([source], pa.string()).take(at), terms, pa.array(n.values(), pa.int64()), pa.array([seen[t] for t in n], pa.int64())], _COUNTED
            )

    def run(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for t, lang, source in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                n, seen = held.setdefault((lang, source), (Counter(), Counter()))
                words = _TERM.findall(t.encode().lower())
                size -= len(n)
                n.update(words)
                seen.update(set(words))
                size += len(n)
                if size >= HELD_TERMS:
                    yield from emit(held)
                    held, size = {}, 0
        yield from emit(held)

    filled = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((text, "text"), (lang, "lang"), (source, "source"))])
    partial = filled.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return partial.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(lang, term, n, counts): the terms in enough documents of their language.

    ``counts`` is an array of (source, n) by source, with one entry per source that has the
    term; the result has the square of the number of sources in rows, so a row of it is small.
    """
    return (
        counts.groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("counts"))
        .where(F.col("docs") >= min_documents)
        .select("lang", "term", "n", "counts")
    )


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE x (n + 2) / (total + 2 x terms)), exact at any size of the counts."""
    over = (F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)"), (total + terms * 2).cast("decimal(20,0)"))
    return F.lit(1) + F.call_function("div", *over)


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def group_sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, terms, lang_total): a row for each group that occurs, even without terms."""
    groups = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    totals = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", zero("total"), zero("terms"), zero("lang_total"))


def joint_histograms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, n_a, n_b, times) of each pair of sources a < b of a language, zero cells included."""
    pair = ["lang", "a", "b"]
    profiles = kept.groupBy("lang", "counts").agg(F.count("*").alias("times"))
    first = profiles.select("lang", "counts", "times", F.posexplode("counts").alias("i", "x"))
    both = (
        first.select("lang", "times", "x", F.explode(F.expr("slice(counts, i + 2, size(counts))")).alias("y"))
        .groupBy("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b"))
        .agg(F.sum("times").alias("times"))
    )
    both, _ = materialize(both, "joint-counts")
    own = first.groupBy("lang", F.col("x.source").alias("source"), F.col("x.n").alias("n")).agg(F.sum("times").alias("times"))
    pairs = groups.select("lang", F.col("source").alias("a"), "terms").join(groups.select("lang", F.col("source").alias("b")), "lang").where("a < b")
    a_side = pairs.select(*pair).join(own.withColumnsRenamed({"source": "a", "n": "n_a"}), ["lang", "a"])
    b_side = pairs.select(*pair).join(own.withColumnsRenamed({"source": "b", "n": "n_b"}), ["lang", "b"])
    zero, cell = F.lit(0).cast("long"), [*pair, "n_a", "n_b", "times"]
    # What one source has less what both have; and all terms less those that either has.
    implied = [
        a_side.withColumn("n_b", zero),
        b_side.withColumn("n_a", zero),
        both.withColumn("n_b", zero).withColumn("times", -F.col("times")),
        both.withColumn("n_a", zero).withColumn("times", -F.col("times")),
        pairs.select(*pair, zero.alias("n_a"), zero.alias("n_b"), F.col("terms").alias("times")),
        a_side.select(*pair, zero.alias("n_a"), zero.alias("n_b"), (-F.col("times")).alias("times")),
        b_side.select(*pair, zero.alias("n_a"), zero.alias("n_b"), (-F.col("times")).alias("times")),
        both.select(*pair, zero.alias("n_a"), zero.alias("n_b"), "times"),
    ]
    cells = both
    for part in implied:
        cells = cells.select(*cell).union(part.select(*cell))
    return cells.groupBy(*cell[:-1]).agg(F.sum("times").alias("times")).where("times > 0")


def audit_sources(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` holds every other source of the
    language by divergence, ``term`` the terms that the source uses more than its language.

    Null texts, languages and sources are empty strings; a group without terms has its pairs,
    of value 0 if its language keeps no term at all. Ties go by item, repeated rows count as
    often as they stand there, very long texts are read whole, extra columns are not read, and
    an empty table gives an empty result.
    """
    counts = term_counts(docs)
    kept, _ = materialize(kept_terms(counts, min_documents), "kept-terms")
    groups, _ = materialize(group_sizes(docs, kept), "groups")
    sized = groups.select("lang", "source", "total", "terms")
    cells = (
        joint_histograms(kept, groups)
        .join(sized.withColumnsRenamed({"source": "a", "total": "total_a"}), ["lang", "a"])
        .join(sized.drop("terms").withColumnsRenamed({"source": "b", "total": "total_b"}), ["lang", "b"])
    )
    value = divergence(share(F.col("n_a"), F.col("total_a"), F.col("terms")), share(F.col("n_b"), F.col("total_b"), F.col("terms")))
    summed = cells.groupBy("lang", "a", "b").agg(F.sum(value * F.col("times")).alias("value"))
    # A language that keeps no term has no cells; its pairs are zero.
    none = groups.where("terms = 0").select("lang", "source")
    summed = summed.union(none.withColumnRenamed("source", "a").join(none.withColumnRenamed("source", "b"), "lang").where("a < b").select("lang", "a", "b", F.lit(0).cast("long")))
    sides = F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in ("ab", "ba")])
    by_rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = summed.select("lang", F.inline(sides), "value").withColumn("rank", F.row_number().over(by_rank))
    p = share(F.col("c.n"), F.col("total"), F.col("terms"))
    q = share(F.col("n"), F.col("lang_total"), F.col("terms"))
    terms = (
        kept.select("lang", "term", "n", F.explode("counts").alias("c"))
        .select("lang", F.col("c.source").alias("source"), "term", "n", "c")
        .join(groups, ["lang", "source"])
        .select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
        .where("p > q")
        .select("lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(by_rank))
        .where(F.col("rank") <= top)
    )
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").union(columns(terms, "term"))


ORACLE_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT row_no) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS nl FROM kept GROUP BY lang),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (
  SELECT g.lang, g.source, coalesce(v, 0) AS v, nl, coalesce(t.n, 0)::HUGEINT AS total
  FROM (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents) g
  LEFT JOIN langs USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM counts GROUP BY lang, source) t USING (lang, source)),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * g.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 2)) // (g.nl + 2 * g.v) AS q
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.source, b.source, 0 FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source WHERE a.v = 0),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
