"""Text functions over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import metrics, setjoin
from tidemark.plans.base import registry, table

QUERIES, ORACLES, query = registry()


@query("""SELECT doc_id, len(regexp_extract_all(t2, '\\[redacted:email\\]')) AS emails, len(regexp_extract_all(t, 'AKIA[0-9A-Z]{16}')) AS keys FROM (
SELECT doc_id, text AS t, regexp_replace(regexp_replace(text, '\\bAKIA[0-9A-Z]{16}\\b', '', 'g'), '[A-Za-z0-9_.%+-]+@[A-Za-z0-9_-]+(\\.[A-Za-z0-9_-]+)+', '[redacted:email]', 'g') AS t2 FROM documents)""")
def redact_counts(spark, sf_dir):
    clean = text.redact(F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", clean.alias("clean"))
    count = lambda what: F.regexp_count("clean", F.lit(rf"\[redacted:{what}\]"))
    return docs.select("doc_id", count("email").alias("emails"), count("aws-key").alias("keys"))


@query("""WITH c AS (SELECT n_nationkey, n_name, unnest(string_split(n_name, '')) AS ch FROM nation), g AS (SELECT n_nationkey, ch, count(*) AS n, any_value(length(n_name)) AS l FROM c WHERE ch <> '' GROUP BY 1, 2)
SELECT n_nationkey, floor(-sum(n::DOUBLE / l * log2(n::DOUBLE / l)) * 1e6 + 0.5) / 1e6 AS bits FROM g GROUP BY 1""")
def entropy_flag(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", (F.floor(text.entropy_bits(F.col("n_name")) * 1e6 + 0.5) / F.lit(1e6)).alias("bits"))


@query("""WITH w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, floor(len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) * 1e6 + 0.5) / 1e6 AS similarity FROM w a JOIN w b ON a.item_id < b.item_id WHERE len(list_intersect(a.w, b.w)) > 0""")
def word_jaccard_candidates(spark, sf_dir):
    # Pairs come from shared words, so items without a word in common never meet.
    items = table(spark, sf_dir, "benchmark").select("item_id", text.words(F.col("text")).alias("w"))
    words = items.select("item_id", F.explode("w").alias("word"))
    a, b = words.select(F.col("item_id").alias("a"), "word"), words.select(F.col("item_id").alias("b"), "word")
    shared = a.join(b, "word").where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    size = lambda c: items.select(F.col("item_id").alias(c), F.size("w").alias(f"n_{c}"))
    joined = shared.join(size("a"), "a").join(size("b"), "b")
    ratio = F.col("both").cast("double") / (F.col("n_a") + F.col("n_b") - F.col("both"))
    return joined.select("a", "b", (F.floor(ratio * 1e6 + 0.5) / F.lit(1e6)).alias("similarity"))


@query("""WITH w AS (SELECT doc_id AS id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents),
p AS (SELECT a.id AS id, b.id AS other, len(list_intersect(a.w, b.w)) AS shared, len(a.w) + len(b.w) AS n FROM w a JOIN w b ON a.id <> b.id AND len(a.w) > 0 AND len(b.w) > 0 AND least(len(a.w), len(b.w)) >= 0.6 * greatest(len(a.w), len(b.w)) - 1e-9),
s AS (SELECT *, shared::DOUBLE / (n - shared) AS similarity FROM p WHERE 5 * shared >= 3 * (n - shared))
SELECT id, other, floor(similarity * 1e6 + 0.5) / 1e6 AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other)::INT AS rank FROM s) WHERE rank <= 8""")
def similar_documents(spark, sf_dir):
    """Each document with the eight most alike by their words, three fifths at least."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.words(F.col("text")).alias("w"))
    return setjoin.similar_records(docs, "id", "w").select("id", "other", (F.floor(F.col("similarity") * 1e6 + 0.5) / F.lit(1e6)).alias("similarity"), "rank")


@query("""SELECT source, sum(len(string_split(text, chr(10))))::BIGINT AS lines, floor(sum(len(string_split(text, chr(10))))::DOUBLE / sum(sum(len(string_split(text, chr(10))))) OVER () * 1e6 + 0.5) / 1e6 AS share FROM documents GROUP BY 1""")
def line_share(spark, sf_dir):
    from pyspark.sql import Window

    lines = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.size(F.split("text", "\n"))).cast("long").alias("lines"))
    share = F.col("lines").cast("double") / F.sum("lines").over(Window.partitionBy())
    return lines.select("source", "lines", (F.floor(share * 1e6 + 0.5) / F.lit(1e6)).alias("share"))


@query()
def lcs_survival(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    edits = turns.select(F.col("conv_id").alias("path"), "turn", F.replace("text", F.lit(". "), F.lit("\n")).alias("body"), F.when(F.col("role") == "assistant", "ai").otherwise("human").alias("who"))
    return metrics.line_survival(edits, "path", "turn", "body", "who")


@query("""SELECT page_id, rtrim(regexp_replace(url, '^[a-z]+:/', ''), '/') AS path, starts_with(regexp_replace(url, '^[a-z]+:/', '') || '/', '/www.') AS inside FROM pages""")
def path_containment(spark, sf_dir):
    path = F.regexp_replace("url", "^[a-z]+:/", "")
    return table(spark, sf_dir, "pages").select("page_id", text.normalize_path(path).alias("path"), F.startswith(F.concat(path, F.lit("/")), F.lit("/www.")).alias("inside"))


@query("""SELECT event_id, [ '/repo/a', '/repo/b/c', '/x' ][1 + event_id % 3] AS last_path FROM events""")
def shell_paths(spark, sf_dir):
    commands = F.element_at(F.array(F.lit("cd /repo && cd ./a && ls"), F.lit("git -C b/c status"), F.lit("pushd '/x'; make")), (F.col("event_id") % 3 + 1).cast("int"))
    found = text.command_paths(commands, F.lit("/repo/"))
    return table(spark, sf_dir, "events").select("event_id", F.element_at(found, -1).alias("last_path"))
