"""Exports and reports: CSV with several layouts, JSON pages, XML tests, catalogs, OTLP, databases, frames."""

from __future__ import annotations

import sqlite3
import tempfile

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Header words of the usage export, lower case, by the role they play.
CSV_ROLES = {
    "at": ("date", "timestamp"), "model": ("model",), "kind": ("kind",), "input": ("input (w/o cache write)", "input", "tokens"),
    "cache_write": ("input (w/ cache write)",), "cache_read": ("cache read",), "output": ("output tokens", "output"),
    "total": ("total tokens",), "cost": ("cost", "cost ($)"), "requests": ("requests",),
}


def read_usage_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected). The header tells the layout; a cost cell is an amount or a word such as "Included".

    Raises for a header without a date and a model: that is no usage export.
    """
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option("quote", '"').option("escape", '"').csv(path)
    by_name = {c.replace("﻿", "").strip().lower(): c for c in raw.columns}
    role = {r: next((by_name[n] for n in names if n in by_name), None) for r, names in CSV_ROLES.items()}
    if not role["at"] or not role["model"]:
        raise ValueError(f"no usage export: {raw.columns}")
    cell = lambda r: F.trim(F.col(f"`{role[r]}`")) if role[r] else F.lit(None).cast("string")
    number = lambda r: F.regexp_replace(cell(r), "[,$]", "").try_cast("double")
    rows = raw.select(
        F.coalesce(*[F.try_to_timestamp(cell("at"), F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")]).alias("at"),
        cell("model").alias("model"), cell("kind").alias("kind"), *[number(r).alias(r) for r in ("input", "cache_write", "cache_read", "output", "total", "requests")],
        number("cost").alias("cost_usd"), F.when(number("cost").isNull(), cell("cost")).alias("cost_word"),
    )
    ledger = F.when(F.col("cost_usd").isNull(), None).when(F.lower("kind").contains("included"), "api-equivalent").otherwise("charge")
    ok = F.col("at").isNotNull() & F.col("model").isNotNull()
    return rows.where(ok).withColumn("ledger", ledger), rows.where(~ok)


def read_dashboard(spark: SparkSession, path: str) -> DataFrame:
    """One row a usage event of dashboard pages, once per row key however many pages repeat it."""
    schema = "usageEventsDisplay array<struct<timestamp:string,model:string,kind:string,isChargeable:boolean,requestId:string,conversationId:string,tokenUsage:struct<inputTokens:double,outputTokens:double,cacheReadTokens:double,cacheWriteTokens:double,totalCents:double>>>"
    page = spark.read.option("multiLine", True).schema(schema).json(path)
    e = page.select(F.explode("usageEventsDisplay").alias("e")).select("e.*")
    row_key = F.coalesce("requestId", F.sha2(F.to_json(F.struct(*e.columns)), 256))
    return e.withColumn("row_key", row_key).withColumn("at", F.timestamp_millis(F.col("timestamp").try_cast("bigint"))).dropDuplicates(["row_key"]).withColumn("ledger", F.when(F.col("isChargeable"), "charge").otherwise("api-equivalent"))


def page_gaps(pages: DataFrame, order: str, first: str, last: str) -> DataFrame:
    """Pages that do not begin where the page before them ended."""
    from pyspark.sql import Window

    before = F.lag(last).over(Window.orderBy(order))
    return pages.withColumn("expected", before + 1).where(F.col(first) != F.col("expected"))


def read_provider_pages(spark: SparkSession, path: str) -> DataFrame:
    """Account buckets of either provider layout: (start, end, model, input, output, amount)."""
    raw = spark.read.text(path, wholetext=True)
    buckets = F.from_json(F.get_json_object("value", "$.data"), "array<struct<start_time:bigint,end_time:bigint,starting_at:string,ending_at:string,results:array<map<string,string>>>>")
    b = raw.select(F.explode(buckets).alias("b")).select("b.*").withColumn("r", F.explode("results"))
    first = lambda *keys: F.coalesce(*[F.col("r")[k].try_cast("double") for k in keys])
    return b.select(
        F.coalesce(F.timestamp_seconds("start_time"), F.try_to_timestamp("starting_at")).alias("start"), F.coalesce(F.timestamp_seconds("end_time"), F.try_to_timestamp("ending_at")).alias("end"),
        F.col("r")["model"].alias("model"), first("input_tokens", "uncached_input_tokens").alias("input"), first("output_tokens").alias("output"), first("amount").alias("amount"), F.lit("account-bucket").alias("scope"),
    )


def read_junit(spark: SparkSession, path: str) -> DataFrame:
    """One row a test suite: counts, and the outcome they tell."""
    from tidemark.functions.text import outcome

    raw = spark.read.format("xml").option("rowTag", "testsuite").schema("_name string, _tests long, _failures long, _errors long, _skipped long, _time double").load(path)
    none = F.lit(None).cast("string")
    return raw.select(F.col("_name").alias("suite"), F.col("_tests").alias("tests"), F.col("_failures").alias("failed"), F.col("_errors").alias("errors"), outcome(none, F.col("_failures"), F.col("_errors"), none).alias("outcome"))


def read_tsc(spark: SparkSession, path: str) -> DataFrame:
    """Compiler messages: file, line, column, severity, code."""
    pattern = r"^(.+?)[(:](\d+)[,:](\d+)\)?(?::| -) (error|warning) (TS\d+): (.*)$"
    part = lambda i: F.regexp_extract("value", pattern, i)
    lines = spark.read.text(path).withColumn("value", F.regexp_replace("value", "\x1b\\[[0-9;]*m", "")).where(F.col("value").rlike(pattern))
    return lines.select(part(1).alias("file"), part(2).cast("int").alias("line"), part(3).cast("int").alias("col"), part(4).alias("severity"), part(5).alias("code"), part(6).alias("message"))


def read_git_log(spark: SparkSession, path: str) -> DataFrame:
    """(sha, at, subject, file, added, deleted) of ``log --numstat`` records split by RS and US."""
    records = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", "\x1e")).alias("r")).where(F.trim("r") != "")
    head = F.split(F.split_part("r", F.lit("\n"), F.lit(1)), "\x1f")
    stat = r"^(\d+|-)\t(\d+|-)\t(.+)$"
    rows = records.select(F.get(head, F.lit(0)).alias("sha"), F.timestamp_seconds(F.get(head, F.lit(1)).try_cast("bigint")).alias("at"), F.get(head, F.lit(2)).alias("subject"), F.explode_outer(F.filter(F.split("r", "\n"), lambda x: x.rlike(stat))).alias("s"))
    return rows.select("sha", "at", "subject", F.regexp_extract("s", stat, 3).alias("file"), F.regexp_extract("s", stat, 1).try_cast("long").alias("added"), F.regexp_extract("s", stat, 2).try_cast("long").alias("deleted"))


def read_reflog(spark: SparkSession, path: str) -> DataFrame:
    """(worktree, at, kind, from, to): HEAD transitions, oldest first within a worktree file."""
    from tidemark.functions.names import reflog_transition

    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("worktree"), F.split("value", "\x1f").alias("p"))
    t = lines.select("worktree", F.timestamp_seconds(F.regexp_extract(F.get("p", F.lit(0)), r"@\{(\d+)", 1).try_cast("bigint")).alias("at"), reflog_transition(F.trim(F.get("p", F.lit(1)))).alias("t"))
    return t.where("at is not null and t is not null").select("worktree", "at", "t.*")


def read_authorship(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, prompt, lines): attested line ranges such as ``1-4,7`` of each file, counted."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split_part("value", F.lit("---"), F.lit(1)).alias("head"))
    rows = lines.select("path", F.explode(F.split("head", "\n(?=\\S)")).alias("block"))
    entries = rows.select("path", F.trim(F.split_part("block", F.lit("\n"), F.lit(1))).alias("file"), F.explode(F.regexp_extract_all("block", F.lit(r"(?m)^\s+(\S+ [0-9,-]+)$"), F.lit(1))).alias("entry"))
    size = F.aggregate(F.split(F.split_part("entry", F.lit(" "), F.lit(2)), ","), F.lit(0), lambda n, r: n + F.when(r.contains("-"), F.split_part(r, F.lit("-"), F.lit(2)).cast("int") - F.split_part(r, F.lit("-"), F.lit(1)).cast("int") + 1).otherwise(1))
    return entries.select("path", "file", F.split_part("entry", F.lit(" "), F.lit(1)).alias("prompt"), size.alias("lines"))


def read_otlp(spark: SparkSession, path: str) -> DataFrame:
    """Log records of OTLP JSON bodies with their attributes as a map."""
    value = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"
    record = f"array<struct<timeUnixNano:string,attributes:array<struct<key:string,value:{value}>>>>"
    raw = spark.read.option("multiLine", True).schema(f"resourceLogs array<struct<scopeLogs:array<struct<logRecords:{record}>>>>").json(path)
    r = raw.select(F.explode("resourceLogs").alias("a")).select(F.explode("a.scopeLogs").alias("b")).select(F.explode("b.logRecords").alias("r"))
    text = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))
    attributes = F.map_from_entries(F.transform("r.attributes", lambda a: F.struct(a["key"], text(a["value"]))))
    return r.select(F.timestamp_micros((F.col("r.timeUnixNano").try_cast("bigint") / 1000).cast("bigint")).alias("at"), attributes.alias("attributes"))


def read_catalog(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """(model_key, input, output, cached_input) in USD a million tokens, from either public JSON layout."""
    raw = spark.read.text(path, wholetext=True)
    if layout == "per-token":
        models = F.from_json("value", "map<string, map<string, string>>")
        cost = lambda k: F.col("v")[k].try_cast("double") * 1e6
        return raw.select(F.explode(models).alias("model_key", "v")).select("model_key", cost("input_cost_per_token").alias("input"), cost("output_cost_per_token").alias("output"), cost("cache_read_input_token_cost").alias("cached_input")).where("input is not null")
    providers = F.from_json("value", "map<string, struct<models:map<string, struct<cost:struct<input:double,output:double,cache_read:double>>>>>")
    m = raw.select(F.explode(providers).alias("provider", "p")).select("provider", F.explode("p.models").alias("model_key", "m"))
    return m.select("model_key", F.col("m.cost.input").alias("input"), F.col("m.cost.output").alias("output"), F.col("m.cost.cache_read").alias("cached_input")).where("input is not null")


def read_zstd_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, value): lines of files of concatenated zstd frames."""

    def run(batches):
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read().decode("utf-8", "replace")
                lines = [x for x in text.split("\n") if x.strip()]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines), pa.string()), pa.array(range(len(lines)), pa.int32()), pa.array(lines, pa.string())], ["path", "pos", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, pos int, value string")


def read_sqlite(spark: SparkSession, path: str, sql: str, schema: str) -> DataFrame:
    """Rows of a query over each SQLite file, read from its bytes on the executors."""
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], schema).schema}
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(kinds[n]) for n in names]

    def run(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                with tempfile.NamedTemporaryFile(suffix=".db") as copy:
                    copy.write(content)
                    copy.flush()
                    rows = sqlite3.connect(f"file:{copy.name}?mode=ro", uri=True).execute(sql).fetchall()
                columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def wire_fields(raw: bytes) -> list[tuple[int, int, int | bytes]]:
    """(field, wire type, value) of one protobuf message; stops at the first malformed byte."""
    out, at = [], 0

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while i < len(raw):
            value |= (raw[i] & 127) << shift
            shift += 7
            i += 1
            if not raw[i - 1] & 128:
                return value, i
        return -1, i

    while at < len(raw):
        tag, at = varint(at)
        kind = tag & 7
        if tag < 8 or kind not in (0, 1, 2, 5):
            break
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else (8 if kind == 1 else 4, at)
            if size < 0 or at + size > len(raw):
                break
            value, at = raw[at : at + size], at + size
        out.append((tag >> 3, kind, value))
    return out
