"""Session logs in JSON lines: one reader, a grammar per tool.

A reader returns events in the envelope of ``tidemark.schemas`` and one coverage row a file.
Lines that are no JSON objects are counted as rejected and never stop a file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import names, tokens
from tidemark.operators.facts import one_per_key
from tidemark.schemas import conform, event_id


@dataclass(frozen=True)
class Grammar:
    """Where a tool's lines keep what a request needs: JSON paths, first known one wins."""

    tool: str
    session: tuple[str, ...]
    request: tuple[str, ...]
    at: tuple[str, ...]
    model: tuple[str, ...]
    cwd: tuple[str, ...]
    input_fresh: tuple[str, ...]
    output: tuple[str, ...]
    cache_read: tuple[str, ...]
    cache_write: tuple[str, ...]
    turn_when: str | None = None
    replaces: tuple[str, ...] = ()


GRAMMARS = {
    "claude-code": Grammar("claude-code", ("$.sessionId",), ("$.message.id", "$.requestId", "$.uuid"), ("$.timestamp",), ("$.message.model",), ("$.cwd",), ("$.message.usage.input_tokens",), ("$.message.usage.output_tokens",), ("$.message.usage.cache_read_input_tokens",), ("$.message.usage.cache_creation_input_tokens",), "$.type = user"),
    "codex": Grammar("codex", ("$.payload.session_id", "$.payload.id"), ("$.payload.response_id",), ("$.timestamp",), ("$.payload.model",), ("$.payload.cwd",), ("$.payload.info.last_token_usage.input_tokens",), ("$.payload.info.last_token_usage.output_tokens",), ("$.payload.info.last_token_usage.cached_input_tokens",), (), "$.payload.type = user_message"),
    "pi": Grammar("pi", ("$.sessionId",), ("$.id",), ("$.timestamp",), ("$.message.model", "$.model"), ("$.cwd",), ("$.message.usage.input",), ("$.message.usage.output",), ("$.message.usage.cacheRead",), ("$.message.usage.cacheWrite",), "$.message.role = user"),
    "omp": Grammar("omp", ("$.sessionId",), ("$.id",), ("$.timestamp",), ("$.message.model", "$.model"), ("$.cwd",), ("$.message.usage.input",), ("$.message.usage.output",), ("$.message.usage.cacheRead",), ("$.message.usage.cacheWrite",), "$.message.role = user"),
    "deepseek": Grammar("deepseek", ("$.session",), ("$.slot",), ("$.at",), ("$.model",), ("$.cwd",), ("$.usage.input",), ("$.usage.output",), ("$.usage.cacheRead",), (), None, ("$.replaces",)),
    "cursor-cli": Grammar("cursor-cli", ("$.session_id",), ("$.call_id", "$.request_id"), ("$.timestamp_ms",), ("$.model",), ("$.cwd",), ("$.usage.inputTokens",), ("$.usage.outputTokens",), ("$.usage.cacheReadTokens",), ("$.usage.cacheWriteTokens",), "$.type = user"),
}


def _get(paths: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.get_json_object("value", p) for p in paths]) if paths else F.lit(None).cast("string")


def _instant(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{12,}$"), F.timestamp_millis(text.try_cast("bigint"))).otherwise(F.try_to_timestamp(text))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, value): the lines of all files, gzip as well. ``pos`` orders the lines of a file."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return lines.select("path", F.posexplode(F.split("value", "\r?\n")).alias("pos", "value")).where(F.trim("value") != "")


def parse_lines(lines: DataFrame, grammar: Grammar) -> DataFrame:
    """Rows of (path, pos, tool, session, request, turn, at, model_raw, cwd, tokens..., ok)."""
    count = lambda p: _get(p).try_cast("double")
    parsed = lines.select(
        "path", "pos", "value", F.lit(grammar.tool).alias("tool"), _get(grammar.session).alias("session"), _get(grammar.request).alias("request"), _instant(_get(grammar.at)).alias("at"),
        _get(grammar.model).alias("model_raw"), _get(grammar.cwd).alias("cwd"), count(grammar.input_fresh).alias("input_fresh"), count(grammar.output).alias("output"),
        count(grammar.cache_read).alias("cache_read"), count(grammar.cache_write).alias("cache_write"), _get(grammar.replaces).alias("replaces"), F.col("value").rlike(r"^\s*\{.*\}\s*$").alias("ok"),
    )
    if grammar.turn_when:
        where, _, what = grammar.turn_when.partition(" = ")
        opens = F.get_json_object("value", where) == what
        order = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        parsed = parsed.withColumn("turn", F.last(F.when(opens, F.concat_ws(":", "session", "pos")), ignorenulls=True).over(order))
    else:
        parsed = parsed.withColumn("turn", F.lit(None).cast("string"))
    in_file = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    filled = [F.coalesce(c, F.last(c, ignorenulls=True).over(in_file)).alias(c) for c in ("session", "model_raw", "cwd")]
    return parsed.select(*[c for c in parsed.columns if c not in ("session", "model_raw", "cwd")], *filled)


def requests(parsed: DataFrame) -> DataFrame:
    """One row a request: most output, then a cache split, then the later line."""
    usable = parsed.where("ok and request is not null and coalesce(input_fresh, output) is not null")
    order = [F.desc_nulls_last("output"), F.when(F.col("cache_read").isNotNull(), 0).otherwise(1), F.desc("path"), F.desc("pos")]
    best = one_per_key(usable, ["tool", "session", "request"], order)
    gone = usable.where("replaces is not null").select("tool", "session", F.col("replaces").alias("request")).distinct()
    return best.join(gone, ["tool", "session", "request"], "left_anti")


def to_events(rows: DataFrame, channel: str = "session-file") -> DataFrame:
    key = tokens.request_key(F.col("tool"), F.col("session"), F.col("request"), F.lit(None).cast("string"))
    kind = F.lit("ai.usage")
    shaped = rows.select(
        event_id(F.col("tool"), key, kind).alias("event_id"), F.col("tool").alias("adapter_id"), kind.alias("kind"), F.lit("2").alias("schema_version"),
        F.col("at").alias("occurred_at"), F.col("at").alias("observed_at"), F.lit("local").alias("origin"), key.alias("upstream_key"),
        F.struct(F.col("cwd").alias("worktree")).alias("context"), F.struct(F.col("request").alias("request_id"), F.col("session").alias("session_id"), F.col("turn").alias("turn_id")).alias("identity"),
        F.struct("tool", F.lit(channel).alias("channel"), names.infer_maker(F.col("model_raw")).alias("provider"), names.infer_via(F.col("model_raw")).alias("via"), names.normalize_model(F.col("model_raw")).alias("model"), "model_raw", "cwd").alias("ai"),
        F.struct("input_fresh", "output", "cache_read", "cache_write", key.alias("request_key")).alias("usage"),
    )
    return conform(shaped)


def read_sessions(spark: SparkSession, path: str, tool: str) -> tuple[DataFrame, DataFrame]:
    """(events, coverage) of a tool's session files."""
    parsed = parse_lines(read_lines(spark, path), GRAMMARS[tool])
    rejected = F.count_if(~F.col("ok"))
    coverage = parsed.groupBy("path").agg(F.count("*").alias("rows"), rejected.alias("rejected")).select(
        F.lit(tool).alias("adapter_id"), "path", F.when(F.col("rejected") > 0, "partial").otherwise("complete").alias("state"), "rows", "rejected"
    )
    return to_events(requests(parsed)), coverage
