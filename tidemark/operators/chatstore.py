"""Chats kept as key-value rows: chat records and their messages by key prefix, as sessions, turns and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import absolute_path
from tidemark.operators.worktrees import resolve_paths

#: The key prefixes of chats and messages, the fields read of each, and what a message's type means.
CHAT_PREFIX, MESSAGE_PREFIX = "composerData", "bubbleId"
CHAT = (
    "createdAt string, lastUpdatedAt string, status string, unifiedMode string, totalLinesAdded bigint, totalLinesRemoved bigint, contextTokensUsed bigint, contextTokenLimit bigint, "
    "modelConfig struct<modelName: string>, usageData map<string, struct<costInCents: double, amount: bigint>>, trackedGitRepos string, workspaceIdentifier string"
)
MESSAGE = "type int, createdAt string, requestId string, modelInfo struct<modelName: string>, tokenCount struct<inputTokens: bigint, outputTokens: bigint>, toolFormerData struct<name: string, status: string>"
ROLES = {1: "user", 2: "assistant"}


def _instant(c: Column) -> Column:
    """Milliseconds or ISO text."""
    return F.coalesce(F.timestamp_millis(c.try_cast("bigint")), c.try_cast("timestamp"))


def _readable(value: Column) -> Column:
    return F.try_parse_json(value).isNotNull() & value.rlike(r"^\s*\{")


def store_rows(rows: DataFrame) -> DataFrame:
    """(store, kind, chat, message, value) of rows (store, key, value): kind chat, message, or unreadable where the value is no JSON object; other keys are dropped."""
    part = lambda n: F.get(F.split("key", ":"), F.lit(n))
    kind = F.when((part(0) == CHAT_PREFIX) & part(1).isNotNull(), "chat").when((part(0) == MESSAGE_PREFIX) & part(2).isNotNull(), "message")
    keyed = rows.select("store", kind.alias("kind"), part(1).alias("chat"), part(2).alias("message"), "value").where("kind is not null")
    return keyed.withColumn("kind", F.when(F.coalesce(_readable(F.col("value")), F.lit(False)), F.col("kind")).otherwise("unreadable"))


def store_chats(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """(store, chat, data, header): each chat that has a record or a header (store, chat, value), parsed; of several the greatest value counts."""
    data = store_rows(rows).where("kind = 'chat'").groupBy("store", "chat").agg(F.from_json(F.max("value"), CHAT).alias("data"))
    head = headers.where("chat is not null").groupBy("store", "chat").agg(F.from_json(F.max(F.when(_readable(F.col("value")), F.col("value"))), CHAT).alias("header"))
    return data.join(head, ["store", "chat"], "full_outer")


def _field(name: str) -> Column:
    return F.coalesce(f"data.{name}", f"header.{name}")


def chat_sessions(chats: DataFrame) -> DataFrame:
    """One row a chat: a field is its record's, else its header's. The tokens are how full the context is, no spend."""
    return chats.select(
        "store", "chat", _instant(_field("createdAt")).alias("created"), _instant(_field("lastUpdatedAt")).alias("updated"), _field("unifiedMode").alias("mode"), F.col("data.status").alias("status"),
        F.col("data.modelConfig.modelName").alias("model"), _field("totalLinesAdded").alias("lines_added"), _field("totalLinesRemoved").alias("lines_removed"),
        F.col("data.contextTokensUsed").alias("context_tokens"), F.col("data.contextTokenLimit").alias("context_limit"),
    )


def chat_usage(chats: DataFrame) -> DataFrame:
    """(store, chat, at, model, cents, requests) of what a chat's record meters by model; entries that tell neither are dropped."""
    each = chats.select("store", "chat", _instant(_field("lastUpdatedAt")).alias("at"), F.explode("data.usageData").alias("model", "x"))
    return each.select("store", "chat", "at", "model", F.col("x.costInCents").alias("cents"), F.col("x.amount").alias("requests")).where("cents is not null or requests is not null")


def chat_turns(rows: DataFrame, chats: DataFrame) -> DataFrame:
    """(store, chat, message, at, role, model, request, tool, tool_status, input, output, unknown) of messages whose chat is known.

    Token counts that are all zero were not recorded; ``unknown`` says why there are none. Of
    rows of one key the greatest value counts.
    """
    said = store_rows(rows).where("kind = 'message'").groupBy("store", "chat", "message").agg(F.from_json(F.max("value"), MESSAGE).alias("m"))
    known = said.join(chats.select("store", "chat"), ["store", "chat"], "left_semi")
    used_in, used_out = F.col("m.tokenCount.inputTokens"), F.col("m.tokenCount.outputTokens")
    unknown = F.when(used_in.isNull() & used_out.isNull(), "absent").when((F.coalesce(used_in, F.lit(0)) == 0) & (F.coalesce(used_out, F.lit(0)) == 0), "zero")
    role = F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), F.col("m.type"))
    return known.select(
        "store", "chat", "message", _instant(F.col("m.createdAt")).alias("at"), role.alias("role"), F.col("m.modelInfo.modelName").alias("model"), F.col("m.requestId").alias("request"),
        F.col("m.toolFormerData.name").alias("tool"), F.col("m.toolFormerData.status").alias("tool_status"), F.when(unknown.isNull(), used_in).alias("input"), F.when(unknown.isNull(), used_out).alias("output"), unknown.alias("unknown"),
    )


def chat_worktrees(chats: DataFrame, worktrees: DataFrame) -> DataFrame:
    """(store, chat, repo, worktree): the worktree that holds the first of a chat's paths that any holds; none, no row.

    Its paths are the absolute ones among the texts in its repositories, then in its workspace.
    """
    texts = F.concat(*[F.regexp_extract_all(F.coalesce(_field(c), F.lit("")), F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1)) for c in ("trackedGitRepos", "workspaceIdentifier")])
    paths = chats.select("store", "chat", F.posexplode(texts).alias("nth", "text")).select("store", "chat", "nth", F.replace("text", F.lit("\\\\"), F.lit("\\")).alias("path")).where(absolute_path(F.col("path")).isNotNull())
    held = paths.join(resolve_paths(paths, worktrees).where("status = 'matched'"), "path")
    return held.groupBy("store", "chat").agg(F.min_by(F.struct("repo", "worktree"), "nth").alias("x")).select("store", "chat", "x.*")
