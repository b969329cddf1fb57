"""A key-value store of chats over the event table: a chat a user, a message an event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import chatstore
from tidemark.plans.base import EVENTS_SQL, events, registry

QUERIES, ORACLES, query = registry()


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("k", F.coalesce("k", F.lit(0)))
    tokens = F.when(F.col("event_id") % 4 > 0, F.format_string(',"tokenCount":{"inputTokens":%d,"outputTokens":%d}', F.col("k") % 3, F.col("k") % 2)).otherwise("")
    tool = F.when(F.col("event_id") % 5 == 0, F.format_string(',"toolFormerData":{"name":"t%d"}', F.col("k") % 4)).otherwise("")
    value = F.when(F.col("event_id") % 11 == 0, "{torn").otherwise(F.concat(F.format_string('{"type":%d', F.col("event_id") % 3), tokens, tool, F.lit("}")))
    said = e.select(F.lit("s").alias("store"), F.format_string("bubbleId:%d:%d", "user_id", "event_id").alias("key"), value.alias("value"))
    users = e.where("user_id % 3 > 0").select("user_id").distinct()
    return said.union(users.select(F.lit("s"), F.format_string("composerData:%d", "user_id"), F.lit("{}")))


@query(f"""
WITH {EVENTS_SQL}, m AS (
  SELECT user_id, event_id, event_id % 3 AS t, coalesce(k, 0) AS k, event_id % 4 > 0 AS counted, event_id % 4 > 0 AND (coalesce(k, 0) % 3 > 0 OR coalesce(k, 0) % 2 > 0) AS known
  FROM e WHERE event_id % 11 <> 0 AND user_id % 3 > 0)
SELECT CAST(user_id AS VARCHAR) AS chat, CAST(event_id AS VARCHAR) AS message, CASE t WHEN 1 THEN 'user' WHEN 2 THEN 'assistant' END AS role, CASE WHEN event_id % 5 = 0 THEN 't' || (k % 4) END AS tool,
  CASE WHEN known THEN k % 3 END AS input, CASE WHEN known THEN k % 2 END AS output, CASE WHEN NOT counted THEN 'absent' WHEN NOT known THEN 'zero' END AS unknown
FROM m""")
def stored_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of known chats of a key-value store, as turns."""
    rows = _rows(spark, sf_dir)
    chats = chatstore.store_chats(rows, spark.createDataFrame([], "store string, chat string, value string"))
    return chatstore.chat_turns(rows, chats).select("chat", "message", "role", "tool", "input", "output", "unknown")
