"""Entry trees written as JSON lines from the event table, and what their requests and turns are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.trees import parse_entries, session_trees
from tidemark.plans.base import EVENTS_SQL, events, registry

QUERIES, ORACLES, query = registry()


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, seq, entry): sixteen files whose entries follow the one before or the third before; some start anew."""
    order = Window.partitionBy("file").orderBy("event_id")
    k, form = F.coalesce("k", F.lit(0)), F.col("event_id") % 9
    some = lambda test, pattern, *args: F.when(test, F.format_string(pattern, *args)).otherwise("")
    result = F.concat(
        F.lit('"type":"message","message":{"role":"toolResult","toolName":"task"'), some(k % 2 == 0, ',"usage":{"input":%d}', k),
        some(k % 3 == 0, ',"details":{"results":[{"agent":"a","model":"s","usage":{"input":%d}},{"messages":[{"role":"user"},{"role":"assistant","model":"n","usage":{"input":%d}}],"usage":{"input":999}}]}', k + 1, k + 2), F.lit("}"),
    )
    body = (
        F.when(form == 0, '"type":"message","message":{"role":"user"}')
        .when(form.isin(1, 2), F.concat(F.format_string('"type":"message","message":{"role":"assistant","model":"m%d","usage":{"input":%d}', k % 3, k), some(k % 4 == 0, ',"thinkingLevel":"max"'), F.lit("}")))
        .when(form == 3, result).when(form == 4, F.concat(F.lit('"type":"model_change"'), some(k % 2 == 0, ',"modelId":"c%d"', k % 5)))
        .when(form == 5, F.format_string('"type":"thinking_level_change","thinkingLevel":"l%d"', k % 2)).when(form == 6, F.concat(F.lit('"type":"compaction"'), some(k % 2 == 0, ',"usage":{"input":%d}', k)))
        .when(form == 7, F.format_string('"type":"usage","kind":"title","model":"u","usage":{"input":%d}', k)).otherwise('"type":"label"')
    )
    e = events(spark, sf_dir).withColumn("file", F.concat(F.lit("f"), F.col("user_id") % 16))
    parent = F.when(F.col("event_id") % 31 == 5, F.lit(None)).when(F.col("event_id") % 7 == 3, F.lag("event_id", 3).over(order)).otherwise(F.lag("event_id").over(order))
    e = e.withColumn("parent", parent)
    line = F.concat(F.format_string('{"id":"%d","timestamp":"t%d"', "event_id", "event_id"), some(F.col("parent").isNotNull(), ',"parentId":"%d"', F.col("parent")), F.lit(","), body, F.lit("}"))
    return parse_entries(e.select("file", F.col("event_id").alias("seq"), line.alias("value")))


_WALK_SQL = f"""
WITH RECURSIVE {EVENTS_SQL},
n AS MATERIALIZED (
  SELECT 'f' || (user_id % 16) AS file, event_id AS id, event_id % 9 AS form, coalesce(k, 0) AS k,
    CASE WHEN event_id % 31 = 5 THEN NULL WHEN event_id % 7 = 3 THEN lag(event_id, 3) OVER f ELSE lag(event_id) OVER f END AS parent
  FROM e WINDOW f AS (PARTITION BY user_id % 16 ORDER BY event_id)),
own AS MATERIALIZED (
  SELECT *, CASE WHEN form = 0 THEN id END AS o_turn, CASE WHEN form = 4 AND k % 2 = 0 THEN 'c' || (k % 5) END AS o_model, CASE WHEN form = 5 THEN 'l' || (k % 2) END AS o_thinking, CASE WHEN form IN (1, 2) THEN 'm' || (k % 3) END AS o_served FROM n),
w AS (
  SELECT id, NULL::BIGINT AS turn, NULL::VARCHAR AS model, NULL::VARCHAR AS thinking, NULL::VARCHAR AS served FROM own WHERE parent IS NULL
  UNION ALL
  SELECT c.id, coalesce(p.o_turn, w.turn), coalesce(p.o_model, w.model), coalesce(p.o_thinking, w.thinking), coalesce(p.o_served, w.served) FROM w JOIN own p ON p.id = w.id JOIN own c ON c.parent = w.id),
x AS MATERIALIZED (SELECT own.*, coalesce(own.o_turn, w.turn) AS turn, model, thinking, served, own.id || ':t' || own.id AS key FROM own JOIN w USING (id))"""


@query(f"""{_WALK_SQL},
r AS (
  SELECT file, key, 'assistant' AS kind, turn, NULL AS agent, 'm' || (k % 3) AS model, CASE WHEN k % 4 = 0 THEN 'max' ELSE thinking END AS effort, NULL AS label, k AS input FROM x WHERE form IN (1, 2)
  UNION ALL SELECT file, key, 'tool', turn, NULL, NULL, NULL, NULL, k FROM x WHERE form = 3 AND k % 2 = 0
  UNION ALL SELECT file, key || ':agent:0', 'subagent', turn, 'a', 's', NULL, 'aggregate', k + 1 FROM x WHERE form = 3 AND k % 3 = 0
  UNION ALL SELECT file, key || ':agent:1:0', 'subagent', turn, 'task', 'n', NULL, NULL, k + 2 FROM x WHERE form = 3 AND k % 3 = 0
  UNION ALL SELECT file, key, 'compaction', turn, NULL, coalesce(served, model), thinking, NULL, k FROM x WHERE form = 6 AND k % 2 = 0
  UNION ALL SELECT file, key, 'usage', turn, NULL, 'u', NULL, 'title', k FROM x WHERE form = 7)
SELECT file, key, kind, CAST(turn AS VARCHAR) AS turn, agent, model, effort, label, CAST(input AS BIGINT) AS input FROM r""")
def entry_tree_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of entry trees with what they inherit from the entries above."""
    requests, _ = session_trees(_entries(spark, sf_dir), spark.createDataFrame([], "file string, parent string"))
    return requests.select("file", "key", "kind", "turn", "agent", "model", "effort", "label", F.col("usage.input").alias("input"))


@query(f"""{_WALK_SQL},
first AS (SELECT file, turn, min(id) AS reply FROM x WHERE form IN (1, 2) AND turn IS NOT NULL GROUP BY file, turn),
reply AS (SELECT f.file, f.turn, x.k, x.thinking FROM first f JOIN x ON x.id = f.reply)
SELECT x.file, CAST(x.id AS VARCHAR) AS turn, coalesce('m' || (r.k % 3), x.model) AS model, coalesce(CASE WHEN r.k % 4 = 0 THEN 'max' ELSE r.thinking END, x.thinking) AS effort
FROM x LEFT JOIN reply r ON r.file = x.file AND r.turn = x.id WHERE x.form = 0""")
def entry_tree_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of entry trees, by what was chosen above them or what their first reply says."""
    _, turns = session_trees(_entries(spark, sf_dir), spark.createDataFrame([], "file string, parent string"))
    return turns.select("file", "turn", "model", "effort")
