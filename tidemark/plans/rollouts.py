"""Session logs whose rows change state, derived from the event table: every user is a session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import rollout
from tidemark.plans.base import EVENTS_SQL, events, registry

QUERIES, ORACLES, query = registry()


def _rows(spark, sf_dir: str) -> DataFrame:
    """A log row an event, and a head before each user's first one."""
    e = events(spark, sf_dir)
    k, born = F.col("k"), F.floor(F.col("event_id") / 500).cast("long")
    kind = (
        F.when(F.col("event_type") == "signup", F.when(k % 4 == 0, "settings").otherwise("started"))
        .when(F.col("event_type") == "view", F.when(k % 5 == 0, "context").otherwise("tool"))
        .when(F.col("event_type") == "click", F.when(k % 2 == 1, "count").otherwise("tool"))
        .when(F.col("event_type") == "purchase", "record")
        .otherwise(F.element_at(F.array(*map(F.lit, rollout.ENDS)), k % 3 + 1))
    )
    text = lambda prefix, when: F.when(when, F.concat(F.lit(prefix), k % 9))
    session = F.concat(F.lit("u"), "user_id")
    is_kind = lambda *x: F.col("kind").isin(*x)
    turned = is_kind("started", "completed", "failed") | is_kind("context") & (k % 7 != 0) | is_kind("aborted") & (k % 2 == 1) | is_kind("record") & (k % 3 != 0)
    own = F.when(is_kind("settings"), F.when(k % 3 == 1, session).when(k % 3 == 2, "other")).when(is_kind("record"), F.when(k % 11 == 0, "other").otherwise(session))
    rows = e.withColumn("kind", kind).select(
        session.alias("session"), F.col("event_id").alias("seq"), "kind", F.col("ts").alias("at"), own.alias("thread"), F.when(turned, born).alias("born"), F.lit(None).cast("boolean").alias("forked"),
        F.when(turned, F.concat(F.lit("t"), born)).alias("turn"), text("/c", is_kind("context") & (k % 2 == 0)).alias("cwd"),
        text("m", is_kind("settings") & (k % 8 == 0) | is_kind("context") & (k % 3 == 0)).alias("model"), text("e", is_kind("settings") & (k % 3 != 0) | is_kind("context") & (k % 4 == 0)).alias("effort"),
        text("p", is_kind("settings") & (k % 5 == 0)).alias("provider"), text("s", is_kind("settings") & (k % 7 < 4)).alias("tier"),
        F.when(is_kind("record") & (k % 13 != 0), F.concat(F.lit("q"), k % 60)).alias("key"), F.when(is_kind("count") & (k % 17 != 0), F.floor(F.col("event_id") / 600).cast("long")).alias("total"),
        F.when(is_kind("count"), F.concat(F.lit("s"), k % 40)).alias("signature"), F.when(is_kind("record", "count"), F.col("k").cast("long")).alias("spent"), F.when(is_kind("tool"), k % 6 == 0).alias("search"),
    )
    u = F.col("user_id")
    heads = e.select("user_id").distinct().select(
        F.concat(F.lit("u"), u).alias("session"), F.lit(-1).cast("long").alias("seq"), F.lit("head").alias("kind"), F.concat(F.lit("u"), u).alias("thread"), (u % 20).alias("born"), (u % 3 == 0).alias("forked"),
        F.when(u % 2 == 0, "/h").alias("cwd"), F.when(u % 7 != 0, F.concat(F.lit("p"), u % 4)).alias("provider"),
    )
    return rows.unionByName(heads, allowMissingColumns=True)


LOG_SQL = f"""{EVENTS_SQL},
kinds AS (
  SELECT *, 'u' || user_id AS session, event_id // 500 AS b, k % 9 AS d,
         CASE event_type WHEN 'signup' THEN CASE WHEN k % 4 = 0 THEN 'settings' ELSE 'started' END WHEN 'view' THEN CASE WHEN k % 5 = 0 THEN 'context' ELSE 'tool' END
           WHEN 'click' THEN CASE WHEN k % 2 = 1 THEN 'count' ELSE 'tool' END WHEN 'purchase' THEN 'record' ELSE ['completed', 'failed', 'aborted'][k % 3 + 1] END AS kind FROM e),
turned AS (SELECT *, kind IN ('started', 'completed', 'failed') OR (kind = 'context' AND k % 7 <> 0) OR (kind = 'aborted' AND k % 2 = 1) OR (kind = 'record' AND k % 3 <> 0) AS has_turn FROM kinds),
log AS (
  SELECT session, event_id AS seq, kind, ts AS stamp,
         CASE kind WHEN 'settings' THEN CASE k % 3 WHEN 1 THEN session WHEN 2 THEN 'other' END WHEN 'record' THEN CASE WHEN k % 11 = 0 THEN 'other' ELSE session END END AS thread,
         CASE WHEN has_turn THEN b END AS born, NULL::BOOLEAN AS forked, CASE WHEN has_turn THEN 't' || b END AS turn,
         CASE WHEN kind = 'context' AND k % 2 = 0 THEN '/c' || d END AS cwd,
         CASE WHEN (kind = 'settings' AND k % 8 = 0) OR (kind = 'context' AND k % 3 = 0) THEN 'm' || d END AS model,
         CASE WHEN (kind = 'settings' AND k % 3 <> 0) OR (kind = 'context' AND k % 4 = 0) THEN 'e' || d END AS effort,
         CASE WHEN kind = 'settings' AND k % 5 = 0 THEN 'p' || d END AS provider, CASE WHEN kind = 'settings' AND k % 7 < 4 THEN 's' || d END AS tier,
         CASE WHEN kind = 'record' AND k % 13 <> 0 THEN 'q' || (k % 60) END AS key, CASE WHEN kind = 'count' AND k % 17 <> 0 THEN event_id // 600 END AS total,
         CASE WHEN kind = 'count' THEN 's' || (k % 40) END AS signature, CASE WHEN kind IN ('record', 'count') THEN k END AS spent, kind = 'tool' AND k % 6 = 0 AS search
  FROM turned
  UNION ALL
  SELECT 'u' || user_id, -1, 'head', NULL, 'u' || user_id, user_id % 20, user_id % 3 = 0, NULL, CASE WHEN user_id % 2 = 0 THEN '/h' END, NULL, NULL,
         CASE WHEN user_id % 7 <> 0 THEN 'p' || (user_id % 4) END, NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT DISTINCT user_id FROM e)),
heads AS (SELECT session, thread AS h_thread, born AS h_born, forked AS h_forked, cwd AS h_cwd, provider AS h_provider FROM log WHERE kind = 'head'),
own AS (SELECT l.*, h.* EXCLUDE session, kind = 'record' AND thread = h_thread AS own_record, kind IN ('started', 'context') AND turn IS NOT NULL AND born >= h_born AS own_turn FROM log l JOIN heads h USING (session)),
firsts AS (SELECT session, min(seq) FILTER (WHERE own_record OR own_turn) AS own_from, min(seq) FILTER (WHERE own_record) AS record_from FROM own GROUP BY 1),
marked AS (SELECT o.*, record_from, kind <> 'head' AND h_forked AND (own_from IS NULL OR seq < own_from) AS replayed, kind = 'settings' AND (thread IS NULL OR thread = h_thread) AS applies FROM own o JOIN firsts USING (session)),
st AS (
  SELECT * REPLACE (coalesce(turn, CASE WHEN kind IN ('context', 'aborted', 'record', 'count') THEN current END) AS turn) FROM (
    SELECT *, last_value(CASE WHEN applies THEN model END IGNORE NULLS) OVER w AS s_model, last_value(CASE WHEN applies THEN effort END IGNORE NULLS) OVER w AS s_effort,
           last_value(CASE WHEN applies THEN tier END IGNORE NULLS) OVER w AS s_tier, last_value(CASE WHEN applies OR kind = 'head' THEN provider END IGNORE NULLS) OVER w AS s_provider,
           last_value(CASE WHEN kind IN ('started', 'context') THEN turn END IGNORE NULLS) OVER w AS current
    FROM marked WINDOW w AS (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING))),
ctx AS (SELECT *, kind = 'context' AND turn IS NOT NULL AND NOT replayed AS is_ctx FROM st),
state AS (
  SELECT *, last_value(CASE WHEN is_ctx OR kind = 'head' THEN cwd END IGNORE NULLS) OVER w AS f_cwd, last_value(CASE WHEN is_ctx THEN coalesce(effort, s_effort) END IGNORE NULLS) OVER w AS f_effort,
         last_value(CASE WHEN is_ctx THEN coalesce(model, s_model) END IGNORE NULLS) OVER w AS f_model,
         last_value(CASE WHEN is_ctx THEN {{'p': s_provider, 't': s_tier}} WHEN kind = 'head' THEN {{'p': provider, 't': NULL}} END IGNORE NULLS) OVER w AS f_fixed,
         last_value(CASE WHEN kind = 'count' THEN total END IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS total_before
  FROM ctx WINDOW w AS (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING)),
turn_facts AS (
  SELECT session, turn, seq, stamp, CASE WHEN kind = 'context' THEN {{'cwd': f_cwd, 'effort': f_effort, 'model': f_model, 'provider': f_fixed.p, 'tier': f_fixed.t}}
         ELSE {{'cwd': coalesce(f_cwd, h_cwd), 'effort': coalesce(s_effort, f_effort), 'model': coalesce(s_model, f_model), 'provider': s_provider, 'tier': s_tier}} END AS fact, kind
  FROM state WHERE kind IN ('started', 'context') AND turn IS NOT NULL AND NOT replayed),
opened AS (SELECT session, turn, min(seq) AS opened, arg_min(stamp, seq) AS started_at FROM turn_facts GROUP BY 1, 2),
closings AS (
  SELECT o.session, o.turn, s.seq, 'unfinished' AS status, NULL AS completed_at FROM opened o JOIN turn_facts s ON s.session = o.session AND s.kind = 'started' AND s.seq > o.opened AND s.turn <> o.turn
  UNION ALL SELECT o.session, o.turn, s.seq, s.kind, s.stamp FROM opened o JOIN state s ON s.session = o.session AND s.turn = o.turn AND s.seq > o.opened AND s.kind IN ('completed', 'failed', 'aborted') AND NOT s.replayed),
spans AS (SELECT o.*, c.seq AS ended, coalesce(c.status, 'open') AS status, c.completed_at FROM opened o LEFT JOIN (SELECT session, turn, min(seq) AS seq, arg_min(status, seq) AS status, arg_min({{'x': completed_at}}, seq).x AS completed_at FROM closings GROUP BY 1, 2) c USING (session, turn)),
records AS (SELECT * FROM (SELECT *, 'record' AS source, coalesce(key, 'ord-' || seq) AS name, row_number() OVER (PARTITION BY session, coalesce(key, 'ord-' || seq) ORDER BY seq) AS nth FROM state WHERE own_record) WHERE nth = 1 AND spent > 0),
counts AS (
  SELECT * FROM (SELECT *, 'count' AS source, 'tc-' || CASE WHEN total IS NULL THEN 'ord-' || seq ELSE signature END AS name, row_number() OVER (PARTITION BY session, CASE WHEN total IS NULL THEN 'ord-' || seq ELSE signature END ORDER BY seq) AS nth FROM state WHERE kind = 'count')
  WHERE nth = 1 AND spent > 0 AND NOT replayed AND (record_from IS NULL OR seq < record_from) AND (total IS NULL OR total IS DISTINCT FROM total_before)),
found AS (SELECT * FROM records UNION ALL SELECT * FROM counts),
at_request AS (SELECT f.session, f.seq, arg_max(t.fact, t.seq) AS fact FROM found f JOIN spans s ON s.session = f.session AND s.turn = f.turn AND f.seq > s.opened AND (s.ended IS NULL OR f.seq < s.ended) JOIN turn_facts t ON t.session = f.session AND t.turn = f.turn AND t.seq <= f.seq AND (t.kind = 'context' OR t.seq = s.opened) GROUP BY 1, 2),
in_the_end AS (SELECT s.session, s.turn, arg_max(t.fact, t.seq) AS fact FROM spans s JOIN turn_facts t USING (session, turn) WHERE (t.kind = 'context' AND (ended IS NULL OR t.seq <= ended)) OR t.seq = s.opened GROUP BY 1, 2),
resets AS (SELECT session, seq FROM found UNION SELECT session, seq FROM state WHERE kind = 'started' AND turn IS NOT NULL AND NOT replayed),
tools AS (SELECT session, seq, search, current FROM state WHERE kind = 'tool' AND current IS NOT NULL AND NOT replayed),
before AS (SELECT f.session, f.seq, max(r.seq) AS reset FROM found f LEFT JOIN resets r ON r.session = f.session AND r.seq < f.seq GROUP BY 1, 2),
used AS (SELECT b.session, b.seq, count(t.seq) AS tool_calls, count_if(coalesce(t.search, false))::BIGINT AS searches FROM before b LEFT JOIN tools t ON t.session = b.session AND t.seq < b.seq AND t.seq > coalesce(b.reset, -2) GROUP BY 1, 2),
placed AS (
  SELECT f.session, f.seq, name AS key, source, f.turn, f.spent, tool_calls, searches, a.fact IS NOT NULL AS is_open,
         coalesce(a.fact, {{'cwd': f_cwd, 'effort': f_effort, 'model': f_model, 'provider': f_fixed.p, 'tier': f_fixed.t}}) AS fact, i.fact AS last
  FROM found f JOIN used USING (session, seq) LEFT JOIN at_request a USING (session, seq) LEFT JOIN in_the_end i ON i.session = f.session AND i.turn = f.turn),
requests AS (SELECT * REPLACE (CASE WHEN fact.model IS NULL AND last IS NOT NULL THEN last ELSE fact END AS fact) FROM placed)"""


@query(f"WITH {LOG_SQL} SELECT session, seq, key, source, turn, spent::BIGINT AS spent, tool_calls, searches, fact.cwd AS cwd, fact.effort AS effort, fact.model AS model, fact.provider AS provider, fact.tier AS tier FROM requests")
def rollout_requests(spark, sf_dir):
    requests, _ = rollout.fold_sessions(_rows(spark, sf_dir))
    return requests.drop("at")


@query(f"""WITH {LOG_SQL}, n AS (SELECT session, turn, count(*) AS n FROM requests WHERE is_open GROUP BY 1, 2),
c AS (SELECT s.session, s.turn, count(*) AS c FROM spans s JOIN tools t ON t.session = s.session AND t.current = s.turn AND t.seq > opened AND (ended IS NULL OR t.seq < ended) GROUP BY 1, 2)
SELECT session, turn, epoch_us(started_at) AS started_us, epoch_us(completed_at) AS completed_us, status, coalesce(n, 0) AS requests, coalesce(c, 0) AS tool_calls FROM spans LEFT JOIN n USING (session, turn) LEFT JOIN c USING (session, turn)""")
def rollout_turns(spark, sf_dir):
    _, turns = rollout.fold_sessions(_rows(spark, sf_dir))
    return turns.select("session", "turn", F.unix_micros("started_at").alias("started_us"), F.unix_micros("completed_at").alias("completed_us"), "status", "requests", "tool_calls")
