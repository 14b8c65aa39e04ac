"""Queries over reward rows and agent runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import scoring
from waymark.plans import views
from waymark.plans.registry import query
from waymark.session import cut_lineage


def _log(spark, sf):
    """Tool log with call arguments as a map."""
    args = F.when(F.col("url").isNotNull(), F.create_map(F.lit("url"), F.col("url"))).otherwise(
        F.create_map(F.lit("address"), F.col("address"))
    )
    return views.tool_log(spark, sf).withColumn("args", args)


def _inputs(spark, sf):
    stops = cut_lineage(views.stops(spark, sf))  # numbered once for all parts
    return views.trails(spark, sf), stops, views.chain(stops), _log(spark, sf), views.answers(spark, sf)


_STATUS = """
status_q AS (
  SELECT t.trail_id AS trial_id, t.level, a.answer AS agent_answer, CAST(t.passcode AS VARCHAR) AS expected_answer,
    CASE WHEN a.answer IS NULL OR NOT regexp_full_match(a.answer, '[0-9]') THEN 'unknown'
         WHEN a.answer = CAST(t.passcode AS VARCHAR) THEN 'correct' ELSE 'incorrect' END AS status,
    CASE WHEN a.answer IS NULL THEN 'no answer given' WHEN a.answer = '' THEN 'empty answer'
         WHEN NOT regexp_full_match(a.answer, '[0-9]') THEN 'not a single digit: ' || a.answer ELSE '' END AS status_reason,
    CASE WHEN a.answer <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS answered,
    CASE WHEN regexp_full_match(a.answer, '[0-9]') AND a.answer = CAST(t.passcode AS VARCHAR)
         THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward
  FROM trails_v t LEFT JOIN answers_v a ON a.trial_id = t.trail_id)"""

_NORM = "regexp_extract(replace(rtrim({0}, '/'), '://en.m.wikipedia', '://en.wikipedia'), '^([^?#]*)', 1)"

_COVER = f"""
gp AS (SELECT DISTINCT trail_id AS trial_id, {_NORM.format('page_url')} AS u FROM stops_v WHERE stop_type = 'page' AND page_url <> ''),
sp AS (SELECT DISTINCT trial_id, {_NORM.format('url')} AS u FROM tool_log_v WHERE url <> ''),
pv AS (SELECT gp.trial_id, count(*) AS pages, count(sp.u) AS hits FROM gp LEFT JOIN sp ON gp.trial_id = sp.trial_id AND gp.u = sp.u GROUP BY 1),
gt AS (SELECT DISTINCT trail_id AS trial_id, tool_name AS t FROM chain_v WHERE tool_name <> ''),
st AS (SELECT DISTINCT trial_id, tool AS t FROM tool_log_v),
tv AS (SELECT gt.trial_id, count(*) AS tools, count(st.t) AS hits FROM gt LEFT JOIN st ON gt.trial_id = st.trial_id AND gt.t = st.t GROUP BY 1),
calls_q AS (SELECT trial_id, count(*) AS calls, count(*) FILTER (success) AS valid FROM tool_log_v GROUP BY 1),
stops_q AS (SELECT trail_id AS trial_id, count(*) AS n, count(*) FILTER (stop_type = 'page') AS p,
   count(*) FILTER (stop_type IN ('tool', 'compute')) AS t, count(*) FILTER (stop_type = 'reason') AS r FROM stops_v GROUP BY 1)"""

_R3 = "CAST(printf('%.3f', {0}) AS DOUBLE)"

# Right calls. The arguments of the views compare by containment of 'place k' texts only, which
# the statement below replays call by call with a recursive walk over the pairs.
_RIGHT = """
pairs_q AS (
  SELECT c.trail_id AS trial_id, l.tool, l.seq, c.stop_index * 10 + c.step AS g_at
  FROM chain_v c JOIN tool_log_v l ON l.trial_id = c.trail_id AND l.tool = c.tool_name
  WHERE c.arg_address IS NOT NULL AND l.url IS NULL
    AND (contains(lower(l.address), lower(c.arg_address)) OR contains(lower(c.arg_address), lower(l.address)))),
num_q AS (SELECT *, row_number() OVER (PARTITION BY trial_id, tool ORDER BY seq, g_at) AS k FROM pairs_q),
walk_q AS (
  SELECT trial_id, tool, 1 AS k, [seq] AS calls, [g_at] AS used FROM num_q WHERE k = 1
  UNION ALL
  SELECT w.trial_id, w.tool, n.k,
    CASE WHEN list_contains(w.calls, n.seq) OR list_contains(w.used, n.g_at) THEN w.calls ELSE list_append(w.calls, n.seq) END,
    CASE WHEN list_contains(w.calls, n.seq) OR list_contains(w.used, n.g_at) THEN w.used ELSE list_append(w.used, n.g_at) END
  FROM walk_q w JOIN num_q n ON n.trial_id = w.trial_id AND n.tool = w.tool AND n.k = w.k + 1),
right_q AS (
  SELECT trial_id, CAST(sum(m) AS BIGINT) AS n_right FROM (SELECT trial_id, tool, max(len(used)) AS m FROM walk_q GROUP BY 1, 2) GROUP BY 1),
golden_q AS (SELECT trail_id AS trial_id, count(*) AS n_steps FROM chain_v GROUP BY 1)"""

_VALUES = """
text_q AS (SELECT trial_id, string_agg(result_preview, ' ' ORDER BY seq) AS txt FROM tool_log_v GROUP BY 1),
val_q AS (
  SELECT s.trail_id AS trial_id, count(*) AS total,
    count(*) FILTER (contains(x.txt, trim(s.value_str)) OR
      (TRY_CAST(replace(s.value_str, ',', '') AS DOUBLE) IS NOT NULL AND (
        contains(x.txt, CAST(CAST(trunc(TRY_CAST(replace(s.value_str, ',', '') AS DOUBLE)) AS BIGINT) AS VARCHAR))
        OR contains(x.txt, printf('%.1f', TRY_CAST(replace(s.value_str, ',', '') AS DOUBLE)))
        OR contains(x.txt, printf('%.2f', TRY_CAST(replace(s.value_str, ',', '') AS DOUBLE)))))) AS hits
  FROM stops_v s LEFT JOIN text_q x ON x.trial_id = s.trail_id WHERE s.value_str IS NOT NULL GROUP BY 1)"""


@query("score_by_level", f"""WITH {_STATUS}, {_COVER}
SELECT s.level, count(*) AS trials, round(avg(s.reward) * 100, 4) AS accuracy,
  round(avg(pv.hits / pv.pages) * 100, 4) AS visit_rate, round(avg(tv.hits / tv.tools) * 100, 4) AS tool_use_rate,
  round(avg(coalesce(c.calls, 0)), 4) AS mean_calls
FROM status_q s LEFT JOIN pv USING (trial_id) LEFT JOIN tv USING (trial_id) LEFT JOIN calls_q c USING (trial_id)
GROUP BY 1""")
def score_by_level(spark, sf):
    return scoring.score_by_level(*_inputs(spark, sf))


@query("trial_status", f"WITH {_STATUS} SELECT * FROM status_q")
def trial_status(spark, sf):
    return scoring.trial_status(views.trails(spark, sf), views.answers(spark, sf))


@query("page_visit_rate", f"WITH {_COVER} SELECT trial_id, pages, hits, {_R3.format('hits / pages')} AS pages_visited FROM pv")
def page_visit_rate(spark, sf):
    return scoring.page_visit_rate(views.stops(spark, sf), views.tool_log(spark, sf))


@query("tool_use_rate", f"WITH {_COVER} SELECT trial_id, tools, hits, {_R3.format('hits / tools')} AS tools_used FROM tv")
def tool_use_rate(spark, sf):
    stops = views.stops(spark, sf)
    return scoring.tool_use_rate(stops, views.chain(stops), views.tool_log(spark, sf))


@query("call_counts", f"""WITH {_COVER} SELECT s.trial_id, s.n AS stops_total, s.p AS page_stops, s.t AS tool_stops, s.r AS reason_stops,
  coalesce(c.calls, 0) AS total_tool_calls, coalesce(c.valid, 0) AS valid_tool_calls
FROM stops_q s LEFT JOIN calls_q c USING (trial_id)""")
def call_counts(spark, sf):
    return scoring.call_counts(views.stops(spark, sf), views.tool_log(spark, sf))


@query("right_tool_calls", f"""WITH RECURSIVE {_RIGHT}
SELECT g.trial_id, coalesce(r.n_right, 0) AS right_tool_calls, g.n_steps AS golden_chain_length
FROM golden_q g LEFT JOIN right_q r USING (trial_id)""")
def right_tool_calls(spark, sf):
    stops = views.stops(spark, sf)
    return scoring.right_tool_calls(views.chain(stops), _log(spark, sf))


@query("intermediate_values", f"""WITH {_VALUES} SELECT trial_id, hits AS intermediate_correct, total AS intermediate_total,
  {_R3.format('hits / total')} AS intermediate_rate FROM val_q""")
def intermediate_values(spark, sf):
    return scoring.intermediate_values(views.stops(spark, sf), views.tool_log(spark, sf))


REWARD_SQL = f"""WITH RECURSIVE {_RIGHT}, {_STATUS}, {_COVER}, {_VALUES},
reward_q AS (SELECT s.trial_id, s.level, s.reward, s.status, s.status_reason, s.answered, s.agent_answer, s.expected_answer,
  coalesce(n.n, 0) AS stops_total, coalesce(n.p, 0) AS page_stops, coalesce(n.t, 0) AS tool_stops, coalesce(n.r, 0) AS reason_stops,
  coalesce(c.calls, 0) AS total_tool_calls, coalesce(c.valid, 0) AS valid_tool_calls,
  coalesce(r.n_right, 0) AS right_tool_calls, coalesce(g.n_steps, 0) AS golden_chain_length,
  {_R3.format('pv.hits / pv.pages')} AS pages_visited, {_R3.format('tv.hits / tv.tools')} AS tools_used,
  coalesce(v.hits, 0) AS intermediate_correct, coalesce(v.total, 0) AS intermediate_total,
  {_R3.format('v.hits / v.total')} AS intermediate_rate, coalesce(n.n, 0) AS ground_truth_steps
FROM status_q s LEFT JOIN stops_q n USING (trial_id) LEFT JOIN calls_q c USING (trial_id) LEFT JOIN pv USING (trial_id)
  LEFT JOIN tv USING (trial_id) LEFT JOIN right_q r USING (trial_id) LEFT JOIN golden_q g USING (trial_id) LEFT JOIN val_q v USING (trial_id))"""


def rewards(spark, sf):
    return scoring.reward_rows(*_inputs(spark, sf))


@query("reward_rows", REWARD_SQL + " SELECT * FROM reward_q")
def reward_rows(spark, sf):
    return rewards(spark, sf)


@query("seen_names", """SELECT DISTINCT trial_id, 'url' AS kind, url AS name FROM tool_log_v WHERE url <> ''
UNION ALL SELECT DISTINCT trial_id, 'tool', tool FROM tool_log_v""")
def seen_names(spark, sf):
    return scoring.seen_names(views.tool_log(spark, sf))


@query("final_answers", """SELECT conv_id, CAST(arg_min(d, turn) AS INTEGER) AS answer FROM (
  SELECT conv_id, turn, regexp_extract(CASE WHEN turn % 4 = 3 THEN concat(text, ' final  answer: ', CAST(conv_id % 10 AS VARCHAR)) ELSE text END, '(?i)Final\\s+Answer\\s*:\\s*(\\d)', 1) AS d
  FROM conversations WHERE role = 'assistant') WHERE d <> '' GROUP BY 1""")
def final_answers(spark, sf):
    c = views.load(spark, sf, "conversations")
    said = F.concat("text", F.lit(" final  answer: "), (F.col("conv_id") % 10).cast("string"))
    return scoring.final_answers(c.withColumn("text", F.when(F.col("turn") % 4 == 3, said).otherwise(F.col("text"))))


@query("shaped_calls", """SELECT doc_id, md5(CASE WHEN length(text) > 8000 THEN concat(substring(text, 1, 8000), chr(10), '... (truncated)') ELSE text END) AS result_md5,
  substring(text, 1, 500) AS result_preview FROM documents""")
def shaped_calls(spark, sf):
    shaped = scoring.shape_calls(views.load(spark, sf, "documents"))
    return shaped.select("doc_id", F.md5("result").alias("result_md5"), "result_preview")


@query("log_rows", """SELECT doc_id AS trial_id, doc_id AS seq, 'fetch_webpage' AS tool, substring(text, 1, 2000) AS result_preview,
  length(text) AS result_len, CASE WHEN doc_id % 3 <> 0 THEN concat('https://en.wikipedia.org/wiki/D', CAST(doc_id AS VARCHAR)) END AS url FROM documents""")
def log_rows(spark, sf):
    d = views.load(spark, sf, "documents")
    url = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("https://en.wikipedia.org/wiki/D"), F.col("doc_id").cast("string"))).otherwise("")
    calls = d.select(
        F.col("doc_id").alias("trial_id"), F.col("doc_id").alias("seq"), F.lit(None).cast("timestamp").alias("ts"),
        F.lit("fetch_webpage").alias("tool"), F.create_map(F.lit("url"), url).alias("args"), F.lit(True).alias("success"), F.col("text").alias("result"),
    )
    return scoring.log_rows(calls).select("trial_id", "seq", "tool", "result_preview", F.col("result_len").cast("bigint").alias("result_len"), "url")


@query("reply_success", """SELECT doc_id, NOT (starts_with(t, 'Error: ') AND length(t) < 200) AS success FROM (
  SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('Error: ', text) ELSE text END AS t FROM documents)""")
def reply_success(spark, sf):
    d = views.load(spark, sf, "documents")
    d = d.withColumn("result", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Error: "), F.col("text"))).otherwise(F.col("text")))
    return scoring.reply_success(d).select("doc_id", "success")


_METRICS = """
url_q AS (SELECT DISTINCT trial_id, url FROM tool_log_v WHERE tool = 'fetch_webpage' AND url <> ''),
met_q AS (SELECT s.trail_id, count(*) FILTER (stop_type = 'reason') AS total_reason_stops,
   count(*) FILTER (stop_type = 'page') AS total_page_stops, count(*) FILTER (stop_type = 'page' AND u.url IS NOT NULL) AS pages_visited,
   count(*) FILTER (stop_type = 'tool') AS total_tool_stops,
   count(*) FILTER (stop_type = 'tool' AND EXISTS (SELECT 1 FROM chain_v c WHERE c.trail_id = s.trail_id AND c.stop_index = s.stop_index)
     AND NOT EXISTS (SELECT 1 FROM chain_v c WHERE c.trail_id = s.trail_id AND c.stop_index = s.stop_index
       AND NOT EXISTS (SELECT 1 FROM tool_log_v l WHERE l.trial_id = s.trail_id AND l.tool = c.tool_name))) AS tools_completed
 FROM stops_v s LEFT JOIN url_q u ON u.trial_id = s.trail_id AND u.url = s.page_url GROUP BY 1),
metrics_q AS (SELECT m.*, coalesce(n.calls, 0) AS agent_tool_calls,
  CASE WHEN total_page_stops > 0 THEN pages_visited / total_page_stops END AS page_visit_rate,
  CASE WHEN total_tool_stops > 0 THEN tools_completed / total_tool_stops END AS tool_completion_rate
FROM met_q m LEFT JOIN (SELECT trial_id, count(*) AS calls FROM tool_log_v GROUP BY 1) n ON n.trial_id = m.trail_id)"""


@query("trail_metrics", f"WITH {_METRICS} SELECT * FROM metrics_q")
def trail_metrics(spark, sf):
    stops = views.stops(spark, sf)
    return scoring.trail_metrics(stops, views.chain(stops), views.tool_log(spark, sf))


def _runs(spark, sf):
    """Agent runs: trail metrics next to an answer, a step count and the step-limit flag."""
    stops = views.stops(spark, sf)
    metrics = scoring.trail_metrics(stops, views.chain(stops), views.tool_log(spark, sf))
    runs = views.trails(spark, sf).selectExpr(
        "trail_id", "level", "trail_id % 6 > 3 AND passcode < 10 AS correct", "trail_id % 23 AS steps", "trail_id % 23 > 20 AS hit_step_limit"
    )
    return runs.join(metrics, "trail_id", "left")


_RUNS = f"""WITH {_METRICS}, runs_q AS (SELECT t.trail_id, t.level, t.trail_id % 6 > 3 AND passcode < 10 AS correct, t.trail_id % 23 AS steps,
  t.trail_id % 23 > 20 AS hit_step_limit, m.page_visit_rate, m.tool_completion_rate FROM trails_v t LEFT JOIN metrics_q m ON m.trail_id = t.trail_id)"""


@query("run_summary", _RUNS + """ SELECT count(*) AS total_puzzles, count(*) FILTER (correct) AS correct, round(avg(correct::INT), 9) AS accuracy,
  round(avg(page_visit_rate), 9) AS avg_page_visit_rate, round(avg(tool_completion_rate), 9) AS avg_tool_completion_rate,
  round(avg(steps), 1) AS avg_steps, count(*) FILTER (hit_step_limit) AS step_limit_hits FROM runs_q""")
def run_summary(spark, sf):
    s = scoring.run_summary(_runs(spark, sf))
    return s.withColumns({c: F.round(c, 9) for c in ("accuracy", "avg_page_visit_rate", "avg_tool_completion_rate")})


@query("accuracy_by_level", _RUNS + """ SELECT level, count(*) AS total, count(*) FILTER (correct) AS correct, avg(correct::INT) AS accuracy FROM runs_q GROUP BY 1""")
def accuracy_by_level(spark, sf):
    return scoring.accuracy_by_level(_runs(spark, sf))


_PER_STOP = """WITH last_q AS (SELECT trail_id, stop_index, arg_max(tool_name, step) AS tool FROM chain_v GROUP BY 1, 2),
bt AS (SELECT trial_id, tool, arg_max(result_preview, seq) AS v FROM tool_log_v GROUP BY 1, 2),
bu AS (SELECT trial_id, url, arg_min(result_preview, seq) AS v FROM tool_log_v WHERE tool = 'fetch_webpage' GROUP BY 1, 2),
ps AS (SELECT s.trail_id, s.stop_index, s.stop_type, s.value_str AS golden_value,
  CASE s.stop_type WHEN 'tool' THEN bt.v WHEN 'page' THEN bu.v END AS agent_value,
  CASE WHEN s.value_kind <> 'string' THEN CAST(s.value_str AS DOUBLE) WHEN s.value_str LIKE '%million' THEN s.extracted_value * 1000000.0
       WHEN s.value_str = 'Old Harbour' THEN NULL ELSE CAST(s.extracted_value AS DOUBLE) END AS g
 FROM stops_v s LEFT JOIN last_q l USING (trail_id, stop_index) LEFT JOIN bt ON bt.trial_id = s.trail_id AND bt.tool = l.tool
 LEFT JOIN bu ON bu.trial_id = s.trail_id AND bu.url = s.page_url WHERE s.value_str IS NOT NULL),
pm AS (SELECT trail_id, stop_index, stop_type, golden_value, agent_value,
  CASE WHEN agent_value IS NULL THEN 'no_agent_value' WHEN golden_value = agent_value THEN 'exact_match'
    WHEN g IS NULL THEN 'needs_llm_judge'
    WHEN CASE WHEN g = 0 THEN abs(CAST(agent_value AS DOUBLE)) <= 0.01 ELSE abs(g - CAST(agent_value AS DOUBLE)) / abs(g) <= 0.01 END
    THEN 'numeric_match' ELSE 'numeric_mismatch' END AS method FROM ps)"""


@query("per_stop_values", _PER_STOP + " SELECT *, method IN ('exact_match', 'numeric_match') AS match FROM pm")
def per_stop_values(spark, sf):
    stops = views.stops(spark, sf)
    return scoring.per_stop_values(stops, views.chain(stops), views.tool_log(spark, sf))


@query("value_accuracy", _PER_STOP + """ SELECT trail_id, count(*) AS stops_evaluated, count(*) FILTER (method IN ('exact_match', 'numeric_match')) AS stops_matched,
  avg((method IN ('exact_match', 'numeric_match'))::INT) AS value_accuracy FROM pm GROUP BY 1""")
def value_accuracy(spark, sf):
    return scoring.value_accuracy(per_stop_values(spark, sf))


@query("prompt_table", """SELECT t.trail_id, level, concat('Start at: ', seed_url, chr(10), chr(10), 'Clues:', chr(10), seed_title, chr(10), chr(10), 'Answer with one digit.') AS prompt,
  passcode AS expected_passcode, coalesce(n, 0) AS num_stops, coalesce(k, 0) AS num_tool_stops, CAST(greatest(10, 3 * coalesce(n, 0)) AS INTEGER) AS step_limit
FROM trails_v t LEFT JOIN (SELECT trail_id, count(*) AS n, count(*) FILTER (stop_type = 'tool') AS k FROM stops_v GROUP BY 1) s ON s.trail_id = t.trail_id""")
def prompt_table(spark, sf):
    trails = views.trails(spark, sf).withColumn("riddle", F.col("seed_title"))
    return scoring.prompt_table(trails, views.stops(spark, sf))
