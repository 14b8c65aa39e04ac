"""Queries over trial reports and corpus statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import reports
from waymark.plans import views
from waymark.plans.registry import query
from waymark.plans.scoring_queries import REWARD_SQL, rewards

def _even(total: str, count: str, digits: int) -> str:
    """total / count of integers in units of the last digit, ties to even."""
    t, n = f"CAST({total} AS BIGINT)", f"CAST({count} AS BIGINT)"
    return f"(({t} // {n} + CASE WHEN 2 * ({t} % {n}) > {n} OR (2 * ({t} % {n}) = {n} AND ({t} // {n}) % 2 = 1) THEN 1 ELSE 0 END) / {10**digits}::DOUBLE)"


def _pct(condition: str) -> str:
    return _even(f"(count(*) FILTER ({condition})) * 1000", "count(*)", 1)


def _rate(column: str) -> str:
    return _even(f"sum(CAST(round({column} * 1000) AS BIGINT))", f"count({column})", 1)


def _avg(column: str) -> str:
    return _even(f"sum({column}) * 100", "count(*)", 2)


_TRIALS = REWARD_SQL + """, trials_q AS (SELECT *, concat(level, '-', CAST(trial_id AS VARCHAR)) AS task_name, trial_id % 11 <> 0 AS run_ok,
  trial_id % 29 AS agent_steps, trial_id % 1000 AS n_total_tokens, (trial_id % 600)::DOUBLE AS wall_clock_sec FROM reward_q)"""

_SUMMARY = f"""count(*)::DOUBLE AS "Total Cases", count(*) FILTER (run_ok)::DOUBLE AS "Run OK", count(*) FILTER (status = 'correct')::DOUBLE AS "Correct",
 count(*) FILTER (status = 'incorrect')::DOUBLE AS "Incorrect", count(*) FILTER (status = 'unknown')::DOUBLE AS "Unknown",
 {_pct("status = 'correct'")} AS "Accuracy (%)", {_pct("answered = 1")} AS "Answered (%)",
 {_avg('total_tool_calls')} AS "Avg Tool Calls", {_avg('valid_tool_calls')} AS "Avg Valid Tool Calls", {_avg('right_tool_calls')} AS "Avg Right Tool Calls",
 {_avg('golden_chain_length')} AS "Avg Golden Chain Len", {_rate('pages_visited')} AS "Avg Pages Visited (%)",
 {_rate('tools_used')} AS "Avg Tools Used (%)", {_rate('intermediate_rate')} AS "Avg Intermediate Value Rate (%)",
 {_avg('agent_steps')} AS "Avg Iterations (agent steps)", {_avg('n_total_tokens')} AS "Avg Tokens (total)", {_avg('ground_truth_steps')} AS "Avg Ground Truth Steps",
 {_even('sum(CAST(round(wall_clock_sec * 1000000) AS BIGINT))', 'count(*) * 10000', 2)} AS "Avg Wall Clock (sec)" """


def _trials(spark, sf):
    r = rewards(spark, sf)
    i = F.col("trial_id")
    return (
        r.withColumn("answered", F.col("answered") == 1.0)
        .withColumn("task_name", F.concat_ws("-", "level", i.cast("string")))
        .withColumn("run_ok", i % 11 != 0)
        .withColumn("agent_steps", i % 29)
        .withColumn("n_total_tokens", i % 1000)
        .withColumn("wall_clock_sec", (i % 600).cast("double"))
    )


_REPORT = f"""report_q AS (SELECT coalesce(level, 'Overall') AS label, {_SUMMARY} FROM trials_q GROUP BY ROLLUP (level))"""


@query("group_report", f"{_TRIALS}, {_REPORT} SELECT * FROM report_q")
def group_report(spark, sf):
    return reports.group_report(_trials(spark, sf))


@query("report_long", f"""{_TRIALS}, {_REPORT}, long_q AS (UNPIVOT report_q ON COLUMNS(* EXCLUDE label) INTO NAME metric VALUE val)
SELECT metric, max(val) FILTER (label = 'Overall') AS "Overall", max(val) FILTER (label = 'easy') AS easy, max(val) FILTER (label = 'medium') AS medium,
 max(val) FILTER (label = 'hard') AS hard, max(val) FILTER (label = 'extreme') AS extreme FROM long_q GROUP BY 1""")
def report_long(spark, sf):
    return reports.report_long(reports.group_report(_trials(spark, sf))).drop("position")


@query("per_trial", f"""{_TRIALS} SELECT task_name, status, CASE WHEN coalesce(agent_answer, '') = '' THEN '-' ELSE agent_answer END AS answer, expected_answer, total_tool_calls,
  valid_tool_calls, right_tool_calls, CASE WHEN intermediate_total > 0 THEN concat(intermediate_correct, '/', intermediate_total) ELSE 'n/a' END AS values_found, agent_steps, wall_clock_sec FROM trials_q""")
def per_trial(spark, sf):
    return reports.per_trial(_trials(spark, sf))


@query("unknown_reasons", """WITH t AS (SELECT trail_id, level, concat(level, '-', CAST(trail_id AS VARCHAR)) AS task_name,
   CASE WHEN answer IS NULL THEN 'no answer given' WHEN answer = '' THEN 'empty answer' ELSE 'not a single digit: ' || answer END AS why
   FROM trails_v JOIN answers_v ON trial_id = trail_id WHERE answer IS NULL OR NOT regexp_full_match(answer, '[0-9]')),
g AS (SELECT 'Overall' AS label, task_name, why FROM t UNION ALL SELECT level, task_name, why FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY task_name) AS rk, count(*) OVER (PARTITION BY label) AS n FROM g)
SELECT label, CAST(rk AS INTEGER) AS rank, concat(task_name, ': ', why) AS reason FROM r WHERE rk <= 20
UNION ALL SELECT DISTINCT label, 21, concat('... and ', CAST(n - 20 AS VARCHAR), ' more') FROM r WHERE n > 20""")
def unknown_reasons(spark, sf):
    from waymark.operators.scoring import trial_status

    t = trial_status(views.trails(spark, sf), views.answers(spark, sf))
    return reports.unknown_reasons(t.withColumn("task_name", F.concat_ws("-", "level", F.col("trial_id").cast("string"))))


@query("task_counts", "SELECT level, count(*) AS tasks FROM trails_v GROUP BY 1")
def task_counts(spark, sf):
    return reports.task_counts(views.trails(spark, sf))


@query("build_statistics", """SELECT coalesce(outcome, 'attempted') AS outcome, count(*) AS times FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'generated' WHEN 'O' THEN 'build_failed'
  ELSE 'seed_failed' END AS outcome FROM orders) GROUP BY ROLLUP (outcome)""")
def build_statistics(spark, sf):
    s = F.col("o_orderstatus")
    outcome = F.when(s == "F", "generated").when(s == "O", "build_failed").otherwise("seed_failed")
    return reports.build_statistics(views.load(spark, sf, "orders").select(outcome.alias("outcome")))


@query("page_jaccard", """WITH s AS (SELECT DISTINCT trail_id, page_url FROM stops_v WHERE page_url IS NOT NULL), ids AS (SELECT DISTINCT trail_id FROM s),
l AS (SELECT trail_id AS a, row_number() OVER (ORDER BY md5(concat('0|', trail_id, '|left')), trail_id) AS k FROM ids),
r AS (SELECT trail_id AS b, row_number() OVER (ORDER BY md5(concat('0|', trail_id, '|right')), trail_id) AS k FROM ids),
p AS (SELECT k, a, b FROM l JOIN r USING (k) WHERE k <= 10000 AND a <> b),
j AS (SELECT k, (SELECT count(*) FROM s x JOIN s y ON x.page_url = y.page_url WHERE x.trail_id = a AND y.trail_id = b) AS n_both,
  (SELECT count(DISTINCT page_url) FROM s WHERE trail_id IN (a, b)) AS n_any FROM p)
SELECT count(*) AS pairs, round(avg(n_both / n_any), 9) AS mean_jaccard, round(avg((n_both = 0)::INT), 9) AS disjoint_share FROM j""")
def page_jaccard(spark, sf):
    j = reports.page_jaccard(views.stops(spark, sf))
    return j.select("pairs", F.round("mean_jaccard", 9).alias("mean_jaccard"), F.round("disjoint_share", 9).alias("disjoint_share"))


@query("page_jaccard_exact", """WITH s AS (SELECT DISTINCT trail_id, page_url FROM stops_v WHERE page_url IS NOT NULL), z AS (SELECT trail_id, count(*) AS n FROM s GROUP BY 1),
j AS (SELECT x.trail_id AS a, y.trail_id AS b, count(*) AS n_both FROM s x JOIN s y ON x.page_url = y.page_url AND x.trail_id < y.trail_id GROUP BY 1, 2),
p AS (SELECT count(*) * (count(*) - 1) // 2 AS pairs FROM z)
SELECT any_value(pairs) AS pairs, round(sum(n_both / (za.n + zb.n - n_both)) / any_value(pairs), 9) AS mean_jaccard, round(1 - count(*) / any_value(pairs), 9) AS disjoint_share
FROM j JOIN z za ON za.trail_id = a JOIN z zb ON zb.trail_id = b, p""")
def page_jaccard_exact(spark, sf):
    j = reports.exact_page_jaccard(views.stops(spark, sf))
    return j.select("pairs", F.round("mean_jaccard", 9).alias("mean_jaccard"), F.round("disjoint_share", 9).alias("disjoint_share"))


@query("corpus_mix", """WITH t AS (SELECT trail_id, count(*) AS n FROM stops_v GROUP BY 1), c AS (SELECT trail_id, count(*) AS k FROM chain_v GROUP BY 1)
SELECT CASE WHEN t.trail_id IN (SELECT trail_id FROM deps_v) THEN 'dag' ELSE 'linear' END AS variant, count(*) AS trails, avg(n) AS mean_stops,
  avg(coalesce(k, 0)) AS mean_tool_calls FROM t LEFT JOIN c USING (trail_id) GROUP BY 1""")
def corpus_mix(spark, sf):
    s = views.stops(spark, sf)
    return reports.corpus_mix(s, views.chain(s), views.deps(s))


@query("distributions", """SELECT 'stop_type' AS field, stop_type AS item, count(*) AS times FROM stops_v GROUP BY ALL UNION ALL SELECT 'bridge_type', bridge_type, count(*) FROM stops_v GROUP BY ALL
UNION ALL SELECT 'value_type', value_type, count(*) FROM stops_v GROUP BY ALL UNION ALL SELECT 'tool', tool_name, count(*) FROM chain_v GROUP BY ALL
UNION ALL SELECT 'reason_transform', CASE trail_id % 3 WHEN 0 THEN 'digit_sum' WHEN 1 THEN 'next_prime' END, count(*) FROM stops_v WHERE stop_type = 'reason' GROUP BY ALL""")
def distributions(spark, sf):
    t = F.col("trail_id") % 3
    s = views.stops(spark, sf).withColumn("reason_transform", F.when(t == 0, "digit_sum").when(t == 1, "next_prime"))
    return reports.distributions(s, views.chain(s))


@query("variant_delta", """WITH r AS (SELECT t.level AS configuration, CASE WHEN t.trail_id IN (SELECT trail_id FROM deps_v) THEN 'dag' ELSE 'linear' END AS variant,
  (t.trail_id % 6 > 3)::INT::DOUBLE AS rate FROM trails_v t),
w AS (SELECT configuration, avg(rate) FILTER (variant = 'linear') * 100 AS linear, avg(rate) FILTER (variant = 'dag') * 100 AS dag FROM r GROUP BY 1)
SELECT configuration, round(linear, 6) AS linear, round(dag, 6) AS dag, round(dag - linear, 6) AS delta FROM w""")
def variant_delta(spark, sf):
    s = views.stops(spark, sf)
    dag = views.deps(s).select("trail_id").distinct().withColumn("variant", F.lit("dag"))
    rates = views.trails(spark, sf).join(dag, "trail_id", "left").select(
        F.col("level").alias("configuration"), F.coalesce("variant", F.lit("linear")).alias("variant"), (F.col("trail_id") % 6 > 3).cast("int").cast("double").alias("rate")
    )
    d = reports.variant_delta(rates)
    return d.select("configuration", *[F.round(c, 6).alias(c) for c in ("linear", "dag", "delta")])
