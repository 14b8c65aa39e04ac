"""Queries over checks and repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import checks, dag_checks, repair
from waymark.plans import views
from waymark.plans.registry import query
from waymark.session import cut_lineage

_FACTS = """
sizes_q AS (SELECT trail_id, count(*) AS n, count(*) FILTER (stop_type = 'tool') AS tools, count(*) FILTER (stop_type = 'reason') AS reasons FROM stops_v GROUP BY 1),
last_q AS (SELECT s.* FROM stops_v s JOIN sizes_q z ON z.trail_id = s.trail_id AND s.stop_index = z.n - 1),
facts_q AS (SELECT t.*, coalesce(z.n, 0) AS n, coalesce(z.tools, 0) AS tools, coalesce(z.reasons, 0) AS reasons, l.stop_type AS last_type, l.value_str AS last_value
  FROM trails_v t LEFT JOIN sizes_q z USING (trail_id) LEFT JOIN last_q l ON l.trail_id = t.trail_id)"""

_STRUCTURE = """
SELECT trail_id, 'no_stops' AS category, 'critical' AS severity, NULL::BIGINT AS stop_index FROM facts_q WHERE n = 0
UNION ALL SELECT trail_id, 'no_compute_stop', 'critical', NULL FROM facts_q WHERE n > 0 AND last_type <> 'compute'
UNION ALL SELECT trail_id, 'index_mismatch', 'warning', stop_index FROM stops_v WHERE stored_index <> stop_index
UNION ALL SELECT trail_id, 'invalid_stop_type', 'critical', stop_index FROM stops_v WHERE stop_type NOT IN ('page', 'tool', 'reason', 'compute')
UNION ALL SELECT trail_id, 'invalid_passcode', 'critical', NULL FROM facts_q WHERE passcode NOT BETWEEN 0 AND 9
UNION ALL SELECT trail_id, 'passcode_mismatch', 'critical', NULL FROM facts_q WHERE passcode BETWEEN 0 AND 9 AND last_type = 'compute'
  AND TRY_CAST(last_value AS BIGINT) % 10 <> passcode"""

_COUNTS = """
SELECT f.trail_id, x.category, 'warning' AS severity, NULL::BIGINT AS stop_index FROM facts_q f
JOIN (VALUES ('easy', 3, 6, 1, 2, 1, 2), ('medium', 7, 12, 2, 4, 2, 3), ('hard', 13, 16, 4, 5, 3, 4), ('extreme', 17, 21, 5, 7, 4, 6))
  c(level, d1, d2, t1, t2, r1, r2) ON c.level = f.level
CROSS JOIN (VALUES ('stop_count_out_of_range'), ('tool_stop_count_out_of_range'), ('reason_stop_count_out_of_range')) x(category)
WHERE CASE x.category WHEN 'stop_count_out_of_range' THEN n NOT BETWEEN d1 AND d2 + 1
  WHEN 'tool_stop_count_out_of_range' THEN tools NOT BETWEEN t1 AND t2 ELSE reasons NOT BETWEEN r1 AND r2 END"""

_VALUES = """
SELECT trail_id, 'null_extracted_value' AS category, 'critical' AS severity, stop_index FROM stops_v WHERE value_kind = 'null'
UNION ALL SELECT trail_id, 'value_type_mismatch', 'warning', stop_index FROM stops_v
  WHERE value_type = 'number' AND value_kind = 'string' AND TRY_CAST(value_str AS DOUBLE) IS NULL
UNION ALL SELECT trail_id, 'invalid_value_type', 'warning', stop_index FROM stops_v WHERE value_type NOT IN ('number', 'text', 'url', 'coords', 'date')
UNION ALL SELECT s.trail_id, 'zero_tool_value', 'critical', s.stop_index FROM stops_v s JOIN chain_v c USING (trail_id, stop_index)
  WHERE c.step = 0 AND s.stop_type = 'tool' AND s.value_num = 0 AND c.tool_name IN ('stock_historical_price', 'stock_volume',
  'crypto_historical_price', 'crypto_volume', 'countries_population', 'countries_area', 'maps_geocode', 'maps_elevation')
UNION ALL SELECT trail_id, 'duplicate_extracted_value', 'warning', min(stop_index) FROM stops_v
  WHERE stop_type <> 'compute' AND abs(value_num) > 100 GROUP BY trail_id, value_num HAVING count(*) > 1"""

_BRIDGES = """
SELECT trail_id, 'invalid_bridge_type' AS category, 'critical' AS severity, stop_index FROM stops_v
  WHERE bridge_type NOT IN ('link_follow', 'search_query', 'tool_call', 'compute')
UNION ALL SELECT trail_id, 'missing_bridge_field', 'warning', stop_index FROM stops_v s WHERE
  (bridge_type = 'link_follow' AND target_url IS NULL) OR (bridge_type = 'search_query' AND search_query IS NULL)
  OR (bridge_type = 'tool_call' AND NOT EXISTS (SELECT 1 FROM chain_v c WHERE c.trail_id = s.trail_id AND c.stop_index = s.stop_index))
  OR (bridge_type = 'compute' AND stop_type = 'compute' AND expression IS NULL)
UNION ALL SELECT trail_id, 'empty_tool_chain', 'critical', stop_index FROM stops_v s WHERE stop_type = 'tool'
  AND NOT EXISTS (SELECT 1 FROM chain_v c WHERE c.trail_id = s.trail_id AND c.stop_index = s.stop_index)"""

_STEPS = """
SELECT trail_id, 'invalid_tool_name' AS category, 'critical' AS severity, stop_index FROM chain_v WHERE tool_name = 'maps_lookup'
UNION ALL SELECT trail_id, 'stock_weekend_date', 'critical', stop_index FROM chain_v WHERE tool_name = 'stock_historical_price' AND isodow(CAST(arg_date AS DATE)) >= 6
UNION ALL SELECT trail_id, 'citation_in_tool_arg', 'critical', stop_index FROM chain_v WHERE contains(arg_address, '[')
UNION ALL SELECT trail_id, 'citation_in_value', 'critical', stop_index FROM stops_v WHERE value_kind = 'string' AND contains(value_str, '[')"""

_REFS = """
SELECT trail_id, 'invalid_reason_source' AS category, 'warning' AS severity, stop_index FROM stops_v
  WHERE stop_type = 'reason' AND (reason_source_stop < 0 OR reason_source_stop >= stop_index)
UNION ALL SELECT trail_id, 'invalid_depends_on', 'critical', stop_index FROM deps_v WHERE dep < 0 OR dep >= stop_index"""

_ALL = f"issues_q AS ({_STRUCTURE} UNION ALL {_COUNTS} UNION ALL {_VALUES} UNION ALL {_BRIDGES} UNION ALL {_STEPS} UNION ALL {_REFS})"


def _out(issues):
    return issues.drop("detail")


def _inputs(spark, sf):
    stops = cut_lineage(views.stops(spark, sf))  # numbered once for all groups of checks
    return views.trails(spark, sf), stops, views.chain(stops), views.deps(stops)


@query("check_structure", f"WITH {_FACTS} {_STRUCTURE}")
def check_structure(spark, sf):
    t, s = views.trails(spark, sf), views.stops(spark, sf)
    return _out(checks.check_structure(t, s).unionByName(checks.check_passcode(t, s)))


@query("check_counts", f"WITH {_FACTS} {_COUNTS}")
def check_counts(spark, sf):
    return _out(checks.check_counts(views.trails(spark, sf), views.stops(spark, sf)))


@query("check_values", _VALUES)
def check_values(spark, sf):
    s = views.stops(spark, sf)
    return _out(checks.check_values(s, views.chain(s)))


@query("check_duplicates", """SELECT trail_id, min(stop_index) AS stop_index, CAST(count(*) AS BIGINT) AS times FROM stops_v
  WHERE stop_type <> 'compute' AND abs(value_num) > 100 GROUP BY trail_id, value_num HAVING count(*) > 1""")
def check_duplicates(spark, sf):
    s = views.stops(spark, sf).where("stop_type <> 'compute' AND value_kind IN ('int', 'float') AND abs(value_num) > 100")
    g = s.groupBy("trail_id", "value_num").agg(F.min("stop_index").alias("stop_index"), F.count(F.lit(1)).alias("times"))
    return g.where("times > 1").drop("value_num")


@query("check_bridges", _BRIDGES)
def check_bridges(spark, sf):
    s = views.stops(spark, sf)
    return _out(checks.check_bridges(s, views.chain(s)))


@query("check_tool_steps", _STEPS)
def check_tool_steps(spark, sf):
    s = views.stops(spark, sf)
    return _out(checks.check_tool_steps(views.chain(s)).unionByName(checks.check_citations(s)))


@query("check_weekend", """SELECT trail_id, stop_index, arg_date, strftime(CAST(arg_date AS DATE) - CAST(isodow(CAST(arg_date AS DATE)) - 5 AS INTEGER), '%Y-%m-%d') AS friday
  FROM chain_v WHERE tool_name = 'stock_historical_price' AND isodow(CAST(arg_date AS DATE)) >= 6""")
def check_weekend(spark, sf):
    chain = views.chain(views.stops(spark, sf))
    fixed_chain = repair.repair_chain(chain.withColumn("arg_date", F.element_at("args", F.lit("date"))).where("tool_name = 'stock_historical_price'"))
    return fixed_chain.select("trail_id", "stop_index", "arg_date", F.element_at("args", F.lit("date")).alias("friday")).where("friday <> arg_date")


@query("check_references", _REFS)
def check_references(spark, sf):
    s = views.stops(spark, sf)
    return _out(checks.check_reason_sources(s).unionByName(checks.check_depends_on(views.deps(s))))


@query("check_riddle", """WITH sizes_q AS (SELECT trail_id, count(*) AS n FROM stops_v GROUP BY 1), r AS (
  SELECT r.*, coalesce(n, 0) AS n, len(regexp_extract_all(riddle, '(?m)^\\d+\\.')) AS clues, lower(regexp_replace(trim(seed_title), '\\s*\\([^)]+\\)\\s*$', '')) AS low
  FROM riddles_v r LEFT JOIN sizes_q USING (trail_id))
SELECT trail_id, 'missing_riddle' AS category, 'critical' AS severity FROM r WHERE length(riddle) < 50
UNION ALL SELECT trail_id, 'riddle_clue_count_mismatch', 'warning' FROM r WHERE length(riddle) >= 50 AND clues > 0 AND clues <> n
UNION ALL SELECT trail_id, 'title_leak_in_riddle', 'warning' FROM r WHERE length(riddle) >= 50 AND length(seed_title) >= 6 AND length(low) >= 6
  AND len(list_filter(regexp_split_to_array(lower(seed_title), '\\s+'), lambda w: w <> '' AND NOT list_contains(['the','and','for','that','this','with','from','have',
    'will','been','were','are','was','has','its','can','not','but','all','one','two','new','old','may'], w))) > 0
  AND contains(lower(riddle), low)""")
def check_riddle(spark, sf):
    s = views.stops(spark, sf)
    return checks.check_riddle(views.riddles(spark, sf), s).select("trail_id", "category", "severity")


@query("check_all", f"WITH {_FACTS}, {_ALL} SELECT category, severity, CAST(count(*) AS BIGINT) AS times FROM issues_q GROUP BY 1, 2")
def check_all(spark, sf):
    return checks.issue_counts(checks.check_trails(*_inputs(spark, sf)))


_VERDICT = f"""WITH {_FACTS}, {_ALL}, per_q AS (SELECT trail_id, count(*) FILTER (severity = 'critical') AS criticals,
  count(*) FILTER (severity = 'warning') AS warnings FROM issues_q GROUP BY 1),
verdict_q AS (SELECT t.trail_id, t.level, coalesce(criticals, 0) AS criticals, coalesce(warnings, 0) AS warnings, coalesce(criticals, 0) = 0 AS is_valid
  FROM trails_v t LEFT JOIN per_q p ON p.trail_id = t.trail_id)"""


@query("trail_verdicts", f"{_VERDICT} SELECT * FROM verdict_q")
def trail_verdicts(spark, sf):
    t, s, c, d = _inputs(spark, sf)
    return checks.verdicts(t, checks.check_trails(t, s, c, d))


@query("check_report", f"""{_VERDICT} SELECT level, count(*) AS scanned, count(*) FILTER (criticals + warnings > 0) AS flagged,
  count(*) FILTER (criticals > 0) AS critical, count(*) FILTER (criticals = 0 AND warnings > 0) AS warning_only,
  count(*) FILTER (criticals + warnings = 0) AS clean FROM verdict_q GROUP BY ROLLUP (level)""")
def check_report(spark, sf):
    t, s, c, d = _inputs(spark, sf)
    return checks.check_report(t, checks.check_trails(t, s, c, d))


@query("quarantine", f"""{_VERDICT} SELECT level, count(*) FILTER (is_valid) AS kept, count(*) FILTER (NOT is_valid) AS flagged FROM verdict_q GROUP BY 1""")
def quarantine(spark, sf):
    t, s, c, d = _inputs(spark, sf)
    kept, flagged = checks.split_flagged(t, checks.check_trails(t, s, c, d))
    both = kept.withColumn("ok", F.lit(True)).unionByName(flagged.withColumn("ok", F.lit(False)))
    return both.groupBy("level").agg(F.count_if("ok").alias("kept"), F.count_if(~F.col("ok")).alias("flagged"))


@query("invalid_documents", """SELECT doc_id AS trail_id, 'invalid_json' AS category, 'critical' AS severity FROM (
  SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE CAST(to_json({'t': text}) AS VARCHAR) END AS t FROM documents) WHERE NOT coalesce(json_valid(t), false)""")
def invalid_documents(spark, sf):
    d = views.load(spark, sf, "documents")
    doc = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.to_json(F.struct(F.col("text").alias("t"))))
    return checks.invalid_documents(d.select(F.col("doc_id").alias("trail_id"), doc.alias("text"))).select("trail_id", "category", "severity")


# --- DAG -----------------------------------------------------------------------------------

_DAG = """
dag_q AS (SELECT DISTINCT trail_id FROM deps_v),
size_q AS (SELECT trail_id, count(*) AS n FROM stops_v GROUP BY 1),
sum_q AS (SELECT s.*, (SELECT count(*) FROM deps_v d WHERE d.trail_id = s.trail_id AND d.stop_index = s.stop_index) AS n_deps,
  (SELECT max(dep) FROM deps_v d WHERE d.trail_id = s.trail_id AND d.stop_index = s.stop_index) AS one_dep
  FROM stops_v s WHERE trail_id IN (FROM dag_q)),
edge_q AS (SELECT d.trail_id, d.stop_index, d.dep, z.n, t.stop_type AS dep_type FROM deps_v d JOIN size_q z USING (trail_id)
  LEFT JOIN stops_v t ON t.trail_id = d.trail_id AND t.stop_index = CASE WHEN d.dep < 0 THEN z.n + d.dep ELSE d.dep END)"""


@query("dag_dependencies", f"""WITH {_DAG}
SELECT trail_id, 'diamond_root_has_deps' AS category, 'warning' AS severity, stop_index FROM sum_q WHERE stop_index = 0 AND n_deps > 0
UNION ALL SELECT trail_id, 'diamond_missing_depends_on', 'warning', stop_index FROM sum_q WHERE stop_index > 0 AND n_deps = 0
UNION ALL SELECT trail_id, 'diamond_dep_out_of_range', 'critical', stop_index FROM edge_q WHERE dep < 0 OR dep >= n
UNION ALL SELECT trail_id, 'diamond_forward_dep', 'critical', stop_index FROM edge_q WHERE dep >= stop_index AND dep < n""")
def dag_dependencies(spark, sf):
    s = views.stops(spark, sf)
    return _out(dag_checks.check_dependencies(s, views.deps(s)))


@query("dag_merges", f"""WITH {_DAG},
merge_q AS (SELECT s.*, c.tool_name AS first_tool FROM sum_q s LEFT JOIN chain_v c ON c.trail_id = s.trail_id AND c.stop_index = s.stop_index AND c.step = 0
  WHERE n_deps >= 2 AND stop_type <> 'compute')
SELECT trail_id, 'diamond_merge_wrong_type' AS category, 'critical' AS severity, stop_index FROM merge_q WHERE stop_type <> 'tool'
UNION ALL SELECT trail_id, 'diamond_merge_no_code', 'critical', stop_index FROM merge_q WHERE stop_type = 'tool' AND coalesce(first_tool, '') <> 'python_execute_code'
UNION ALL SELECT trail_id, 'diamond_merge_value_mismatch', 'critical', stop_index FROM merge_q WHERE stop_type = 'tool' AND first_tool = 'python_execute_code'
  AND TRY_CAST(value_str AS DOUBLE) IS NOT NULL AND l_partkey % 3 = 0
UNION ALL SELECT trail_id, 'diamond_merge_dep_wrong_type', 'warning', stop_index FROM merge_q m JOIN edge_q e USING (trail_id, stop_index)
  WHERE stop_type = 'tool' AND first_tool = 'python_execute_code' AND dep_type NOT IN ('tool', 'page', 'reason')
UNION ALL SELECT trail_id, 'diamond_branch_dep_not_page', 'warning', stop_index FROM sum_q s JOIN edge_q e USING (trail_id, stop_index)
  WHERE stop_type = 'tool' AND n_deps = 1 AND one_dep <> stop_index - 1 AND dep_type <> 'page'""")
def dag_merges(spark, sf):
    s = views.stops(spark, sf)
    return _out(dag_checks.check_merges(s, views.chain(s), views.deps(s)))


@query("dag_final_digit", f"""WITH {_FACTS} SELECT trail_id, 'diamond_passcode_mismatch' AS category, 'critical' AS severity, n - 1 AS stop_index
FROM facts_q WHERE trail_id IN (SELECT trail_id FROM deps_v) AND last_type = 'compute' AND TRY_CAST(last_value AS BIGINT) % 10 <> passcode""")
def dag_final_digit(spark, sf):
    s = views.stops(spark, sf)
    return _out(dag_checks.check_final_digit(views.trails(spark, sf), s, views.deps(s)))


@query("dag_clues", """WITH z AS (SELECT trail_id, count(*) AS n FROM stops_v WHERE trail_id IN (SELECT trail_id FROM deps_v) GROUP BY 1),
c AS (SELECT trail_id, n, len(regexp_extract_all(riddle, '(?m)^\\s*\\d+\\.')) AS clues FROM riddles_v JOIN z USING (trail_id))
SELECT trail_id, 'diamond_riddle_clue_mismatch' AS category, 'warning' AS severity, clues FROM c WHERE clues > 0 AND clues <> n""")
def dag_clues(spark, sf):
    s = views.stops(spark, sf)
    found = dag_checks.check_clues(views.riddles(spark, sf), s, views.deps(s))
    return found.select("trail_id", "category", "severity", F.col("detail").cast("bigint").alias("clues"))


@query("dag_unreachable", """WITH RECURSIVE roots_q AS (SELECT trail_id, stop_index FROM stops_v s WHERE NOT EXISTS
    (SELECT 1 FROM deps_v d WHERE d.trail_id = s.trail_id AND d.stop_index = s.stop_index)),
start_q AS (SELECT * FROM roots_q UNION ALL SELECT DISTINCT trail_id, 0 FROM stops_v WHERE trail_id NOT IN (SELECT trail_id FROM roots_q)),
reach_q AS (SELECT trail_id, stop_index FROM start_q UNION SELECT d.trail_id, d.stop_index FROM reach_q r JOIN deps_v d ON d.trail_id = r.trail_id AND d.dep = r.stop_index)
SELECT trail_id, stop_index FROM stops_v WHERE trail_id IN (SELECT trail_id FROM deps_v) EXCEPT SELECT trail_id, stop_index FROM reach_q""")
def dag_unreachable(spark, sf):
    s = views.stops(spark, sf)
    return dag_checks.unreachable_stops(s, views.deps(s))


# --- repair --------------------------------------------------------------------------------


@query("repair_passcode", f"""WITH {_FACTS} SELECT trail_id, passcode AS old_passcode, TRY_CAST(last_value AS BIGINT) % 10 AS passcode FROM facts_q
WHERE last_type = 'compute' AND TRY_CAST(last_value AS BIGINT) % 10 <> passcode""")
def repair_passcode(spark, sf):
    return repair.passcode_fix(views.trails(spark, sf), views.stops(spark, sf))


_FIXED = """
fixed_q AS (SELECT *, CASE WHEN value_kind = 'string' THEN trim(regexp_replace(value_str, '\\[(\\d+|note \\d+)\\]', '', 'g')) END AS cleaned,
  CASE WHEN value_kind = 'string' AND value_type = 'number' AND value_str <> 'Old Harbour'
       THEN extracted_value * CASE WHEN contains(value_str, 'million') THEN 1000000.0 ELSE 1.0 END END AS parsed,
  bridge_type = 'link_follow' AND target_url IS NULL AND page_url IS NOT NULL AS fix_target FROM stops_v)"""


@query("repair_stops", f"""WITH {_FIXED} SELECT trail_id, stop_index,
  CASE WHEN cleaned <> value_str THEN 'string' WHEN parsed IS NOT NULL THEN 'int' ELSE value_kind END AS value_kind,
  CASE WHEN cleaned <> value_str THEN cleaned WHEN parsed IS NOT NULL THEN CAST(CAST(parsed AS BIGINT) AS VARCHAR) ELSE value_str END AS value_str,
  CASE WHEN cleaned <> value_str THEN NULL WHEN parsed IS NOT NULL THEN CAST(parsed AS DOUBLE) ELSE value_num END AS value_num,
  CASE WHEN fix_target THEN page_url ELSE target_url END AS target_url FROM fixed_q""")
def repair_stops(spark, sf):
    cols = ["trail_id", "stop_index", "value_kind", "value_str", "value_num", "target_url"]
    return repair.repair_stops(views.stops(spark, sf)).select(*cols)


@query("repair_chain", """SELECT trail_id, stop_index, step, CASE WHEN isodow(CAST(arg_date AS DATE)) >= 6
   THEN strftime(CAST(arg_date AS DATE) - CAST(isodow(CAST(arg_date AS DATE)) - 5 AS INTEGER), '%Y-%m-%d') ELSE arg_date END AS arg_date,
  replace(arg_address, '[2]', '') AS arg_address FROM chain_v""")
def repair_chain(spark, sf):
    fixed_chain = repair.repair_chain(views.chain(views.stops(spark, sf)))
    return fixed_chain.select(
        "trail_id", "stop_index", "step",
        F.try_element_at("args", F.lit("date")).alias("arg_date"), F.try_element_at("args", F.lit("address")).alias("arg_address"),
    )


@query("repair_totals", f"""WITH {_FACTS}, {_FIXED}, rows_q AS (
  SELECT trail_id, 'value_type_fixed' AS fix, 1 AS times FROM fixed_q WHERE parsed IS NOT NULL
  UNION ALL SELECT trail_id, 'target_url_fixed', 1 FROM fixed_q WHERE fix_target
  UNION ALL SELECT trail_id, 'citation_in_value_fixed', 1 FROM fixed_q WHERE cleaned <> value_str
  UNION ALL SELECT trail_id, 'weekend_date_fixed', 1 FROM chain_v WHERE isodow(CAST(arg_date AS DATE)) >= 6
  UNION ALL SELECT trail_id, 'citation_in_arg_fixed', 1 FROM chain_v WHERE contains(arg_address, '[')
  UNION ALL SELECT trail_id, 'passcode_fixed', 1 FROM facts_q WHERE last_type = 'compute' AND TRY_CAST(last_value AS BIGINT) % 10 <> passcode)
SELECT level, fix, CAST(sum(times) AS BIGINT) AS times FROM rows_q JOIN trails_v USING (trail_id) GROUP BY 1, 2
UNION ALL SELECT level, 'files', count(DISTINCT trail_id) FROM rows_q JOIN trails_v USING (trail_id) GROUP BY 1""")
def repair_totals(spark, sf):
    s = views.stops(spark, sf)
    t = views.trails(spark, sf)
    return repair.fix_totals(t, repair.fix_counts(t, s, views.chain(s)))


@query("repaired_trails", f"""WITH {_FACTS} SELECT trail_id, CASE WHEN last_type = 'compute' THEN TRY_CAST(last_value AS BIGINT) % 10 ELSE passcode END AS passcode FROM facts_q""")
def repaired_trails(spark, sf):
    s = views.stops(spark, sf)
    return repair.repair(views.trails(spark, sf), s, views.chain(s)).trails.select("trail_id", "passcode")
