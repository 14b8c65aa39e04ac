"""Queries over riddles, files and the tool-log stream."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators import riddles
from waymark.plans import views
from waymark.plans.registry import query
from waymark.plans.reply_queries import keyed_chain
from waymark.session import cut_lineage, scratch_path, written
from waymark.sources import readers, writers
from waymark.streaming import tool_log

P = "https://en.wikipedia.org/wiki/"


def _titled_stops(spark, sf):
    """Stops whose pages carry words of the documents, so that riddles name some of them."""
    d = views.load(spark, sf, "documents").select(F.col("doc_id").alias("trail_id"), F.split_part("text", F.lit(" "), F.lit(3)).alias("a"), F.split_part("text", F.lit(" "), F.lit(4)).alias("b"))
    s = views.stops(spark, sf).select("trail_id", "stop_index", "stop_type", "l_partkey").join(d, "trail_id")
    title = F.when(F.col("l_partkey") % 3 == 0, F.concat("a", F.lit("_"), "b")).otherwise(F.concat(F.lit("Part_"), F.col("l_partkey").cast("string")))
    return s.withColumn("page_url", F.when(F.col("stop_type").isin("page", "tool"), F.concat(F.lit(P), title)))


_TITLED = """ts AS (SELECT s.trail_id, s.stop_index, CASE WHEN l_partkey % 3 = 0 THEN concat(split_part(text, ' ', 3), ' ', split_part(text, ' ', 4)) ELSE concat('Part ', l_partkey) END AS title
  FROM stops_v s JOIN documents d ON d.doc_id = s.trail_id WHERE stop_type IN ('page', 'tool'))"""


@query("forbidden_titles", "SELECT trail_id, stop_index, replace(replace(page_url, 'https://en.wikipedia.org/wiki/', ''), '_', ' ') AS title FROM stops_v WHERE stop_index <> 0 AND page_url IS NOT NULL")
def forbidden_titles(spark, sf):
    return riddles.forbidden_titles(views.stops(spark, sf)).select("trail_id", "stop_index", "title")


@query("leaks_strict", f"WITH {_TITLED} SELECT ts.trail_id, stop_index, title FROM ts JOIN riddles_v r ON r.trail_id = ts.trail_id WHERE stop_index <> 0 AND contains(lower(riddle), lower(title))")
def leaks_strict(spark, sf):
    s = _titled_stops(spark, sf).withColumn("page_url", F.replace("page_url", F.lit("%"), F.lit("%25")))
    return riddles.leaks_strict(s, views.riddles(spark, sf))


_LEAKS = f"""{_TITLED}, lt AS (SELECT trail_id, -1 AS stop_index, seed_title AS title FROM riddles_v UNION ALL SELECT * FROM ts),
leak_q AS (SELECT lt.trail_id, stop_index, title, level FROM lt JOIN riddles_v r ON r.trail_id = lt.trail_id WHERE length(title) >= 6 AND length(regexp_replace(trim(title), '\\s*\\([^)]+\\)\\s*$', '')) >= 6
  AND contains(lower(riddle), lower(trim(regexp_replace(title, '\\s*\\([^)]+\\)\\s*$', '')))) QUALIFY row_number() OVER (PARTITION BY lt.trail_id, lower(title) ORDER BY stop_index) = 1)"""


def _leaks(spark, sf):
    s = _titled_stops(spark, sf).withColumn("page_url", F.replace("page_url", F.lit("%"), F.lit("%25")))
    return riddles.corpus_leaks(views.riddles(spark, sf), s)


@query("title_leaks", f"WITH {_LEAKS} SELECT trail_id, stop_index, title FROM leak_q")
def title_leaks(spark, sf):
    return _leaks(spark, sf)


@query("leak_report", f"WITH {_LEAKS}, p AS (SELECT trail_id, count(*) AS n FROM leak_q GROUP BY 1) SELECT level, count(*) AS trails, count(n) AS with_leaks, coalesce(CAST(sum(n) AS BIGINT), 0) AS leaks FROM riddles_v r LEFT JOIN p ON p.trail_id = r.trail_id GROUP BY 1")
def leak_report(spark, sf):
    return riddles.leak_report(views.riddles(spark, sf), _leaks(spark, sf))


@query("rewrites", f"""WITH {_LEAKS}, o AS (SELECT trail_id, count(*) AS n FROM leak_q GROUP BY 1) SELECT trail_id, n AS leaks_before, CASE WHEN trail_id % 2 = 0 THEN 0 ELSE n END AS leaks_after, CASE WHEN trail_id % 2 = 0 THEN 'fixed' ELSE 'kept' END AS verdict FROM o""")
def rewrites(spark, sf):
    old = views.riddles(spark, sf)
    new = old.withColumn("riddle", F.when(F.col("trail_id") % 2 == 0, F.lit("1")).otherwise(F.col("riddle")))
    s = _titled_stops(spark, sf).withColumn("page_url", F.replace("page_url", F.lit("%"), F.lit("%25")))
    return riddles.accept_rewrites(old, new, s)


@query("clue_counts", "SELECT trail_id, len(regexp_extract_all(riddle, '(?m)^\\d+\\.')) AS clues, len(regexp_extract_all(riddle, '(?m)^\\s*\\d+\\.')) AS indented_clues FROM riddles_v")
def clue_counts(spark, sf):
    from waymark.operators.checks import clue_count

    r = F.col("riddle")
    return views.riddles(spark, sf).select("trail_id", clue_count(r).cast("bigint").alias("clues"), clue_count(r, indented=True).cast("bigint").alias("indented_clues"))


def _plans(spark, sf):
    """Round-trip plans: a topic step per page, a height step, a closing formula on even trails; some fenced or broken."""
    return _plans_of(views.stops(spark, sf))


def _plans_of(stops):
    t = F.col("trail_id")
    topic = F.lower(F.replace(F.element_at(F.split("page_url", "/wiki/"), -1), F.lit("_"), F.lit(" ")))
    own = F.struct(F.when(F.col("l_partkey") % 2 == 0, topic).otherwise("other thing").alias("page_or_topic"), F.lit("altitude").alias("what_to_find"), F.lit("maps").alias("tool_or_method"), F.lit("next").alias("result_used_for"))
    steps = stops.where("page_url IS NOT NULL").groupBy("trail_id").agg(F.array_sort(F.collect_list(F.struct("stop_index", own.alias("o")))).alias("os"))
    last = F.struct(F.lit("").alias("page_or_topic"), F.lit("the sum").alias("what_to_find"), F.when(t % 2 == 0, "modulo").otherwise("none").alias("tool_or_method"), F.lit("answer").alias("result_used_for"))
    js = F.to_json(F.concat(F.col("os.o"), F.array(last)))
    return steps.select("trail_id", F.when(t % 7 == 0, "no plan").when(t % 3 == 0, F.concat(F.lit("```json\n"), js, F.lit("\n```"))).otherwise(js).alias("reply"))


_PLAN = """pn AS (SELECT trail_id, count(*) AS n FROM stops_v WHERE page_url IS NOT NULL GROUP BY 1)"""


@query("plan_steps", f"""WITH {_PLAN} SELECT trail_id, CAST(row_number() OVER (PARTITION BY trail_id ORDER BY stop_index) - 1 AS INTEGER) AS pos,
  CASE WHEN l_partkey % 2 = 0 THEN lower(replace(replace(page_url, 'https://en.wikipedia.org/wiki/', ''), '_', ' ')) ELSE 'other thing' END AS page_or_topic, 'altitude' AS what_to_find, 'maps' AS tool_or_method, 'next' AS result_used_for
FROM stops_v WHERE page_url IS NOT NULL AND trail_id % 7 <> 0
UNION ALL SELECT trail_id, CAST(n AS INTEGER), '', 'the sum', CASE WHEN trail_id % 2 = 0 THEN 'modulo' ELSE 'none' END, 'answer' FROM pn WHERE trail_id % 7 <> 0""")
def plan_steps(spark, sf):
    return riddles.plan_steps(_plans(spark, sf))


_KINDS = """tk AS (SELECT DISTINCT c.trail_id, CASE c.tool_name WHEN 'maps_elevation' THEN 'elevation' WHEN 'countries_population' THEN 'population' WHEN 'python_execute_code' THEN 'computation' END AS kind FROM chain_v c
  WHERE c.tool_name IN ('maps_elevation', 'countries_population', 'python_execute_code') UNION SELECT trail_id, CASE stop_type WHEN 'reason' THEN 'reasoning' ELSE 'computation' END FROM stops_v WHERE stop_type IN ('reason', 'compute'))"""


@query("tool_types", f"WITH {_KINDS} SELECT DISTINCT trail_id, kind FROM tk")
def tool_types(spark, sf):
    s = views.stops(spark, sf)
    return riddles.trail_tool_types(s, keyed_chain(s))


@query("step_types", f"WITH {_PLAN} SELECT trail_id, 'elevation' AS kind FROM pn WHERE trail_id % 7 <> 0 UNION ALL SELECT trail_id, 'computation' FROM pn WHERE trail_id % 7 <> 0 AND trail_id % 2 = 0")
def step_types(spark, sf):
    return riddles.step_tool_types(riddles.plan_steps(_plans(spark, sf)))


@query("alignment", f"""WITH {_PLAN}, {_KINDS}, z AS (SELECT trail_id, count(*) AS n_stops FROM stops_v GROUP BY 1),
tp AS (SELECT DISTINCT trail_id, lower(replace(replace(page_url, 'https://en.wikipedia.org/wiki/', ''), '_', ' ')) AS topic FROM stops_v WHERE page_url IS NOT NULL),
st AS (SELECT DISTINCT trail_id, CASE WHEN l_partkey % 2 = 0 THEN lower(replace(replace(page_url, 'https://en.wikipedia.org/wiki/', ''), '_', ' ')) ELSE 'other thing' END AS t FROM stops_v WHERE page_url IS NOT NULL),
ts2 AS (SELECT tp.trail_id, count(*) AS n_topics, count(*) FILTER (EXISTS (SELECT 1 FROM st WHERE st.trail_id = tp.trail_id AND (contains(t, topic) OR contains(topic, t) OR contains(t, 'part')))) AS seen FROM tp GROUP BY 1),
kd AS (SELECT trail_id, count(*) AS n_kinds, count(*) FILTER (kind = 'elevation' OR (kind = 'computation' AND trail_id % 2 = 0)) AS n_hit FROM (SELECT DISTINCT * FROM tk) GROUP BY 1)
SELECT z.trail_id, round(CASE WHEN pn.n IS NULL OR z.trail_id % 7 = 0 THEN 0.0 ELSE (CASE WHEN abs(n_stops - n - 1) <= 2 THEN 1.0 WHEN abs(n_stops - n - 1) <= 4 THEN 0.5 ELSE 0 END + seen / n_topics + coalesce(n_hit / n_kinds, 1.0) + (z.trail_id % 2 = 0)::INT) / 4 END, 9)::DOUBLE AS alignment
FROM z LEFT JOIN pn USING (trail_id) LEFT JOIN ts2 USING (trail_id) LEFT JOIN kd USING (trail_id)""")
def alignment(spark, sf):
    # read for sizes, topics, kinds of tools and plans: numbered and written once
    s = views.stops(spark, sf).select("trail_id", "stop_index", "stop_type", "page_url", "extracted_value", "tool_name", "tool_date", "address", "l_partkey", "l_suppkey")
    s = written(s, "aligned-stops")
    return riddles.alignment(s, keyed_chain(s), _plans_of(s)).withColumn("alignment", F.round("alignment", 9))


@query("implied_digits", """WITH c AS (SELECT conv_id, turn, trim(text, chr(10) || ' ') || CASE turn % 3 WHEN 0 THEN chr(10) || 'so it is ' || (conv_id % 10) || ' now' WHEN 1 THEN '' ELSE ' 4' || chr(10) || 'done' END AS t FROM conversations)
SELECT conv_id, turn, CAST(coalesce(nullif(regexp_extract(string_split(t, chr(10))[-1], '(\\d)[^\\d]*$', 1), ''), nullif(regexp_extract(t, '(\\d)[^\\d]*$', 1), '')) AS INTEGER) AS digit FROM c""")
def implied_digits(spark, sf):
    tail = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("\nso it is "), (F.col("conv_id") % 10).cast("string"), F.lit(" now"))).when(F.col("turn") % 3 == 1, "").otherwise(" 4\ndone")
    c = views.load(spark, sf, "conversations").withColumn("text", F.concat(F.btrim("text", F.lit("\n ")), tail))
    return c.select("conv_id", "turn", riddles.implied_digit(F.col("text")).alias("digit"))


@query("adopt_digit", """WITH a AS (SELECT l_orderkey AS trail_id, rn AS attempt, l_suppkey % 5 = 0 AS leaky, l_partkey % 10 AS al, CASE WHEN l_linenumber > 5 THEN NULL ELSE l_suppkey % 4 END AS implied FROM lines_v),
g AS (SELECT a.*, passcode FROM a JOIN trails_v t ON t.trail_id = a.trail_id WHERE NOT leaky AND al >= 7 AND implied IS NOT NULL),
r AS (SELECT trail_id, min(attempt) AS attempt, any_value(passcode) AS digit FROM g WHERE implied = passcode GROUP BY 1),
v AS (SELECT trail_id, implied, count(*) AS votes, min(attempt) AS first_seen, arg_max(attempt, al * 1000 - attempt) AS attempt FROM g WHERE implied <> passcode AND trail_id NOT IN (SELECT trail_id FROM r) GROUP BY 1, 2),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY trail_id ORDER BY votes DESC, first_seen) = 1)
SELECT trail_id, attempt, CAST(digit AS INTEGER) AS digit, 'accepted' AS outcome FROM r UNION ALL SELECT trail_id, attempt, CAST(implied AS INTEGER), 'adopted' FROM b WHERE votes >= 2""")
def adopt_digit(spark, sf):
    from waymark.functions.skew import dense_index

    lines = dense_index(views.load(spark, sf, "lineitem"), ["l_orderkey"], [F.col(c) for c in views._LINE_ORDER], F.struct("l_linenumber", F.floor(F.col("l_partkey") / 256)), "rn")
    a = lines.select(
        F.col("l_orderkey").alias("trail_id"), (F.col("rn") + 1).alias("attempt"), F.when(F.col("l_suppkey") % 5 == 0, 1).otherwise(0).alias("leaks"), (F.col("l_partkey") % 10 / 10).alias("alignment"),
        F.when(F.col("l_linenumber") <= 5, F.col("l_suppkey") % 4).alias("implied"),
    )
    return riddles.adopt(a, views.trails(spark, sf))


_FULL_STOPS = """full_q AS (SELECT CAST(s.trail_id AS VARCHAR) AS trail_id, stop_index, stored_index, stop_type, page_url,
  concat('target ', stop_index, ' "q" \\ é') AS extraction_target, CASE WHEN stop_index % 2 = 0 THEN 'infobox' END AS extraction_section, value_kind, value_str, value_num, value_type, bridge_type,
  target_url, search_query, CASE WHEN stop_index % 3 = 0 THEN page_url END AS expected_result_url, expression, CASE WHEN stop_type = 'compute' THEN concat('print(', stop_index, ')') END AS expression_code,
  CASE WHEN stop_type = 'compute' THEN [0, stop_index] END AS referenced_stops, concat('because ', stop_type) AS reasoning,
  CASE WHEN stop_type = 'reason' THEN 'digit_sum' END AS reason_transform, CASE WHEN stop_type = 'reason' THEN 'x = 1' END AS reason_code, reason_source_stop FROM stops_v s)"""


def _full(stops):
    """Stops with a value in every stored field."""
    i, kind = F.col("stop_index"), F.col("stop_type")
    return stops.withColumns({
        "extraction_target": F.concat(F.lit("target "), i.cast("string"), F.lit(' "q" \\ é')), "extraction_section": F.when(i % 2 == 0, "infobox"), "expected_result_url": F.when(i % 3 == 0, F.col("page_url")),
        "expression_code": F.when(kind == "compute", F.concat(F.lit("print("), i.cast("string"), F.lit(")"))), "referenced_stops": F.when(kind == "compute", F.array(F.lit(0).cast("bigint"), i)),
        "reasoning": F.concat(F.lit("because "), kind), "reason_transform": F.when(kind == "reason", "digit_sum"), "reason_code": F.when(kind == "reason", "x = 1"),
    })


@query("stop_contexts", f"""WITH {_FULL_STOPS},
step_q AS (SELECT trail_id, stop_index, string_agg(tool_name, ', ' ORDER BY step) AS tools, string_agg(CASE WHEN shown <> '' THEN concat('Arguments of ', tool_name, ': ', shown) END, chr(10) ORDER BY step) AS calls
  FROM (SELECT *, CASE WHEN arg_date IS NOT NULL THEN concat('date=', arg_date, ', ticker=ABC') WHEN arg_code IS NOT NULL THEN concat('code=', arg_code) WHEN arg_address IS NOT NULL THEN concat('address=', arg_address) ELSE '' END AS shown FROM chain_v) GROUP BY 1, 2),
need_q AS (SELECT trail_id, stop_index, count(*) AS n, string_agg(CAST(dep + 1 AS VARCHAR), ', ' ORDER BY dep) AS clues FROM deps_v GROUP BY 1, 2),
page_q AS (SELECT url, concat('Part ', CAST(k AS VARCHAR)) AS title FROM wiki_v),
all_q AS (SELECT f.*, s.trail_id AS trail, x.page_url AS next_url, x.trail_id IS NOT NULL AND f.stop_type = 'page' AS leads, p.title, y.url IS NOT NULL AS next_known, l.src IS NOT NULL AS linked, t.tools, t.calls, d.n AS n_deps, d.clues
  FROM stops_v s JOIN full_q f ON f.trail_id = CAST(s.trail_id AS VARCHAR) AND f.stop_index = s.stop_index LEFT JOIN stops_v x ON x.trail_id = s.trail_id AND x.stop_index = s.stop_index + 1
  LEFT JOIN page_q p ON p.url = s.page_url LEFT JOIN page_q y ON y.url = x.page_url AND s.page_url <> '' LEFT JOIN links_v l ON l.src = s.page_url AND l.dst = x.page_url
  LEFT JOIN step_q t ON t.trail_id = s.trail_id AND t.stop_index = s.stop_index LEFT JOIN need_q d ON d.trail_id = s.trail_id AND d.stop_index = s.stop_index),
way_q AS (SELECT *, leads AND bridge_type = 'link_follow' AND coalesce(next_url, '') <> '' AS follows, leads AND bridge_type = 'search_query' AS searches FROM all_q)
SELECT trail AS trail_id, stop_index, regexp_replace(concat_ws(chr(10), concat('Stop ', stop_index + 1, ' (', stop_type, ')'), CASE WHEN title IS NOT NULL THEN concat('Page: ', title) WHEN page_url <> '' THEN concat('Page URL: ', page_url) END,
  CASE WHEN title IS NOT NULL THEN 'Intro: A part.' END, concat('Target: ', extraction_target), CASE WHEN value_type <> '' THEN concat('Value type: ', value_type) END, CASE WHEN extraction_section <> '' THEN concat('Section: ', extraction_section) END,
  CASE WHEN stop_type = 'tool' AND tools <> '' THEN concat('Tools: ', tools) END, CASE WHEN stop_type = 'tool' THEN calls END, CASE WHEN n_deps >= 2 THEN concat('Merges clues: ', clues) END,
  CASE WHEN stop_type = 'reason' AND reason_transform <> '' THEN concat('Transform: ', reason_transform) END, CASE WHEN stop_type = 'reason' THEN concat('Transforms clue: ', coalesce(reason_source_stop, 0) + 1) END,
  CASE WHEN stop_type = 'compute' AND expression <> '' THEN concat('Expression: ', expression) END, CASE WHEN stop_type = 'compute' AND expression_code <> '' THEN concat('Expression code: ', expression_code) END,
  CASE WHEN stop_type = 'compute' THEN concat('Refers to clues: 1, ', stop_index + 1) END, CASE WHEN follows THEN 'Next: follow a link' WHEN searches THEN 'Next: search' END,
  CASE WHEN follows AND linked THEN 'Link text: link' END, CASE WHEN searches AND search_query <> '' THEN concat('Search: ', search_query) END, CASE WHEN (follows OR searches) AND next_known THEN 'Next intro: A part.' END), chr(10) || '+', chr(10), 'g') AS context
FROM way_q""")
def stop_contexts(spark, sf):
    # read for next stops, chains, dependencies and links: numbered and written once
    s = views.stops(spark, sf).select(
        "trail_id", "stop_index", "stop_type", "page_url", "value_type", "bridge_type", "search_query", "expression", "reason_source_stop",
        "extracted_value", "tool_name", "tool_date", "address", "l_partkey", "l_suppkey",
    )
    s = _full(written(s, "context-stops"))
    w = views.wiki(spark, sf).select("url", F.concat(F.lit("Part "), F.col("k").cast("string")).alias("title"), F.lit("A part.").alias("first_paragraph"))
    l = views.links(s).select(F.col("src").alias("url"), "pos", F.lit("link").alias("text"), F.col("dst").alias("target_url"))
    return riddles.stop_contexts(s, w, l, views.chain(s), views.deps(s))


@query("target_lengths", "SELECT trail_id, CASE WHEN count(*) <= 4 THEN '100-200' WHEN count(*) <= 7 THEN '200-350' ELSE '300-500' END AS target_length FROM stops_v GROUP BY 1")
def target_lengths(spark, sf):
    return riddles.target_lengths(views.stops(spark, sf))


# --- files ---------------------------------------------------------------------------------


def _stored(spark, sf):
    """The corpus written as documents to the shared folder and read back."""
    # read for stops, chains and dependencies: numbered and written once
    s = _full(written(views.stops(spark, sf), "document-stops"))
    t = views.trails(spark, sf).withColumn("riddle", F.concat(F.lit('Say "'), "seed_title", F.lit('"')))
    t = t.withColumns({"generated_at": F.concat(F.lit("day "), F.col("trail_id").cast("string")), "metadata": F.concat(F.lit('{"sample_id":'), F.col("trail_id").cast("string"), F.lit(',"theme":"x"}'))})
    c = views.chain(s).withColumn("output_key", F.concat(F.lit("key"), F.col("step").cast("string"))).withColumn("expected_output", F.col("tool_name"))
    path = scratch_path(spark, "trails")
    writers.write_trails(writers.trail_documents(t, s, c, views.deps(s)), path)
    return readers.read_document_lines(spark, path)


@query("stored_trails", """SELECT CAST(trail_id AS VARCHAR) AS trail_id, concat_ws('/', level, CAST(trail_id AS VARCHAR)) AS sample_id, level, passcode, seed_url, seed_title, concat('Say "', seed_title, '"') AS riddle,
  concat('day ', CAST(trail_id AS VARCHAR)) AS generated_at, concat('{"sample_id":', CAST(trail_id AS VARCHAR), ',"theme":"x"}') AS metadata FROM trails_v""")
def stored_trails(spark, sf):
    return readers.trails(_stored(spark, sf))


@query("stored_stops", f"WITH {_FULL_STOPS} SELECT * FROM full_q")
def stored_stops(spark, sf):
    return readers.stops(_stored(spark, sf))


@query("stored_chains", """SELECT CAST(trail_id AS VARCHAR) AS trail_id, stop_index, step, tool_name, arg_address, arg_code, concat('key', CAST(step AS VARCHAR)) AS output_key, tool_name AS expected_output FROM chain_v""")
def stored_chains(spark, sf):
    c = readers.chain(_stored(spark, sf))
    arg = lambda name: F.try_element_at("args", F.lit(name)).alias(f"arg_{name}")
    return c.select("trail_id", "stop_index", "step", "tool_name", arg("address"), arg("code"), "output_key", "expected_output")


@query("stored_deps", "SELECT CAST(trail_id AS VARCHAR) AS trail_id, stop_index, dep FROM deps_v")
def stored_deps(spark, sf):
    return readers.deps(_stored(spark, sf))


def _log_lines(spark, sf):
    """The tool log as JSON lines (seq, value)."""
    log = views.tool_log(spark, sf).withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).withColumn("args", F.create_map(F.lit("address"), F.col("address")))
    return log.select("seq", F.to_json(F.struct("trial_id", "seq", "tool", "args", "success", "result_preview", "ts", "url")).alias("value"))


def _log_files(spark, sf):
    """The lines of the log in the shared folder, with blank and broken lines among them."""
    text = F.col("value")
    lines = F.when(F.col("seq") % 50 == 7, F.array(text, F.lit(""), F.lit('{"trial_id": 1, "seq"'))).otherwise(F.array(text))
    path = scratch_path(spark, "log")
    _log_lines(spark, sf).select(F.explode(lines).alias("value")).write.text(path)
    return path


@query("stored_log", "SELECT trial_id, seq, tool, success, result_preview, url FROM tool_log_v")
def stored_log(spark, sf):
    return readers.read_tool_log(spark, _log_files(spark, sf)).select("trial_id", "seq", "tool", "success", "result_preview", "url")


@query("page_keys", "SELECT substr(sha256(url), 1, 16) AS key, url FROM pages")
def page_keys(spark, sf):
    return writers.page_keys(views.load(spark, sf, "pages"))


@query("task_verdicts", """SELECT CAST(trail_id AS VARCHAR) AS task_id, level, CASE WHEN trail_id % 13 = 0 THEN 'no riddle' WHEN passcode > 9 THEN 'invalid passcode' WHEN trail_id % 10 = 3 THEN 'already exists' END AS reason FROM trails_v""")
def task_verdicts(spark, sf):
    return writers.task_verdicts(*_tasks(spark, sf))


def _tasks(spark, sf):
    t = views.trails(spark, sf).withColumn("task_id", F.col("trail_id").cast("string")).withColumn("riddle", F.when(F.col("trail_id") % 13 != 0, F.concat(F.lit("Find "), "seed_title")))
    return t, t.where("trail_id % 10 = 3").select("task_id")


@query("task_files", """SELECT CAST(trail_id AS VARCHAR) AS task_id, x.p AS rel_path, x.c AS content FROM trails_v, LATERAL (VALUES ('instruction.md', concat('Go to ', seed_url, ': Find ', seed_title)), ('tests/expected_answer.txt', CAST(passcode AS VARCHAR)), ('task.toml', concat(level, ' 600.0'))) x(p, c)
WHERE trail_id % 13 <> 0 AND passcode <= 9 AND trail_id % 10 <> 3""")
def task_files(spark, sf):
    rows = [("instruction.md", "Go to {seed_url}: {riddle}"), ("tests/expected_answer.txt", "{passcode}"), ("task.toml", "{difficulty} {agent_timeout}")]
    t, existing = _tasks(spark, sf)
    return writers.task_files(t, spark.createDataFrame(rows, "rel_path string, content string"), existing)


@query("next_samples", """SELECT level, CAST(max(trail_id) FILTER (true) * 0 + CAST(regexp_extract(max(concat('sample_', lpad(CAST(trail_id AS VARCHAR), 9, '0'), '.json')), '_(\\d+)\\.json$', 1) AS BIGINT) + 1 AS INTEGER) AS next_number FROM trails_v GROUP BY 1""")
def next_samples(spark, sf):
    t = views.trails(spark, sf)
    return writers.next_sample_number(t.select("level", F.concat(F.lit("sample_"), F.lpad(F.col("trail_id").cast("string"), 9, "0"), F.lit(".json")).alias("name")))


# --- stream --------------------------------------------------------------------------------

_WINDOWS = "SELECT trial_id, CAST(epoch(time_bucket(INTERVAL 1 minute, ts)) AS BIGINT) AS window_start, count(*) AS calls, count(*) FILTER (NOT success) AS errors FROM tool_log_v GROUP BY 1, 2"


def _utc(log):
    return log.withColumn("ts", F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp"))))


@query("log_windows", _WINDOWS)
def log_windows(spark, sf):
    w = tool_log.call_windows(_utc(views.tool_log(spark, sf)))
    return w.withColumn("window_start", F.unix_seconds("window_start"))


_SESSIONS = """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY trial_id ORDER BY ts) < INTERVAL 600 seconds THEN 0 ELSE 1 END AS new FROM tool_log_v),
s AS (SELECT *, sum(new) OVER (PARTITION BY trial_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT trial_id, epoch_us(min(ts)) AS session_start, epoch_us(max(ts)) + 600000000 AS session_end, count(*) AS calls, count(*) FILTER (NOT success) AS errors FROM s GROUP BY trial_id, sid"""


@query("log_sessions", _SESSIONS)
def log_sessions(spark, sf):
    s = tool_log.call_sessions(_utc(views.tool_log(spark, sf)))
    return s.withColumn("session_start", F.unix_micros("session_start")).withColumn("session_end", F.unix_micros("session_end"))


def _stream_once(spark, sf, job, mode="append"):
    """Run a job over the stored log as a stream until nothing is left; a far-future row closes all windows."""
    path = _log_files(spark, sf)
    flush = '{"trial_id": -1, "seq": -1, "tool": "none", "success": true, "ts": 4102444800.0}'
    target = scratch_path(spark, "out")
    checkpoint = scratch_path(spark, "state")
    # the flush rows come as later files, in two rounds, so that the watermark passes the data
    tool_log.run_once(job(tool_log.read_log_stream(spark, path)), target, checkpoint, mode)
    for _ in range(2):
        spark.range(1).select(F.lit(flush).alias("value")).write.mode("append").text(path)
        tool_log.run_once(job(tool_log.read_log_stream(spark, path)), target, checkpoint, mode)
    return spark.read.parquet(target).where("trial_id >= 0")


@query("log_windows_stream", _WINDOWS)
def log_windows_stream(spark, sf):
    return _stream_once(spark, sf, tool_log.call_windows).withColumn("window_start", F.unix_seconds("window_start"))


@query("log_sessions_stream", _SESSIONS)
def log_sessions_stream(spark, sf):
    s = _stream_once(spark, sf, tool_log.call_sessions)
    return s.withColumn("session_start", F.unix_micros("session_start")).withColumn("session_end", F.unix_micros("session_end"))


_NORM = "regexp_extract(replace(rtrim({0}, '/'), '://en.m.wikipedia', '://en.wikipedia'), '^([^?#]*)', 1)"


@query("visits_stream", f"""SELECT DISTINCT l.trial_id, {_NORM.format('l.url')} AS page FROM tool_log_v l WHERE url IS NOT NULL AND EXISTS (SELECT 1 FROM stops_v s WHERE s.trail_id = l.trial_id AND s.stop_type = 'page' AND s.page_url = {_NORM.format('l.url')})""")
def visits_stream(spark, sf):
    stops = views.stops(spark, sf)
    return _stream_once(spark, sf, lambda log: tool_log.running_visits(log, stops)).select("trial_id", "page")


_ROUNDS = 3


def _arriving(spark, sf, first, rounds=_ROUNDS):
    """The log in rounds: the rows of a round are written as files below one folder, then ``first`` processes them."""
    path = scratch_path(spark, "arriving")
    for r in range(rounds):
        part = _log_lines(spark, sf).where(F.col("seq") % rounds == r)
        part.select("value").write.mode("append").text(path)
        first(tool_log.read_log_stream(spark, path))


@query("running_visit_rate", f"""WITH r AS (SELECT unnest(range({_ROUNDS})) AS batch),
g AS (SELECT DISTINCT trail_id AS trial_id, {_NORM.format('page_url')} AS page FROM stops_v WHERE stop_type = 'page' AND page_url <> ''),
f AS (SELECT trial_id, {_NORM.format('url')} AS page, min(seq % {_ROUNDS}) AS batch FROM tool_log_v WHERE url <> '' GROUP BY 1, 2),
h AS (SELECT g.trial_id, r.batch, count(*) AS pages, count(f.page) AS hits FROM g CROSS JOIN r LEFT JOIN f ON f.trial_id = g.trial_id AND f.page = g.page AND f.batch <= r.batch GROUP BY 1, 2)
SELECT batch, trial_id, pages, hits, CAST(printf('%.3f', hits / pages) AS DOUBLE) AS pages_visited FROM h""")
def running_visit_rate(spark, sf):
    """Visit rate of every trial after each of three rounds of the log, whose rows come in no order of time."""
    target, state = scratch_path(spark, "visits"), scratch_path(spark, "state")
    bits = cut_lineage(tool_log.golden_bits(views.stops(spark, sf)))
    _arriving(spark, sf, lambda log: tool_log.keep_visits(log, bits, target, state))
    words = spark.read.schema("trial_id bigint, word int, visited bigint, batch bigint").parquet(target)
    after = [tool_log.visit_rates(words.where(F.col("batch") <= b), bits).select(F.lit(b).cast("bigint").alias("batch"), "*") for b in range(_ROUNDS)]
    return reduce(DataFrame.unionByName, after)


@query("late_log_rows", """WITH m AS (SELECT max(ts) - INTERVAL 10 minutes AS mark FROM tool_log_v WHERE seq % 5 <> 0)
SELECT trial_id, seq, epoch_us(ts) AS ts, tool, CAST(1 AS BIGINT) AS batch FROM tool_log_v, m WHERE seq % 5 = 0 AND ts < mark""")
def late_log_rows(spark, sf):
    """A fifth of the log arrives after the rest: the rows of it that are behind the mark."""
    path, target, state = (scratch_path(spark, n) for n in ("late-log", "late-rows", "late-state"))
    for late in (False, True):
        _log_lines(spark, sf).where((F.col("seq") % 5 == 0) == late).select("value").write.mode("append").text(path)
        tool_log.split_late(tool_log.read_log_stream(spark, path), target, state)
    rows = tool_log.read_split(spark, target, tool_log.read_log_stream(spark, path).schema)
    return rows.where("late").select("trial_id", "seq", F.unix_micros("ts").alias("ts"), "tool", "batch")


