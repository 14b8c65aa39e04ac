"""Queries over trail building and augmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark import fixed
from waymark.operators import augment, build, facts, pages
from waymark.plans import views
from waymark.plans.number_queries import TRANSFORM_SQL
from waymark.plans.page_queries import info_of, sql_list
from waymark.plans.registry import query
from waymark.session import cut_lineage, written

P = "https://en.wikipedia.org/wiki/"


@query("stop_budget", """SELECT o_orderkey AS plan_id, greatest(1, k // 3) AS overplan, d - 1 + greatest(1, k // 3) AS content_stops,
  CASE WHEN d - 1 - k < 1 THEN d - 2 + greatest(1, k // 3) ELSE k + greatest(1, k // 3) END AS planned_tools, greatest(1, d - 1 - k) AS page_stops
FROM (SELECT o_orderkey, o_custkey % 18 + 3 AS d, o_orderkey % 8 AS k FROM orders)""")
def stop_budget(spark, sf):
    p = views.load(spark, sf, "orders").select(F.col("o_orderkey").alias("plan_id"), (F.col("o_custkey") % 18 + 3).alias("depth"), (F.col("o_orderkey") % 8).alias("tool_stops"))
    return build.stop_budget(p)


@query("plan_check", """WITH p AS (SELECT trail_id, stop_index, page_url, page_url NOT LIKE '%9' AS known, min(stop_index) OVER (PARTITION BY trail_id, page_url) AS first_at FROM stops_v WHERE page_url IS NOT NULL),
f AS (SELECT trail_id, stop_index, CASE WHEN NOT known THEN 'unknown_page' ELSE 'repeated_page' END AS fault FROM p WHERE NOT known OR stop_index > first_at)
SELECT trail_id AS plan_id, arg_min(fault, stop_index) AS fault, min(stop_index) AS pos FROM f GROUP BY 1""")
def plan_check(spark, sf):
    s = views.stops(spark, sf)
    known = s.where("page_url IS NOT NULL AND NOT endswith(page_url, '9')").select(F.col("page_url").alias("url"))
    return build.check_plans(s.select(F.col("trail_id").alias("plan_id"), F.col("stop_index").alias("pos"), F.col("page_url").alias("url")), known)


_DRAW = "CAST('0x' || substr(md5(concat('0|', {0}, '|{1}')), 1, 8) AS BIGINT)"
_ID = "trail_id, '|', stop_index"


@query("drawn_values", f"""WITH v AS (SELECT trail_id, stop_index, value_str AS val, row_number() OVER (PARTITION BY trail_id ORDER BY stop_index) - 1 AS o FROM stops_v WHERE stop_type = 'page' AND value_str IS NOT NULL),
n AS (SELECT trail_id, stop_index, (SELECT count(*) FROM v WHERE v.trail_id = s.trail_id AND v.stop_index < s.stop_index) AS n FROM stops_v s),
d AS (SELECT *, CASE WHEN n > 0 THEN {_DRAW.format(_ID, 'earlier')} % n END AS pick FROM n)
SELECT d.trail_id, d.stop_index, v.val AS earlier FROM d LEFT JOIN v ON v.trail_id = d.trail_id AND v.o = d.pick""")
def drawn_values(spark, sf):
    s = views.stops(spark, sf)
    v = s.where("stop_type = 'page' AND value_str IS NOT NULL").select("trail_id", "stop_index", F.col("value_str").alias("value"))
    return build.draw_earlier(s.select("trail_id", "stop_index"), v, "earlier")


def _tool_inputs(spark, sf):
    p = F.col("l_partkey")
    s = views.stops(spark, sf).where("stop_type = 'tool'")
    kinds = [*fixed.FALLBACK_TEMPLATES, *fixed.MARKET_TEMPLATES]
    tools = s.select(
        "trail_id", "stop_index", F.get(F.array(*[F.lit(k) for k in kinds]), (p % 17).cast("int")).alias("tool_type"),
        F.when(p % 3 != 0, F.concat(F.lit("Lake "), (p % 9).cast("string"))).alias("location"), F.when(p % 4 != 0, F.concat(F.lit("Lake "), (p % 5).cast("string"))).alias("other_location"),
        F.when(p % 5 == 1, F.lit("France")).alias("country"), F.when(p % 7 == 0, F.lit("ABC")).alias("ticker"), F.when(p % 11 == 0, F.lit("BTCUSDT")).alias("coin"),
        F.when(p % 6 == 0, F.lit("12.0")).alias("number"),
    )
    names = F.explode(F.array(*[F.lit(r[0]) for r in fixed.TOOL_DATES])).alias("template")
    days = s.where(p % 2 == 0).select("trail_id", "stop_index", F.col("ship_day").alias("day"), names)
    return tools, days


_KINDS_SQL = sql_list([*fixed.FALLBACK_TEMPLATES, *fixed.MARKET_TEMPLATES])
_EXPAND = f"""x AS (SELECT trail_id, stop_index, l_partkey AS p, l_partkey % 3 <> 0 AS loc, l_partkey % 3 <> 0 AND l_partkey % 4 <> 0 AND l_partkey % 9 <> l_partkey % 5 AS two, l_partkey % 5 = 1 AS ctry,
  l_partkey % 7 = 0 AS tick, l_partkey % 11 = 0 AS coin, l_partkey % 6 = 0 AS num, l_partkey % 2 = 0 AS dated, {_KINDS_SQL}[l_partkey % 17 + 1] AS tool_type FROM stops_v WHERE stop_type = 'tool'),
e AS (SELECT trail_id, stop_index, p, t.template, t.rk, tool_type, n_steps FROM x, LATERAL (VALUES ('geocode_elevation', 0, loc, 2), ('nearby_poi_count', 1, loc, 1), ('place_rating', 2, loc, 1), ('country_population', 3, ctry, 1), ('country_area', 4, ctry, 1),
  ('geocode_weather_historical', 5, loc AND dated, 2), ('historical_snowfall', 6, loc AND dated, 2), ('historical_sunshine', 7, loc AND dated, 2), ('geocode_distance', 8, two, 3), ('geocode_directions_duration', 9, two, 1),
  ('geocode_weather_precipitation', 10, loc AND dated, 2), ('math_conversion', 11, num, 1), ('date_computation', 12, dated, 1), ('stock_price', NULL, tick AND dated, 1), ('stock_volume', NULL, tick AND dated, 1),
  ('crypto_price', NULL, coin AND dated, 1), ('crypto_volume', NULL, coin AND dated, 1)) t(template, rk, ok, n_steps) WHERE ok),
r AS (SELECT *, CASE WHEN template = tool_type THEN -1 ELSE rk END AS priority FROM e)"""


@query("tool_templates", f"WITH {_EXPAND} SELECT trail_id, stop_index, template, CAST(priority AS INTEGER) AS priority, n_steps FROM r")
def tool_templates(spark, sf):
    e = build.expand_templates(*_tool_inputs(spark, sf))
    return e.select("trail_id", "stop_index", "template", "priority", F.size("chain").alias("n_steps"))


@query("template_choice", f"WITH {_EXPAND} SELECT trail_id, stop_index, arg_min(template, priority) AS template FROM r WHERE priority IS NOT NULL GROUP BY 1, 2")
def template_choice(spark, sf):
    return build.choose_templates(build.expand_templates(*_tool_inputs(spark, sf))).select("trail_id", "stop_index", "template")


@query("template_chains", f"""WITH {_EXPAND}, d AS (SELECT s.trail_id, s.stop_index, concat('Lake ', l_partkey % 9) AS a, concat('Lake ', l_partkey % 5) AS b, CAST(ship_day AS VARCHAR) AS d,
  CAST(CAST(ship_day - greatest(CAST(isodow(ship_day) AS INTEGER) - 5, 0) AS DATE) AS VARCHAR) AS td, {_DRAW.format(_ID, 'template')} AS n FROM stops_v s WHERE stop_type = 'tool')
SELECT r.trail_id, r.stop_index, r.template, CAST(x.step AS INTEGER) AS step, x.tool, x.args, x.key FROM r JOIN d ON d.trail_id = r.trail_id AND d.stop_index = r.stop_index, LATERAL (VALUES
  ('geocode_elevation', 0, 'maps_geocode', concat('address=', a), 'coords'), ('geocode_elevation', 1, 'maps_elevation', '__from_previous_as_locations=coords', 'elevation'),
  ('geocode_weather_historical', 0, 'maps_geocode', concat('address=', a), 'coords'), ('geocode_weather_historical', 1, 'weather_historical', concat('__from_previous=coords&date=', d), 'temperature'),
  ('geocode_weather_precipitation', 0, 'maps_geocode', concat('address=', a), 'coords'), ('geocode_weather_precipitation', 1, 'weather_historical', concat('__from_previous=coords&end_date=', d, '&select=["daily.precipitation_sum[0]"]&start_date=', d), 'precipitation'),
  ('historical_snowfall', 0, 'maps_geocode', concat('address=', a), 'coords'), ('historical_snowfall', 1, 'weather_historical', concat('__from_previous=coords&end_date=', d, '&select=["daily.snowfall_sum[0]"]&start_date=', d), 'snowfall'),
  ('historical_sunshine', 0, 'maps_geocode', concat('address=', a), 'coords'), ('historical_sunshine', 1, 'weather_historical', concat('__from_previous=coords&end_date=', d, '&select=["daily.sunshine_duration[0]"]&start_date=', d), 'sunshine'),
  ('geocode_distance', 0, 'maps_geocode', concat('address=', a), 'coords_a'), ('geocode_distance', 1, 'maps_geocode', concat('address=', b), 'coords_b'), ('geocode_distance', 2, 'maps_distance_matrix', '__from_previous_as_origins_destinations=["coords_a","coords_b"]', 'distance_km'),
  ('geocode_directions_duration', 0, 'maps_directions', concat('destination=', b, '&mode=driving&origin=', a), 'duration'), ('date_computation', 0, 'python_execute_code', concat('code=days_between(', d, ', 2024-01-01)'), 'days'),
  ('math_conversion', 0, 'python_execute_code', concat('code=int(12.0 * ', ['3.28084', '0.621371', '1.09361', '1.8'][n % 4 + 1], ')'), 'converted'), ('nearby_poi_count', 0, 'maps_search_places', concat('query=', {sql_list(fixed.POI_TYPES)}[n % 10 + 1], ' near ', a), 'poi_count'),
  ('place_rating', 0, 'maps_search_places', concat('query=', a), 'place_rating'), ('country_population', 0, 'countries_population', 'country=France', 'population'), ('country_area', 0, 'countries_area', 'country=France', 'area_km2'),
  ('stock_price', 0, 'stock_historical_price', concat('date=', td, '&ticker=ABC'), 'stock_price'), ('stock_volume', 0, 'stock_volume', concat('date=', td, '&ticker=ABC'), 'stock_volume'),
  ('crypto_price', 0, 'crypto_historical_price', concat('date=', d, '&symbol=BTCUSDT'), 'crypto_price'), ('crypto_volume', 0, 'crypto_volume', concat('date=', d, '&symbol=BTCUSDT'), 'crypto_volume')) x(template, step, tool, args, key) WHERE x.template = r.template""")
def template_chains(spark, sf):
    """Steps and arguments of every template that a stop can use."""
    e = build.expand_templates(*_tool_inputs(spark, sf)).select("trail_id", "stop_index", "template", F.inline("chain"))
    args = F.array_join(F.array_sort(F.transform(F.map_entries("args"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), "&")
    return e.select("trail_id", "stop_index", "template", "step", F.col("tool_name").alias("tool"), args.alias("args"), F.col("output_key").alias("key"))


@query("plan_stops")
def plan_stops(spark, sf):
    """Plans over the article pages: page and tool stops with chosen facts and templates."""
    s = views.stops(spark, sf).where("stop_type IN ('page', 'tool')")
    kinds = F.array(*[F.lit(k) for k in [*fixed.FALLBACK_TEMPLATES, *fixed.MARKET_TEMPLATES]])
    planned = s.select("trail_id", "stop_index", F.col("stop_type").alias("type"), F.get(kinds, (F.col("l_partkey") % 17).cast("int")).alias("tool_type"), F.col("page_url").alias("url"))
    planned = cut_lineage(planned)
    info = cut_lineage(info_of(spark, sf, planned.select("url")))
    at = planned.where("type = 'page'").select("trail_id", F.struct("trail_id", "stop_index").alias("hint_id"), "url", F.lit("the founding year").alias("hint"))
    chosen = facts.choose_facts(at, facts.infobox_facts(info)).select("trail_id", F.col("hint_id.stop_index").alias("stop_index"), "description", "section", "value", "value_type")
    chosen = cut_lineage(chosen)
    tools = planned.where("type = 'tool'").select("trail_id", "stop_index", "url")
    year = F.when(F.rlike("value", F.lit(r"^\d{4}$")), F.concat("value", F.lit("-01-01")).try_cast("date"))
    founded = chosen.select("trail_id", "stop_index", year.alias("day")).where("day IS NOT NULL")
    dates = cut_lineage(facts.tool_dates(tools, info.select("url", "infobox", "first_paragraph"), founded))
    out = build.stops_from_plan(planned, chosen, info, dates)
    return out.select("trail_id", "stop_index", "old_index", "stop_type", "value_str", "template", F.size("chain").alias("n_steps"))


# --- index work ----------------------------------------------------------------------------


@query("insert_and_reindex", """WITH i AS (SELECT trail_id, stop_index AS after FROM stops_v WHERE stop_type = 'page' AND stop_index % 3 = 0 AND stop_index < 12),
s AS (SELECT trail_id, stop_index AS k, 0 AS q, stop_type FROM stops_v UNION ALL SELECT trail_id, after, 1, 'reason' FROM i)
SELECT trail_id, row_number() OVER (PARTITION BY trail_id ORDER BY k, q) - 1 AS stop_index, stop_type FROM s""")
def insert_and_reindex(spark, sf):
    s = views.stops(spark, sf)
    new = s.where("stop_type = 'page' AND stop_index % 3 = 0 AND stop_index < 12").select("trail_id", F.col("stop_index").alias("after"), F.lit(0).alias("seq"), F.lit("reason").alias("stop_type"))
    return build.insert_stops(s, new).select("trail_id", "stop_index", "stop_type")


@query("kept_references", """WITH i AS (SELECT trail_id, stop_index AS after FROM stops_v WHERE stop_type = 'page' AND stop_index % 3 = 0 AND stop_index < 12),
n AS (SELECT s.*, (SELECT count(*) FROM i WHERE i.trail_id = s.trail_id AND after < s.stop_index) AS sh FROM stops_v s)
SELECT a.trail_id, a.stop_index + a.sh AS stop_index, CASE WHEN b.stop_type <> 'reason' THEN b.stop_index + b.sh ELSE greatest(0, a.stop_index + a.sh - 1) END AS reason_source_stop
FROM n a LEFT JOIN n b ON b.trail_id = a.trail_id AND b.stop_index = a.reason_source_stop WHERE a.stop_type = 'reason'""")
def kept_references(spark, sf):
    s = views.stops(spark, sf)
    new = s.where("stop_type = 'page' AND stop_index % 3 = 0 AND stop_index < 12").select("trail_id", F.col("stop_index").alias("after"), F.lit(0).alias("seq"), F.lit("page").alias("stop_type"))
    return build.insert_stops(s, new).where("stop_type = 'reason'").select("trail_id", "stop_index", "reason_source_stop")


@query("failed_tools", """WITH k AS (SELECT trail_id, stop_index, stop_type, CASE WHEN stop_type = 'tool' THEN CASE WHEN l_suppkey % 19 = 0 THEN value_str ELSE CAST(l_suppkey AS VARCHAR) END ELSE value_str END AS value_str FROM stops_v
  WHERE NOT (stop_type = 'tool' AND l_suppkey % 19 <> 0 AND l_suppkey % 4 = 0))
SELECT trail_id, stop_index AS old_index, row_number() OVER (PARTITION BY trail_id ORDER BY stop_index) - 1 AS stop_index, stop_type, value_str FROM k""")
def failed_tools(spark, sf):
    s = views.stops(spark, sf)
    v = s.where("stop_type = 'tool' AND l_suppkey % 19 <> 0").select("trail_id", "stop_index", F.when(F.col("l_suppkey") % 4 != 0, F.col("l_suppkey").cast("string")).alias("value"))
    return build.drop_failed_tools(s, v).select("trail_id", "old_index", "stop_index", "stop_type", "value_str")


@query("trim_stops", """WITH z AS (SELECT trail_id, count(*) AS n, 3 + trail_id % 3 AS depth, 3 AS depth_min FROM stops_v GROUP BY 1),
s AS (SELECT s.trail_id, s.stop_index, s.stop_type, n, depth - 1 AS m, row_number() OVER (PARTITION BY s.trail_id ORDER BY (stop_type = 'tool') DESC, stop_index DESC) AS gone FROM stops_v s JOIN z ON z.trail_id = s.trail_id WHERE n + 1 >= depth_min)
SELECT trail_id, stop_index AS old_index, row_number() OVER (PARTITION BY trail_id ORDER BY stop_index) - 1 AS stop_index, stop_type FROM s WHERE gone > greatest(0, n - m)""")
def trim_stops(spark, sf):
    s = views.stops(spark, sf)
    d = s.select("trail_id").distinct().select("trail_id", (3 + F.col("trail_id") % 3).alias("depth"), F.lit(3).alias("depth_min"))
    return build.trim(s, d).select("trail_id", "old_index", "stop_index", "stop_type")


_REASONS = """z AS (SELECT trail_id, count(*) AS n FROM stops_v GROUP BY 1),
t AS (SELECT t.trail_id, greatest(r1, least(r2, n // 3)) AS target FROM trails_v t JOIN z ON z.trail_id = t.trail_id JOIN (VALUES ('easy', 1, 2), ('medium', 2, 3), ('hard', 3, 4), ('extreme', 4, 6)) c(level, r1, r2) ON c.level = t.level),
e AS (SELECT trail_id, stop_index FROM stops_v WHERE stop_type IN ('page', 'tool') AND ((value_type = 'number' AND abs(trunc(TRY_CAST(value_str AS DOUBLE))) >= 1) OR (value_type = 'text' AND length(trim(value_str)) >= 2))),
k AS (SELECT e.*, row_number() OVER (PARTITION BY trail_id ORDER BY md5(concat('0|', trail_id, '|', stop_index, '|reason')), stop_index) AS rk FROM e)"""


# sources in drawn order, up to the target; each takes its first drawn transform with a result other than 0 and 1
_DRAWN = f"""{TRANSFORM_SQL}, {_REASONS},
drawn_q AS (SELECT k.trail_id, k.stop_index, x.transform, x.result FROM k JOIN t ON t.trail_id = k.trail_id JOIN transforms_q x ON x.trail_id = k.trail_id AND x.stop_index = k.stop_index WHERE rk <= target AND x.result NOT IN (0, 1)
  QUALIFY row_number() OVER (PARTITION BY k.trail_id, k.stop_index ORDER BY md5(concat('0|', k.trail_id, '|', k.stop_index, '|', x.transform, '|transform')), x.transform) = 1),
shift_q AS (SELECT *, row_number() OVER (PARTITION BY trail_id ORDER BY stop_index) - 1 AS before FROM drawn_q)"""


@query("reason_sources", f"WITH {_DRAWN} SELECT trail_id, stop_index FROM drawn_q")
def reason_sources(spark, sf):
    """Drawn sources of reason stops."""
    s = views.stops(spark, sf)
    drawn = build.draw_reasons(s, build.reason_targets(s, views.trails(spark, sf)))
    return drawn.select("trail_id", F.col("after").alias("stop_index"))


@query("reason_stops", f"""WITH {_DRAWN} SELECT trail_id, stop_index + before + 1 AS stop_index, stop_index + before AS reason_source_stop, transform AS reason_transform, CAST(result AS VARCHAR) AS value_str FROM shift_q""")
def reason_stops(spark, sf):
    s = views.stops(spark, sf)
    out = build.insert_reasons(s, views.trails(spark, sf))
    return out.where("reason_transform IS NOT NULL").select("trail_id", "stop_index", "reason_source_stop", "reason_transform", "value_str")


@query("bridges", """WITH n AS (SELECT s.*, lead(page_url) OVER w AS next_url, lead(stop_index) OVER w IS NOT NULL AS has_next FROM stops_v s WINDOW w AS (PARTITION BY trail_id ORDER BY stop_index)),
b AS (SELECT n.*, has_next AND stop_type NOT IN ('tool', 'reason') AS is_open, l.src IS NOT NULL AS linked FROM n LEFT JOIN links_v l ON l.src = n.page_url AND l.dst = n.next_url)
SELECT trail_id, stop_index, CASE WHEN is_open THEN CASE WHEN next_url IS NOT NULL AND NOT linked THEN 'search_query' ELSE 'link_follow' END ELSE bridge_type END AS bridge_type,
  CASE WHEN is_open THEN CASE WHEN linked THEN next_url END ELSE target_url END AS target_url,
  CASE WHEN is_open THEN CASE WHEN next_url IS NOT NULL AND NOT linked THEN concat(replace(replace(next_url, 'https://en.wikipedia.org/wiki/', ''), '_', ' '), ' wikipedia') END ELSE search_query END AS search_query FROM b""")
def bridges(spark, sf):
    s = views.stops(spark, sf)
    links = views.links(s).select(F.col("src").alias("url"), F.col("dst").alias("target_url"))
    known = s.where("page_url IS NOT NULL").select(F.col("page_url").alias("url")).distinct().withColumn("title", F.replace(F.replace("url", F.lit(P), F.lit("")), F.lit("_"), F.lit(" ")))
    return build.build_bridges(s, links, known).select("trail_id", "stop_index", "bridge_type", "target_url", "search_query")


COMPUTE_SQL = f"""cv AS (SELECT trail_id, stop_index, CAST(trunc(TRY_CAST(replace(value_str, ',', '') AS DOUBLE)) AS BIGINT) AS v FROM stops_v WHERE stop_type IN ('page', 'tool', 'reason') AND TRY_CAST(replace(value_str, ',', '') AS DOUBLE) IS NOT NULL),
cn AS (SELECT trail_id, count(*) AS n FROM stops_v WHERE stop_type IN ('page', 'tool', 'reason') GROUP BY 1),
ck AS (SELECT *, row_number() OVER (PARTITION BY trail_id ORDER BY md5(concat('0|', trail_id, '|', stop_index, '|compute')), stop_index) AS rk FROM cv),
cp AS (SELECT trail_id, list(v ORDER BY stop_index) AS vs, list(stop_index ORDER BY stop_index) AS refs FROM ck WHERE rk <= 2 + {_DRAW.format('trail_id', 'compute_n')} % 3 GROUP BY 1),
cd AS (SELECT trail_id, vs, refs, {_DRAW.format('trail_id', 'compute_kind')} % 3 AS kind FROM cp WHERE len(vs) >= 2),
compute_q AS (SELECT cd.trail_id, n AS stop_index, refs, CASE kind WHEN 0 THEN concat('digital_root(', array_to_string(vs, ' + '), ')') WHEN 1 THEN concat('(', array_to_string(vs, ' + '), ') % 10') ELSE concat('abs(', vs[1], ' - ', vs[2], ') % 10') END AS expression,
  CAST(CASE kind WHEN 0 THEN CASE WHEN list_sum(vs) = 0 THEN 0 ELSE (abs(list_sum(vs)) - 1) % 9 + 1 END WHEN 1 THEN (list_sum(vs) % 10 + 10) % 10 ELSE abs(vs[1] - vs[2]) % 10 END AS BIGINT) AS digit FROM cd JOIN cn USING (trail_id))"""


@query("compute_digit", f"WITH {COMPUTE_SQL} SELECT trail_id, stop_index, expression, CAST(digit AS VARCHAR) AS value_str, array_to_string(refs, ',') AS refs FROM compute_q")
def compute_digit(spark, sf):
    c = build.compute_stops(views.stops(spark, sf))
    return c.select("trail_id", "stop_index", "expression", "value_str", F.array_join(F.transform("referenced_stops", lambda x: x.cast("string")), ",").alias("refs"))


@query("trail_roll_up", """WITH l AS (SELECT trail_id, arg_max(stop_type, stop_index) AS t, max(stop_index) AS i FROM stops_v GROUP BY 1),
s AS (SELECT *, CASE l_suppkey % 9 WHEN 0 THEN 'Cross_section 2' WHEN 1 THEN 'History' WHEN 2 THEN NULL ELSE 'infobox' END AS sec FROM stops_v)
SELECT s.trail_id, count(*) AS depth, count(*) FILTER (stop_type = 'tool') AS tool_stop_count, count(*) FILTER (stop_type = 'reason') AS reason_stop_count,
  CASE WHEN bool_or(stop_type = 'page' AND coalesce(sec LIKE 'Cross%', false)) THEN 'cross_section' WHEN bool_or(stop_type = 'page' AND coalesce(sec = 'History', false)) THEN 'prose' ELSE 'infobox' END AS extraction_difficulty,
  CASE WHEN bool_or(bridge_type = 'search_query') THEN 'search' ELSE 'direct_link' END AS bridge_obscurity,
  CASE WHEN any_value(l.t) = 'compute' THEN max(extracted_value) FILTER (stop_index = l.i) % 10 ELSE -1 END AS passcode FROM s JOIN l ON l.trail_id = s.trail_id GROUP BY 1""")
def trail_roll_up(spark, sf):
    k = F.col("l_suppkey") % 9
    s = views.stops(spark, sf).withColumn("extraction_section", F.when(k == 0, "Cross_section 2").when(k == 1, "History").when(k == 2, None).otherwise("infobox"))
    return build.roll_up(s)


# --- augmentation --------------------------------------------------------------------------

_NEED = """need_q AS (SELECT t.trail_id, t.level, greatest(0, coalesce(t1, 0) - coalesce(tools, 0)) AS tool_needed, greatest(0, coalesce(r1, 0) - coalesce(reasons, 0)) AS reason_needed FROM trails_v t
  LEFT JOIN (SELECT trail_id, count(*) FILTER (stop_type = 'tool') AS tools, count(*) FILTER (stop_type = 'reason') AS reasons FROM stops_v GROUP BY 1) s ON s.trail_id = t.trail_id
  LEFT JOIN (VALUES ('easy', 1, 1), ('medium', 2, 2), ('hard', 4, 3), ('extreme', 5, 4)) c(level, t1, r1) ON c.level = t.level)"""


@query("needed_stops", f"WITH {_NEED} SELECT trail_id, level, CAST(tool_needed AS INTEGER) AS tool_needed, CAST(reason_needed AS INTEGER) AS reason_needed FROM need_q")
def needed_stops(spark, sf):
    return augment.needed_stops(views.trails(spark, sf), views.stops(spark, sf))


@query("needed_totals", f"WITH {_NEED} SELECT level, CAST(sum(tool_needed) AS BIGINT) AS tool_stops, CAST(sum(reason_needed) AS BIGINT) AS reason_stops, count(*) FILTER (tool_needed > 0 OR reason_needed > 0) AS trails FROM need_q GROUP BY 1")
def needed_totals(spark, sf):
    return augment.needed_totals(augment.needed_stops(views.trails(spark, sf), views.stops(spark, sf)))


def place_stops(spark, sf):
    """Stops whose pages are places: lakes (heights and ratings known) and countries."""
    p = F.col("l_partkey")
    name = F.when(p % 3 == 0, F.get(F.array(*[F.lit(c) for c in fixed.KNOWN_COUNTRIES[:40]]), (p % 40).cast("int"))).otherwise(F.concat(F.lit("Lake_"), (p % 40).cast("string")))
    url = F.when(F.col("stop_type").isin("page", "tool"), F.concat(F.lit(P), F.replace(name, F.lit(" "), F.lit("_"))))
    return views.stops(spark, sf).withColumn("page_url", url)


def place_replies(stops):
    """Replies for those places: ratings of lakes (0 for every fourth), population and area of countries."""
    title = F.replace(F.replace("page_url", F.lit(P), F.lit("")), F.lit("_"), F.lit(" "))
    names = cut_lineage(stops.where("page_url IS NOT NULL").select(title.alias("name")).distinct())
    lakes = names.where("name LIKE 'Lake %'").withColumn("n", F.split_part("name", F.lit(" "), F.lit(2)).cast("bigint"))

    def reply(df, tool, args, out):
        return df.select(F.lit(tool).alias("tool_name"), args.alias("args"), out.alias("output"), F.lit(None).cast("string").alias("error"))

    name = F.col("name")
    rating = F.concat(F.lit('{"places":[{"rating":'), (F.col("n") % 4).cast("string"), F.lit("}]}"))
    countries = names.where("name NOT LIKE 'Lake %'")
    size = F.length("name").cast("string")
    pop = F.concat(F.lit('{"population":'), size, F.lit("000}"))
    area = F.concat(F.lit('{"area_km2":'), size, F.lit(".5}"))
    return (
        reply(lakes, "maps_search_places", F.create_map(F.lit("query"), name), rating)
        .unionByName(reply(countries, "countries_population", F.create_map(F.lit("country"), name), pop))
        .unionByName(reply(countries, "countries_area", F.create_map(F.lit("country"), name), area))
    )


_PLACE = f"""ps AS (SELECT trail_id, stop_index, stop_type, value_type, value_str, l_partkey AS p, CASE WHEN l_partkey % 3 = 0 THEN {sql_list(fixed.KNOWN_COUNTRIES[:40])}[l_partkey % 40 + 1] END AS ctry FROM stops_v),
cand AS (SELECT trail_id, stop_index, 'place_rating' AS template, (p % 40) % 4 AS val FROM ps WHERE stop_type = 'page' AND ctry IS NULL AND (p % 40) % 4 <> 0 AND NOT (value_type = 'text' AND value_str = 'Old Harbour')
    AND NOT (value_type = 'text' AND value_str IS NOT NULL)
  UNION ALL SELECT trail_id, stop_index, 'country_population', length(ctry) * 1000 FROM ps WHERE stop_type = 'page' AND ctry IS NOT NULL UNION ALL SELECT trail_id, stop_index, 'country_area', length(ctry) + 0.5 FROM ps WHERE stop_type = 'page' AND ctry IS NOT NULL),
ok AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY trail_id, stop_index ORDER BY md5(concat('0|', {_ID}, '|', template, '|tool')), template) = 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY trail_id ORDER BY md5(concat('0|', {_ID}, '|source')), stop_index) AS rk FROM ok)"""


@query("candidate_tools", f"WITH {_NEED}, {_PLACE} SELECT rk.trail_id, stop_index AS after, template, val::DOUBLE AS value_num FROM rk JOIN need_q n ON n.trail_id = rk.trail_id WHERE rk <= tool_needed")
def candidate_tools(spark, sf):
    s = place_stops(spark, sf)
    need = augment.needed_stops(views.trails(spark, sf), s).select("trail_id", F.col("tool_needed").alias("target"))
    return augment.candidate_tools(s, place_replies(s), need).select("trail_id", "after", "template", "value_num")


@query("candidate_reasons", f"""WITH {TRANSFORM_SQL}, taken AS (SELECT DISTINCT trail_id, reason_source_stop AS stop_index FROM stops_v WHERE stop_type = 'reason'),
e AS (SELECT DISTINCT trail_id, stop_index FROM transforms_q WHERE stop_type IN ('page', 'tool') AND (trail_id, stop_index) NOT IN (SELECT trail_id, stop_index FROM taken)),
k AS (SELECT *, row_number() OVER (PARTITION BY trail_id ORDER BY md5(concat('0|', trail_id, '|', stop_index, '|reason')), stop_index) AS rk FROM e)
SELECT trail_id, stop_index AS after, transform, result::DOUBLE AS value_num FROM k JOIN transforms_q x USING (trail_id, stop_index) WHERE rk <= 1 + trail_id % 4 AND result NOT IN (0, 1)
QUALIFY row_number() OVER (PARTITION BY trail_id, stop_index ORDER BY md5(concat('0|', trail_id, '|', stop_index, '|', transform, '|transform')), transform) = 1""")
def candidate_reasons(spark, sf):
    """Reason stops that could be added, one to four per trail."""
    s = views.stops(spark, sf)
    targets = s.select("trail_id").distinct().withColumn("target", (1 + F.col("trail_id") % 4).cast("int"))
    return augment.candidate_reasons(s, targets).select("trail_id", "after", F.col("reason_transform").alias("transform"), "value_num")


# tools go in first, reasons are drawn over what is there then; a compute stop needs two whole values, and rows with a critical issue reject their trail
_AUGMENTED = f"""{_NEED}, {_PLACE},
tool_q AS (SELECT rk.trail_id, rk.stop_index, val::DOUBLE AS val FROM rk JOIN need_q n ON n.trail_id = rk.trail_id WHERE rk <= tool_needed),
base_q AS (SELECT trail_id, stop_index AS k, 0 AS q, stop_type, value_str, value_type, reason_source_stop AS old_src FROM stops_v WHERE stop_type <> 'compute' UNION ALL SELECT trail_id, stop_index, 1, 'tool', CAST(val AS VARCHAR), 'number', NULL FROM tool_q),
new_q AS (SELECT *, row_number() OVER (PARTITION BY trail_id ORDER BY k, q) - 1 AS stop_index FROM base_q),
s1_q AS (SELECT n.trail_id, n.stop_index, n.stop_type, n.value_str, n.value_type, CASE WHEN n.stop_type = 'reason' THEN CASE WHEN o.stop_type <> 'reason' THEN o.stop_index ELSE greatest(0, n.stop_index - 1) END END AS src
  FROM new_q n LEFT JOIN new_q o ON o.trail_id = n.trail_id AND o.k = n.old_src AND o.q = 0),
{TRANSFORM_SQL.replace('stops_v', 's1_q')},
free_q AS (SELECT DISTINCT trail_id, stop_index FROM transforms_q WHERE stop_type IN ('page', 'tool') AND (trail_id, stop_index) NOT IN (SELECT trail_id, src FROM s1_q WHERE stop_type = 'reason')),
order_q AS (SELECT *, row_number() OVER (PARTITION BY trail_id ORDER BY md5(concat('0|', {_ID}, '|reason')), stop_index) AS rk FROM free_q),
reason_q AS (SELECT DISTINCT o.trail_id, o.stop_index FROM order_q o JOIN need_q n ON n.trail_id = o.trail_id JOIN transforms_q x ON x.trail_id = o.trail_id AND x.stop_index = o.stop_index WHERE rk <= reason_needed AND result NOT IN (0, 1)),
added_q AS (SELECT trail_id, count(*) AS added, count(*) FILTER (is_reason) AS reasons FROM (SELECT trail_id, false AS is_reason FROM tool_q UNION ALL SELECT trail_id, true FROM reason_q) GROUP BY 1),
whole_q AS (SELECT trail_id, count(*) AS n FROM s1_q WHERE TRY_CAST(replace(value_str, ',', '') AS DOUBLE) IS NOT NULL GROUP BY 1),
end_q AS (SELECT trail_id, arg_max(stop_type, stop_index) AS t FROM stops_v GROUP BY 1),
bad_q AS (SELECT trail_id FROM stops_v WHERE stop_type <> 'compute' AND (value_kind = 'null' OR bridge_type = 'jump' OR (value_kind = 'string' AND contains(value_str, '[')))
  UNION SELECT trail_id FROM stops_v s WHERE stop_type = 'tool' AND NOT EXISTS (SELECT 1 FROM chain_v c WHERE c.trail_id = s.trail_id AND c.stop_index = s.stop_index)
  UNION SELECT s.trail_id FROM stops_v s JOIN chain_v c USING (trail_id, stop_index) WHERE c.step = 0 AND s.value_num = 0 AND c.tool_name IN ('stock_historical_price', 'countries_population', 'maps_geocode', 'maps_elevation')
  UNION SELECT trail_id FROM chain_v WHERE tool_name = 'maps_lookup' OR (tool_name = 'stock_historical_price' AND isodow(CAST(arg_date AS DATE)) >= 6) OR contains(arg_address, '['))"""


@query("augmented_trails", f"""WITH {_AUGMENTED} SELECT n.trail_id, CASE WHEN tool_needed = 0 AND reason_needed = 0 THEN 'unchanged' WHEN added IS NULL OR n.trail_id IN (SELECT trail_id FROM bad_q) OR t <> 'compute' OR coalesce(w.n, 0) + reasons < 2 THEN 'rejected' ELSE 'augmented' END AS status,
  coalesce(added, 0) AS added FROM need_q n LEFT JOIN added_q a ON a.trail_id = n.trail_id LEFT JOIN whole_q w ON w.trail_id = n.trail_id LEFT JOIN end_q e ON e.trail_id = n.trail_id""")
def augmented_trails(spark, sf):
    s = written(place_stops(spark, sf), "place-stops")
    return augment.augment(views.trails(spark, sf), s, views.chain(s), place_replies(s)).outcome


@query("diamond_sources", f"""WITH {_PLACE}, z AS (SELECT trail_id, count(*) AS n FROM stops_v GROUP BY 1) SELECT ps.trail_id, stop_index FROM ps JOIN z ON z.trail_id = ps.trail_id WHERE stop_type = 'page' AND stop_index < n - 2
  AND (ctry IS NOT NULL OR NOT (value_type = 'text' AND value_str IS NOT NULL) OR value_type = 'text')""")
def diamond_sources(spark, sf):
    return augment.diamond_sources(place_stops(spark, sf)).select("trail_id", "stop_index")


_DIAMOND = f"""{_PLACE}, z AS (SELECT trail_id, count(*) AS n FROM stops_v GROUP BY 1), br AS (SELECT ps.trail_id, stop_index, length(ctry) * 1000 AS a, length(ctry) + 0.5 AS b FROM ps JOIN z ON z.trail_id = ps.trail_id WHERE stop_type = 'page' AND ctry IS NOT NULL AND stop_index < n - 2),
dr AS (SELECT *, row_number() OVER (PARTITION BY trail_id ORDER BY md5(concat('0|', {_ID}, '|fork')), stop_index) AS rk, {_DRAW.format(_ID, 'merge')} % 2 = 0 AS is_add FROM br),
dq AS (SELECT dr.*, t.level FROM dr JOIN trails_v t ON t.trail_id = dr.trail_id JOIN (VALUES ('easy', 1, 1), ('medium', 1, 2), ('hard', 2, 3), ('extreme', 3, 5)) q(level, lo, hi) ON q.level = t.level WHERE rk <= lo + {_DRAW.format('dr.trail_id', 'diamonds')} % (hi - lo + 1))"""


@query("diamond_branches", f"WITH {_DIAMOND} SELECT trail_id, stop_index, 'country_pop_area' AS diamond, a::DOUBLE AS a, b::DOUBLE AS b FROM br")
def diamond_branches(spark, sf):
    s = place_stops(spark, sf)
    return augment.diamond_branches(s, place_replies(s)).select("trail_id", "stop_index", "diamond", "a", "b")


def _diamonds(spark, sf):
    s = cut_lineage(place_stops(spark, sf))
    return s, cut_lineage(augment.build_diamonds(views.trails(spark, sf), s, augment.diamond_branches(s, place_replies(s))))


@query("diamond_rows", f"""WITH {_DIAMOND} SELECT trail_id, stop_index AS after, CAST(x.seq AS INTEGER) AS seq, x.role, x.v::DOUBLE AS value_num FROM dq, LATERAL (VALUES (0, 'branch', a::DOUBLE), (1, 'branch', b::DOUBLE), (2, 'merge', CASE WHEN is_add THEN a + floor(b) ELSE abs(a - floor(b)) END::DOUBLE)) x(seq, role, v)""")
def diamond_rows(spark, sf):
    return _diamonds(spark, sf)[1].select("trail_id", "after", "seq", "role", "value_num")


@query("diamond_totals", f"WITH {_DIAMOND}, p AS (SELECT trail_id, count(*) AS d FROM dq GROUP BY 1) SELECT level, count(d) AS modified, count(*) FILTER (d IS NULL) AS failed, coalesce(CAST(sum(d) AS BIGINT), 0) AS diamonds FROM trails_v t LEFT JOIN p ON p.trail_id = t.trail_id GROUP BY 1")
def diamond_totals(spark, sf):
    return augment.diamond_totals(views.trails(spark, sf), _diamonds(spark, sf)[1])


@query("dag_edges", """WITH s AS (SELECT *, CASE WHEN stop_index % 6 IN (1, 2) THEN 'branch' WHEN stop_index % 6 = 3 THEN 'merge' END AS role FROM stops_v)
SELECT trail_id, stop_index, CASE WHEN stop_index % 6 = 2 THEN stop_index - 2 WHEN role IS NULL AND stop_type = 'reason' AND reason_source_stop IS NOT NULL THEN reason_source_stop ELSE stop_index - 1 END AS dep FROM s WHERE stop_index > 0 OR stop_type = 'reason'
UNION ALL SELECT trail_id, stop_index, stop_index - 2 FROM s WHERE role = 'merge'""")
def dag_edges(spark, sf):
    i = F.col("stop_index") % 6
    s = views.stops(spark, sf).withColumn("role", F.when(i.isin(1, 2), "branch").when(i == 3, "merge"))
    return augment.dependencies(s)


# the rows of each diamond follow their source; reason stops keep their source where it is no reason stop
_DIAMOND_TRAILS = f"""{_DIAMOND},
base_q AS (SELECT s.trail_id, s.stop_index AS k, -1 AS q, s.stop_type, s.value_str, NULL AS role, s.reason_source_stop AS old_src FROM stops_v s WHERE s.stop_type <> 'compute' AND s.trail_id IN (SELECT trail_id FROM dq)
  UNION ALL SELECT trail_id, stop_index, x.seq, 'tool', CASE WHEN x.v = floor(x.v) THEN CAST(CAST(x.v AS BIGINT) AS VARCHAR) ELSE CAST(x.v AS VARCHAR) END, x.role, NULL
  FROM dq, LATERAL (VALUES (0, 'branch', a::DOUBLE), (1, 'branch', b::DOUBLE), (2, 'merge', CASE WHEN is_add THEN a + floor(b) ELSE abs(a - floor(b)) END::DOUBLE)) x(seq, role, v)),
new_q AS (SELECT *, row_number() OVER (PARTITION BY trail_id ORDER BY k, q) - 1 AS stop_index FROM base_q),
put_q AS (SELECT n.trail_id, n.stop_index, n.stop_type, n.value_str, n.role, CASE WHEN n.stop_type = 'reason' AND n.old_src IS NOT NULL THEN CASE WHEN o.stop_type <> 'reason' THEN o.stop_index ELSE greatest(0, n.stop_index - 1) END END AS src
  FROM new_q n LEFT JOIN new_q o ON o.trail_id = n.trail_id AND o.k = n.old_src AND o.q = -1),
{COMPUTE_SQL.replace('stops_v', 'put_q')},
done_q AS (SELECT trail_id, stop_index, stop_type, role, src, NULL::BIGINT[] AS refs FROM put_q UNION ALL SELECT trail_id, stop_index, 'compute', NULL, NULL, refs FROM compute_q),
edge_q AS (SELECT d.trail_id, d.stop_index, CASE WHEN d.role = 'branch' THEN [CASE WHEN p.role = 'branch' THEN d.stop_index - 2 ELSE d.stop_index - 1 END] WHEN d.role = 'merge' THEN [d.stop_index - 2, d.stop_index - 1]
  WHEN d.stop_type = 'reason' AND d.src IS NOT NULL THEN [d.src] WHEN d.stop_type = 'compute' AND len(d.refs) > 0 THEN d.refs WHEN d.stop_index = 0 THEN [] ELSE [d.stop_index - 1] END AS deps
  FROM done_q d LEFT JOIN done_q p ON p.trail_id = d.trail_id AND p.stop_index = d.stop_index - 1)"""


@query("diamond_trails", f"WITH {_DIAMOND_TRAILS} SELECT trail_id, stop_index, unnest(deps) AS dep FROM edge_q")
def diamond_trails(spark, sf):
    """Trails with their diamonds put in, a rebuilt compute stop and all dependency edges."""
    s, d = _diamonds(spark, sf)
    put = augment.insert_diamonds(s, d).join(d.select("trail_id").distinct(), "trail_id", "left_semi")
    last = build.compute_stops(put)
    return augment.dependencies(put.unionByName(last, allowMissingColumns=True))
