"""Queries over tool replies and replays."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions.skew import spread
from waymark.operators import replay, replies
from waymark.plans import views
from waymark.plans.registry import query
from waymark.session import scratch_path, written


def _json(*fields) -> object:
    """JSON text of named columns."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields]))


def _point(lat, lng):
    return F.struct(lat.alias("lat"), lng.alias("lng"))


def _status(k):
    return F.when(k % 9 == 0, "ZERO_RESULTS").otherwise("OK")


def _customers(spark, sf):
    """Customers dealt over tasks by rows: their table has few bytes, and reply documents cost much."""
    return spread(views.load(spark, sf, "customer"), "c_custkey")


def _replies(spark, sf, results, name="results"):
    """Reply documents built from customers: an OK status on most rows and one named part."""
    return _customers(spark, sf).select(_k().alias("reply_id"), _json(("status", _status(_k())), (name, results)).alias("output"))


def _k():
    return F.col("c_custkey")


def _bal():
    return F.col("c_acctbal")


def _one():
    return F.struct(F.col("c_name").alias("formatted_address"), F.concat(F.lit("id"), _k().cast("string")).alias("place_id"), F.struct(_point(_bal() / 100, _bal() / 50).alias("location")).alias("geometry"), F.array(F.struct(F.col("c_mktsegment").alias("long_name"))).alias("address_components"))


@query("geocodes", "SELECT c_custkey AS reply_id, c_acctbal / 100 AS lat, c_acctbal / 50 AS lng, c_name AS formatted_address, concat('id', c_custkey) AS place_id FROM customer WHERE c_custkey % 9 <> 0 AND c_custkey % 5 <> 0")
def geocodes(spark, sf):
    results = F.when(_k() % 5 == 0, F.slice(F.array(_one()), 1, 0)).otherwise(F.array(_one(), _one()))
    return replies.geocodes(_replies(spark, sf, results))


@query("reverse_geocodes", """SELECT c_custkey AS reply_id, c_name AS formatted_address, concat('id', c_custkey) AS place_id, concat('[{"long_name":"', c_mktsegment, '"}]') AS address_components FROM customer WHERE c_custkey % 9 <> 0""")
def reverse_geocodes(spark, sf):
    return replies.reverse_geocodes(_replies(spark, sf, F.array(_one())))


def _place(i):
    return F.struct(
        F.col("c_name").alias("name"), F.lit("x").alias("formatted_address"), F.struct(_point(_bal() + i, _bal() - i).alias("location")).alias("geometry"), F.lit(f"p{i}").alias("place_id"),
        F.when(_k() % 4 != 0, (_k() % 50 + i) / 10).alias("rating"), (_k() + i).alias("user_ratings_total"), F.array(F.lit("a"), F.lit("b")).alias("types"),
    )


@query("places", """SELECT c_custkey AS reply_id, CAST(i AS INTEGER) AS pos, c_name AS name, 'x' AS formatted_address, c_acctbal + i AS lat, c_acctbal - i AS lng, concat('p', i) AS place_id, CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 50 + i) / 10 END AS rating,
  c_custkey + i AS user_ratings_total, 'a,b' AS types FROM customer, range(3) t(i) WHERE c_custkey % 9 <> 0""")
def places(spark, sf):
    p = replies.places(_replies(spark, sf, F.array(*[_place(i) for i in range(3)])))
    return p.withColumn("types", F.array_join("types", ",")).withColumn("lat", F.col("lat"))


@query("place_details", """SELECT c_custkey AS reply_id, c_name AS name, 'x' AS formatted_address, '12' AS formatted_phone_number, NULL::VARCHAR AS website, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 50 / 10 END AS rating, c_custkey AS user_ratings_total,
  c_acctbal AS lat, c_acctbal AS lng, '["good"]' AS reviews, NULL::VARCHAR AS opening_hours FROM customer WHERE c_custkey % 9 <> 0""")
def place_details(spark, sf):
    extra = _place(0).withField("formatted_phone_number", F.lit("12")).withField("reviews", F.array(F.lit("good")))
    return replies.place_details(_replies(spark, sf, extra, "result"))


@query("distances", """SELECT c_custkey AS reply_id, CAST(i AS INTEGER) AS origin_pos, CAST(j AS INTEGER) AS destination_pos, concat('o', i) AS origin, concat('d', j) AS destination, CASE WHEN i = j THEN 'ZERO_RESULTS' ELSE 'OK' END AS status,
  CASE WHEN i <> j THEN (c_custkey * 1000 + i + j)::DOUBLE END AS distance_m, CASE WHEN i <> j THEN (c_custkey * 60 + i)::DOUBLE END AS duration_s FROM customer, range(2) a(i), range(3) b(j) WHERE c_custkey % 9 <> 0""")
def distances(spark, sf):
    def cell(i, j):
        ok = F.lit(i != j)
        return F.struct(
            F.when(ok, "OK").otherwise("ZERO_RESULTS").alias("status"), F.when(ok, F.struct((_k() * 1000 + i + j).alias("value"))).alias("distance"), F.when(ok, F.struct((_k() * 60 + i).alias("value"))).alias("duration")
        )

    rows = F.array(*[F.struct(F.array(*[cell(i, j) for j in range(3)]).alias("elements")) for i in range(2)])
    doc = _json(("status", _status(_k())), ("rows", rows), ("origin_addresses", F.array(F.lit("o0"), F.lit("o1"))), ("destination_addresses", F.array(F.lit("d0"), F.lit("d1"), F.lit("d2"))))
    return replies.distances(_customers(spark, sf).select(_k().alias("reply_id"), doc.alias("output")))


@query("elevations", "SELECT c_custkey AS reply_id, CAST(i AS INTEGER) AS pos, c_acctbal + i AS elevation, c_acctbal AS lat, i::DOUBLE AS lng, 4.5::DOUBLE AS resolution FROM customer, range(2) t(i) WHERE c_custkey % 9 <> 0")
def elevations(spark, sf):
    rows = F.array(*[F.struct((_bal() + i).alias("elevation"), _point(_bal(), F.lit(i)).alias("location"), F.lit(4.5).alias("resolution")) for i in range(2)])
    return replies.elevations(_replies(spark, sf, rows))


@query("routes", """SELECT c_custkey AS reply_id, CAST(i AS INTEGER) AS pos, concat('via ', i) AS summary, (c_custkey + i)::DOUBLE AS distance_m, (c_custkey * 7 + i)::DOUBLE AS duration_s, 1 AS n_steps, 'go' AS first_step
  FROM customer, range(2) t(i) WHERE c_custkey % 9 <> 0 AND (c_custkey + i) % 3 <> 0""")
def routes(spark, sf):
    def route(i):
        leg = F.struct(F.struct((_k() + i).alias("value")).alias("distance"), F.struct((_k() * 7 + i).alias("value")).alias("duration"), F.array(F.struct(F.lit("go").alias("html_instructions"), F.lit("DRIVING").alias("travel_mode"))).alias("steps"))
        legs = F.when((_k() + i) % 3 == 0, F.slice(F.array(leg), 1, 0)).otherwise(F.array(leg))
        return F.struct(F.lit(f"via {i}").alias("summary"), legs.alias("legs"))

    r = replies.routes(_replies(spark, sf, F.array(route(0), route(1)), "routes"))
    return r.withColumn("n_steps", F.size("steps")).withColumn("first_step", F.col("steps")[0]["instructions"]).drop("steps")


def _weather(spark, sf, series):
    days = F.array(F.lit("2024-01-01"), F.lit("2024-01-02"))
    lists = [F.array(_bal() + n, _bal() - n).alias(s) for n, s in enumerate(series)]
    daily = F.struct(days.alias("time"), *lists, F.array(F.lit("06:00"), F.lit("06:01")).alias("sunrise"), F.array(F.lit("20:00"), F.lit("20:01")).alias("sunset"))
    current = F.struct(_bal().alias("temperature_2m"), (_k() % 100).alias("relative_humidity_2m"), F.lit(3).alias("weather_code"))
    return _customers(spark, sf).select(_k().alias("reply_id"), _json(("daily", daily), ("current", current)).alias("output"))


def _series_sql(series, extra=""):
    cols = ", ".join(f"CASE i WHEN 0 THEN c_acctbal + {n} ELSE c_acctbal - {n} END AS {s}" for n, s in enumerate(series))
    return f"SELECT c_custkey AS reply_id, CAST(i AS INTEGER) AS pos, concat('2024-01-0', i + 1) AS day, {cols}, concat('06:0', i) AS sunrise, concat('20:0', i) AS sunset{extra} FROM customer, range(2) t(i)"


@query("weather_archive", _series_sql(replies.ARCHIVE_SERIES))
def weather_archive(spark, sf):
    return replies.weather_archive(_weather(spark, sf, replies.ARCHIVE_SERIES))


@query("weather_forecast", _series_sql(replies.FORECAST_SERIES, ", c_acctbal AS current_temperature_2m, (c_custkey % 100)::DOUBLE AS current_relative_humidity_2m, 3.0::DOUBLE AS current_weather_code"))
def weather_forecast(spark, sf):
    return replies.weather_forecast(_weather(spark, sf, replies.FORECAST_SERIES))


@query("selected_paths", """SELECT c_custkey AS reply_id, s AS selector, CASE s WHEN 'daily.rain_sum[0]' THEN c_custkey::VARCHAR WHEN 'daily.note' THEN 'n' END AS value FROM customer, (VALUES ('daily.rain_sum[0]'), ('daily.rain_sum[9]'), ('daily.note'), ('daily..note'), ('none.at[0]')) t(s)""")
def selected_paths(spark, sf):
    daily = F.struct(F.array(_k(), _k() + 1).alias("rain_sum"), F.lit("n").alias("note"))
    wanted = F.array(*[F.lit(s) for s in ("daily.rain_sum[0]", "daily.rain_sum[9]", "daily.note", "daily..note", "none.at[0]")])
    return replies.select_paths(_customers(spark, sf).select(_k().alias("reply_id"), _json(("daily", daily)).alias("output"), wanted.alias("selectors")))


@query("search_sections", """SELECT c_custkey AS reply_id, 'organic' AS section, concat('[{"link":"l', c_custkey, '"},{"link":"m"}]') AS value FROM customer UNION ALL SELECT c_custkey, 'answer', concat('{"text":"', c_name, '"}') FROM customer
UNION ALL SELECT c_custkey, 'missing', NULL FROM customer""")
def search_sections(spark, sf):
    hits = F.array(*[F.struct(x.alias("link")) for x in (F.concat(F.lit("l"), _k().cast("string")), F.lit("m"), F.lit("n"))])
    doc = _json(("organic", hits), ("answer", F.struct(F.col("c_name").alias("text"))))
    return replies.search_sections(_customers(spark, sf).select(_k().alias("reply_id"), doc.alias("output")), ["organic", "answer", "missing"], 2)


@query("country_facts", """WITH c AS (SELECT lower(n_name) AS low, arg_min(n_nationkey, n_nationkey) AS k FROM nation GROUP BY 1)
SELECT c_custkey AS request_id, concat('Common ', k) AS country, k * 1000 AS population, (k * 1.5)::DOUBLE AS area FROM customer JOIN c ON c.low = concat('nation_', c_nationkey)""")
def country_facts(spark, sf):
    n = F.col("n_nationkey")
    one = views.load(spark, sf, "nation").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("name"), F.concat(F.lit("Common "), n.cast("string")).alias("common"), (n * 1000).alias("population"), (n * 1.5).alias("area"))
    again = one.withColumn("pos", F.col("pos") + 100).withColumn("common", F.lit("later"))
    asked = _customers(spark, sf).select(_k().alias("request_id"), F.concat(F.lit("Nation_"), F.col("c_nationkey").cast("string")).alias("country"))
    out = replies.country_facts(asked, one.unionByName(again))
    return out.withColumn("area", F.col("area").cast("double"))


_PRICES = """prices_q AS (SELECT CAST(user_id % 20 AS VARCHAR) AS ticker, CAST(ts AS DATE) AS day, max(value) AS close, count(*) AS volume FROM events WHERE isodow(ts) < 6 AND event_type = 'purchase' GROUP BY 1, 2),
asks_q AS (SELECT event_id AS request_id, CAST(user_id % 20 AS VARCHAR) AS ticker, CAST(ts AS DATE) AS day FROM events)"""


def _prices(spark, sf):
    e = views.load(spark, sf, "events").select("event_id", "event_type", F.pmod("user_id", F.lit(20)).cast("string").alias("ticker"), F.col("ts").cast("date").alias("day"), "value")
    p = e.where((F.weekday("day") < 5) & (F.col("event_type") == "purchase")).groupBy("ticker", "day").agg(F.max("value").alias("close"), F.count(F.lit(1)).alias("volume"))
    return e.select(F.col("event_id").alias("request_id"), "ticker", "day"), p


@query("asof_price", f"""WITH {_PRICES} SELECT a.request_id, a.ticker, a.day, p.day AS actual_day, round(p.close, 2) AS close_price, p.volume FROM asks_q a ASOF JOIN prices_q p ON a.ticker = p.ticker AND a.day >= p.day WHERE a.day - p.day <= 5""")
def asof_price(spark, sf):
    return replies.asof_prices(*_prices(spark, sf))


@query("exact_day_price", f"""WITH {_PRICES}, a AS (SELECT * FROM prices_q WHERE volume % 2 = 0) SELECT k.request_id, k.ticker AS symbol, k.day, coalesce(a.close, b.close + 1) AS close, coalesce(a.volume, b.volume) AS volume, coalesce(a.close * 2, b.close * 3) AS quote_volume
FROM asks_q k LEFT JOIN a ON a.ticker = k.ticker AND a.day = k.day JOIN prices_q b ON b.ticker = k.ticker AND b.day = k.day""")
def exact_day_price(spark, sf):
    asks, p = _prices(spark, sf)
    p = p.withColumnRenamed("ticker", "symbol")
    a = p.where("volume % 2 = 0").withColumn("quote_volume", F.col("close") * 2)
    b = p.withColumn("quote_volume", F.col("close") * 3).withColumn("close", F.col("close") + 1)
    return replies.coin_prices(asks.withColumnRenamed("ticker", "symbol"), a, b)


# --- one value per reply -------------------------------------------------------------------

_CASES = [
    ("maps_geocode", "coords", lambda k: _json(("location", _point(k + 0.5, k + 1.5))), "concat('{\"latitude\":\"', k, '.5\",\"longitude\":\"', k + 1, '.5\"}')"),
    ("maps_geocode", "coords", lambda k: _json(("lat", F.lit(0)), ("lng", k)), "concat('{\"lat\":0,\"lng\":', k, '}')"),
    ("maps_elevation", "elevation", lambda k: _json(("results", F.array(F.struct((k + 0.5).alias("elevation"))))), "concat(k, '.5')"),
    ("maps_distance_matrix", "distance_km", lambda k: _json(("results", F.array(F.struct(F.array(F.struct(F.struct((k * 500).alias("value")).alias("distance"))).alias("elements"))))), "concat(k // 2, CASE WHEN k % 2 = 1 THEN '.5' ELSE '' END)"),
    ("maps_distance_matrix", "distance_km", lambda k: _json(("results", F.array(F.struct(F.array(F.struct(F.lit("ZERO_RESULTS").alias("status"), k.alias("n"))).alias("elements"))))), "NULL"),
    ("maps_directions", "duration", lambda k: _json(("routes", F.array(F.struct(F.struct((k * 90).alias("value")).alias("duration"))))), "CAST(k * 90 // 60 AS VARCHAR)"),
    ("maps_search_places", "poi_count", lambda k: _json(("places", F.array_repeat(F.struct(k.alias("id")), (k % 4).cast("int")))), "CAST(k % 4 AS VARCHAR)"),
    ("maps_search_places", "place_rating", lambda k: _json(("places", F.array(F.struct(F.when(k % 2 == 0, 4.5).alias("rating"), k.alias("id"))))), "CASE WHEN k % 2 = 0 THEN '4.5' ELSE '0' END"),
    ("countries_population", "population", lambda k: _json(("population", k * 1000)), "CAST(k * 1000 AS VARCHAR)"),
    ("countries_area", "area_km2", lambda k: _json(("area_km2", k + 0.25)), "concat(k, '.25')"),
    ("stock_historical_price", "stock_price", lambda k: _json(("close_price", k + 0.75)), "concat(k, '.75')"),
    ("stock_volume", "stock_volume", lambda k: _json(("volume", k * 3)), "CAST(k * 3 AS VARCHAR)"),
    ("crypto_volume", "crypto_volume", lambda k: _json(("volume", k + 0.5)), "concat(k, '.5')"),
    ("weather_historical", "precipitation", lambda k: F.concat(F.lit('{"daily.snowfall_sum[0]":'), k.cast("string"), F.lit("}")), "CAST(k AS VARCHAR)"),
    ("weather_historical", "temperature", lambda k: _json(("temperature_2m_max", F.array(k, k + 1))), "CAST(k AS VARCHAR)"),
    ("python_execute_code", "days", lambda k: _json(("stdout", F.concat(k.cast("string"), F.lit("\n"))), ("exit_code", F.lit(0))), "CAST(k AS VARCHAR)"),
    ("python_execute_code", "days", lambda k: F.concat(F.lit(" "), k.cast("string"), F.lit("\n")), "CAST(k AS VARCHAR)"),
    ("fetch_webpage", "text", lambda k: F.concat(F.lit("about "), k.cast("string"), F.lit(" people")), "CAST(k AS VARCHAR)"),
    ("fetch_webpage", "text", lambda k: F.lit("nothing here"), "'nothing here'"),
]


@query("reply_values", "WITH r AS (SELECT c_custkey AS k, i FROM customer, range(" + str(len(_CASES)) + ") t(i)) SELECT k, i AS case_id, CASE i " + " ".join(f"WHEN {n} THEN {c[3]}" for n, c in enumerate(_CASES)) + " END AS value FROM r")
def reply_values(spark, sf):
    rows = F.inline(F.array(*[F.struct(F.lit(n).cast("bigint").alias("case_id"), F.lit(t).alias("tool_name"), F.lit(o).alias("output_key"), f(_k()).alias("output")) for n, (t, o, f, _s) in enumerate(_CASES)]))
    return replies.reply_values(_customers(spark, sf).select(_k().alias("k"), rows)).select("k", "case_id", "value")


_CONTEXT = "context"


@query("threaded_args", """SELECT c_custkey AS k, concat('{"latitude":"', c_custkey, '","longitude":"7","n":"5","start":"x"}') AS merged, concat('{"locations":"[{\\"latitude\\":\\"', c_custkey, '\\",\\"longitude\\":\\"7\\"}]"}') AS located,
  concat('{"destinations":"[\\"8,9\\"]","origins":"[\\"', c_custkey, ',7\\"]"}') AS matrix FROM customer""")
def threaded_args(spark, sf):
    a = F.concat(F.lit('{"latitude":"'), _k().cast("string"), F.lit('","longitude":"7"}'))
    ctx = F.create_map(F.lit("a"), a, F.lit("b"), F.lit('{"latitude":"8","longitude":"9"}'), F.lit("n"), F.lit("5"))

    def key(**args):
        pairs = [F.lit(x) for kv in args.items() for x in kv]
        return replies.args_key(replies.resolve_args(F.create_map(*pairs), ctx))

    return _customers(spark, sf).select(
        _k().alias("k"), key(__from_previous='["a", "n", "none"]', start="x").alias("merged"), key(__from_previous_as_locations="a").alias("located"),
        key(__from_previous_as_origins_destinations='["a", "b"]').alias("matrix"),
    )


def tool_replies(chain_df):
    """Replies for the calls of the chain view: coordinates from the address, heights from coordinates."""
    addr = F.regexp_extract("address", r"(\d+)$", 1)
    calls = chain_df.where("step = 0").select("tool_name", F.try_element_at("args", F.lit("address")).alias("address"), "args")
    calls = calls.groupBy("tool_name", "address").agg(F.first("args").alias("args"))
    geo = calls.where("tool_name = 'maps_geocode' AND NOT contains(address, '[')")
    point = _json(("lat", addr), ("lng", F.concat(F.lit("1"), addr)))
    a = geo.select("tool_name", "args", point.alias("output"), F.lit(None).cast("string").alias("error"))
    located = F.concat(F.lit("["), _json(("latitude", addr), ("longitude", F.concat(F.lit("1"), addr))), F.lit("]"))
    b = geo.select(
        F.lit("maps_elevation").alias("tool_name"), F.create_map(F.lit("locations"), located).alias("args"), _json(("elevation", addr.cast("bigint") * 10)).alias("output"), F.lit(None).cast("string").alias("error")
    )
    pop = calls.where("tool_name = 'countries_population'")
    c = pop.select("tool_name", "args", _json(("population", addr.cast("bigint") * 1000)).alias("output"), F.when(addr == "3", "limit").alias("error"))
    return a.unionByName(b).unionByName(c)


def keyed_chain(stops):
    keys = F.when(F.col("tool_name") == "maps_geocode", "coords").when(F.col("tool_name") == "maps_elevation", "elevation").when(F.col("tool_name") == "countries_population", "population").otherwise("result")
    return views.chain(stops).withColumn("output_key", keys)


# address number 0 is a zero coordinate, which counts as missing: the reply itself is then the value
CHAIN_SQL = """last_q AS (SELECT trail_id, stop_index, max(step) AS last_step FROM chain_v GROUP BY 1, 2),
rep_q AS (SELECT c.trail_id, c.stop_index, c.tool_name, l.last_step, c.arg_address AS a, CAST(regexp_extract(c.arg_address, '(\\d+)$', 1) AS BIGINT) AS n FROM chain_v c JOIN last_q l USING (trail_id, stop_index) WHERE c.step = 0),
value_q AS (SELECT trail_id, stop_index, CASE
  WHEN tool_name = 'maps_geocode' AND NOT contains(a, '[') THEN CASE WHEN last_step = 0 THEN CASE WHEN n = 0 THEN '{"lat":"0","lng":"10"}' ELSE concat('{"latitude":"', n, '","longitude":"1', n, '"}') END
     WHEN n = 0 THEN NULL ELSE CAST(n * 10 AS VARCHAR) END
  WHEN tool_name = 'countries_population' AND n <> 3 THEN CAST(n * 1000 AS VARCHAR) END AS val FROM rep_q)"""


@query("chain_values", f"WITH {CHAIN_SQL} SELECT trail_id, stop_index, val AS value FROM value_q")
def chain_values(spark, sf):
    chain = keyed_chain(views.stops(spark, sf))
    return replies.replay_chains(chain, tool_replies(chain), max_steps=2).select("trail_id", "stop_index", "value")


def _replay(spark, sf):
    # read for every kind of stop, for sources, chains and calls: numbered and written once
    s = views.stops(spark, sf).select(
        "trail_id", "stop_index", "stop_type", "page_url", "value_type", "value_str", "value_num", "expression", "reason_source_stop",
        "extracted_value", "tool_name", "tool_date", "address", "l_partkey", "l_suppkey",
    )
    s = written(s, "replayed-stops")
    s = s.withColumn("reason_transform", F.when((F.col("stop_type") == "reason") & (F.col("l_partkey") % 4 != 0), "digit_sum"))
    chain = keyed_chain(s)
    pages = s.select(F.col("page_url").alias("url")).distinct().where("url IS NOT NULL AND NOT endswith(url, '_7')").withColumn("markdown", F.lit("Nothing but 12345 and text."))
    return s, chain, replay.replay_stops(s, chain, pages, tool_replies(chain), max_steps=2)


_REPLAY = f"""{CHAIN_SQL}, src_q AS (SELECT s.*, b.value_str AS src_value, b.value_type AS src_type FROM stops_v s LEFT JOIN stops_v b ON b.trail_id = s.trail_id AND b.stop_index = s.reason_source_stop),
raw_q AS (SELECT s.trail_id, s.stop_index, s.stop_type, s.value_str AS expected, s.page_url LIKE '%\\_7' ESCAPE '\\' AS gone, v.val, c.trail_id IS NOT NULL AS chained, s.expression, s.l_partkey, src_type, s.value_type AS src_value_type,
  CAST(abs(trunc(TRY_CAST(src_value AS DOUBLE))) AS BIGINT) AS src_n FROM src_q s LEFT JOIN value_q v ON v.trail_id = s.trail_id AND v.stop_index = s.stop_index
  LEFT JOIN (SELECT DISTINCT trail_id, stop_index FROM chain_v) c ON c.trail_id = s.trail_id AND c.stop_index = s.stop_index),
act_q AS (SELECT *, CASE stop_type WHEN 'page' THEN CASE WHEN NOT gone THEN CASE WHEN TRY_CAST(expected AS DOUBLE) IS NOT NULL AND abs(12345 - TRY_CAST(expected AS DOUBLE)) / greatest(abs(TRY_CAST(expected AS DOUBLE)), 1) < 0.01 AND src_value_type = 'number' THEN '12345' ELSE expected END END
  WHEN 'tool' THEN val WHEN 'compute' THEN CASE WHEN expression IS NOT NULL THEN CAST((trail_id + 10) % 10 AS VARCHAR) END
  ELSE CASE WHEN l_partkey % 4 <> 0 AND src_type = 'number' AND src_n >= 10 THEN CAST(list_sum(list_transform(string_split(CAST(src_n AS VARCHAR), ''), lambda d: CAST(d AS BIGINT))) AS BIGINT)::VARCHAR END END AS actual FROM raw_q),
replay_q AS (SELECT trail_id, stop_index, stop_type, expected, actual, CASE stop_type WHEN 'page' THEN NOT gone
  WHEN 'tool' THEN actual IS NOT NULL AND (expected IS NULL OR (TRY_CAST(actual AS DOUBLE) IS NOT NULL AND TRY_CAST(expected AS DOUBLE) IS NOT NULL AND
    CASE WHEN TRY_CAST(expected AS DOUBLE) = 0 THEN TRY_CAST(actual AS DOUBLE) = 0 ELSE abs(TRY_CAST(actual AS DOUBLE) - TRY_CAST(expected AS DOUBLE)) / greatest(abs(TRY_CAST(expected AS DOUBLE)), 1) < 0.01 END))
  ELSE actual IS NOT NULL AND (expected IS NULL OR coalesce(TRY_CAST(actual AS DOUBLE) = TRY_CAST(expected AS DOUBLE), false)) END AS match FROM act_q)"""


@query("replay_stops", f"WITH {_REPLAY} SELECT trail_id, stop_index, stop_type, match, actual FROM replay_q")
def replay_stops(spark, sf):
    return _replay(spark, sf)[2].select("trail_id", "stop_index", "stop_type", "match", "actual")


_TRAIL_REPLAY = f"""{_REPLAY}, last2_q AS (SELECT trail_id, arg_max(stop_type, stop_index) AS t, max(stop_index) AS i FROM replay_q GROUP BY 1),
trail_q AS (SELECT trail_id, bool_and(CASE WHEN stop_type IN ('tool', 'reason') AND actual IS NOT NULL THEN true ELSE match END) AS success FROM replay_q GROUP BY 1)"""


@query("replay_trails", f"""WITH {_TRAIL_REPLAY} SELECT q.trail_id, q.success, coalesce(CAST(trunc(TRY_CAST(r.actual AS DOUBLE)) AS BIGINT) % 10, -1) AS passcode
FROM trail_q q JOIN last2_q l USING (trail_id) JOIN replay_q r ON r.trail_id = q.trail_id AND r.stop_index = l.i""")
def replay_trails(spark, sf):
    return replay.replay_trails(_replay(spark, sf)[2]).select("trail_id", "success", "passcode")


@query("refreshed_trails", f"""WITH {_TRAIL_REPLAY}, n AS (SELECT q.trail_id, coalesce(CAST(trunc(TRY_CAST(r.actual AS DOUBLE)) AS BIGINT) % 10, -1) AS code FROM trail_q q JOIN last2_q l USING (trail_id)
  JOIN replay_q r ON r.trail_id = q.trail_id AND r.stop_index = l.i WHERE q.success)
SELECT t.trail_id, coalesce(code, passcode) AS passcode, coalesce(code <> passcode, false) AS changed FROM trails_v t LEFT JOIN n ON n.trail_id = t.trail_id""")
def refreshed_trails(spark, sf):
    s, _chain, r = _replay(spark, sf)
    trails, _stops = replay.refresh(views.trails(spark, sf), s, r)
    return trails.select("trail_id", "passcode", "changed")


@query("refreshed_store", f"""WITH {_TRAIL_REPLAY} SELECT s.trail_id, s.stop_index, CASE WHEN q.success AND s.stop_type IN ('tool', 'compute') THEN coalesce(r.actual, s.value_str) ELSE s.value_str END AS value_str
FROM stops_v s LEFT JOIN trail_q q ON q.trail_id = s.trail_id LEFT JOIN replay_q r ON r.trail_id = s.trail_id AND r.stop_index = s.stop_index""")
def refreshed_store(spark, sf):
    """Stops of a store that is refreshed in place."""
    s, _chain, r = _replay(spark, sf)
    path = scratch_path(spark, "store")
    replay.write_store(views.trails(spark, sf), s.select("trail_id", "stop_index", "stop_type", "value_str", "value_num"), path, parts=8)
    replay.refresh_store(spark, path, r)
    return spark.read.parquet(f"{path}/stops").select("trail_id", "stop_index", "value_str")


_TRIALS = """trials_q AS (SELECT s.trail_id, s.stop_index, s.stop_type, t.trial, CASE WHEN l_partkey % 19 = 0 THEN NULL WHEN l_partkey % 7 = 0 AND t.trial = 1 THEN extracted_value * 2 + 5 WHEN l_partkey % 5 = 0 AND t.trial = 0 THEN NULL ELSE extracted_value END AS v,
  l_suppkey % 2 = 0 AS has_forecast FROM stops_v s, range(3) t(trial)),
ref_q AS (SELECT trail_id, stop_index, arg_min(v, trial) FILTER (v IS NOT NULL) AS r FROM trials_q GROUP BY 1, 2),
cons_q AS (SELECT t.trail_id, t.stop_index, any_value(stop_type) AS stop_type, bool_or(has_forecast) AS has_forecast, bool_or(r IS NOT NULL) AS any_value,
  count(*) FILTER (r IS NOT NULL AND v IS NOT NULL AND CASE WHEN r = 0 THEN v = 0 ELSE abs(v - r) / greatest(abs(r), 1) < 0.01 END) / count(*) AS consistency FROM trials_q t JOIN ref_q USING (trail_id, stop_index) GROUP BY 1, 2)"""


def _trials(spark, sf):
    p, v, t = F.col("l_partkey"), F.col("extracted_value"), F.col("trial")
    value = F.when(p % 19 == 0, None).when((p % 7 == 0) & (t == 1), v * 2 + 5).when((p % 5 == 0) & (t == 0), None).otherwise(v)
    s = views.stops(spark, sf).withColumn("trial", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return s.select("trail_id", "stop_index", "stop_type", "trial", value.cast("string").alias("actual"), (F.col("l_suppkey") % 2 == 0).alias("has_forecast"))


@query("consistency", f"WITH {_TRIALS} SELECT * FROM cons_q")
def consistency(spark, sf):
    return replay.consistency(_trials(spark, sf))


@query("consistency_issues", f"""WITH {_TRIALS}, l AS (SELECT trail_id, trial, arg_max(coalesce(v, -1), stop_index) AS v FROM trials_q GROUP BY 1, 2)
SELECT trail_id, stop_index, CASE WHEN NOT any_value THEN 'no_value' WHEN stop_type IN ('page', 'compute') THEN 'unstable_value' ELSE 'unstable_tool' END AS issue FROM cons_q
WHERE NOT any_value OR (consistency < 1 AND (stop_type IN ('page', 'compute') OR (stop_type = 'tool' AND NOT has_forecast)))
UNION ALL SELECT trail_id, NULL, 'passcode_changes' FROM (SELECT trail_id, count(DISTINCT CASE WHEN v < 0 THEN -1 ELSE v % 10 END) AS n FROM l GROUP BY 1) WHERE n > 1""")
def consistency_issues(spark, sf):
    return replay.consistency_issues(_trials(spark, sf))


@query("search_stability", """WITH s AS (SELECT trail_id, search_query AS q, l_suppkey % 3 = 0 AS lost FROM stops_v WHERE bridge_type = 'search_query' AND search_query IS NOT NULL)
SELECT trail_id, count(*) AS total, count(*) FILTER (lost AND q <> 'Part 5') AS failures, count(*) FILTER (lost AND q <> 'Part 5') > greatest(1, count(*) // 2) AS unstable FROM s GROUP BY 1""")
def search_stability(spark, sf):
    s = views.stops(spark, sf).withColumn("expected_result_url", F.when(F.col("l_suppkey") % 3 == 0, F.lit("https://x.org/none")).otherwise(F.col("search_query")))
    found = s.where("search_query IS NOT NULL AND search_query <> 'Part 5'").select("search_query").distinct().withColumn("output", F.concat(F.lit("hit: "), F.col("search_query")))
    return replay.search_stability(s, found)
