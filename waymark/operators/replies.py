"""Tool replies held as a table, and tool chains replayed against it by joins.

``replies(tool_name, args, output, error)``: ``args`` is a map of texts (lists and objects as JSON
text), ``output`` the reply text. A call is a join on the tool and the canonical arguments.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.skew import join_counted
from waymark.functions.text import strip
from waymark.functions.values import let, number_text, to_float, whole
from waymark.session import cut_lineage, written

# --- flattening of reply documents ---------------------------------------------------------


def _doc(replies: DataFrame, ok: bool = True) -> DataFrame:
    """Replies with a parsed document; with ``ok`` only those whose status is OK."""
    d = replies.withColumn("doc", F.try_parse_json("output")).where("doc IS NOT NULL")
    return d.where(F.try_variant_get("doc", "$.status", "string") == "OK") if ok else d


def _v(col: str, path: str, kind: str) -> Column:
    return F.try_variant_get(col, path, kind)


def _rows(df: DataFrame, path: str, keep: list[str], name: str = "item") -> DataFrame:
    return df.select(*keep, F.posexplode(_v("doc", path, "array<variant>")).alias("pos", name))


def geocodes(replies: DataFrame) -> DataFrame:
    """First geocoding result: location, address, place id. Replies without one are dropped."""
    d = _doc(replies).where(_v("doc", "$.results[0]", "variant").isNotNull())
    return d.select(
        "reply_id", _v("doc", "$.results[0].geometry.location.lat", "double").alias("lat"),
        _v("doc", "$.results[0].geometry.location.lng", "double").alias("lng"),
        _v("doc", "$.results[0].formatted_address", "string").alias("formatted_address"),
        _v("doc", "$.results[0].place_id", "string").alias("place_id"),
    )


def reverse_geocodes(replies: DataFrame) -> DataFrame:
    d = _doc(replies).where(_v("doc", "$.results[0]", "variant").isNotNull())
    return d.select(
        "reply_id", _v("doc", "$.results[0].formatted_address", "string").alias("formatted_address"),
        _v("doc", "$.results[0].place_id", "string").alias("place_id"),
        F.to_json(_v("doc", "$.results[0].address_components", "variant")).alias("address_components"),
    )


def places(replies: DataFrame) -> DataFrame:
    """One row per place of a search reply."""
    return _rows(_doc(replies), "$.results", ["reply_id"]).select(
        "reply_id", "pos", _v("item", "$.name", "string").alias("name"), _v("item", "$.formatted_address", "string").alias("formatted_address"),
        _v("item", "$.geometry.location.lat", "double").alias("lat"), _v("item", "$.geometry.location.lng", "double").alias("lng"),
        _v("item", "$.place_id", "string").alias("place_id"), _v("item", "$.rating", "double").alias("rating"),
        _v("item", "$.user_ratings_total", "bigint").alias("user_ratings_total"), _v("item", "$.types", "array<string>").alias("types"),
    )


def place_details(replies: DataFrame) -> DataFrame:
    fields = {"name": "string", "formatted_address": "string", "formatted_phone_number": "string", "website": "string", "rating": "double", "user_ratings_total": "bigint"}
    return _doc(replies).select(
        "reply_id", *[_v("doc", f"$.result.{n}", t).alias(n) for n, t in fields.items()],
        _v("doc", "$.result.geometry.location.lat", "double").alias("lat"), _v("doc", "$.result.geometry.location.lng", "double").alias("lng"),
        F.to_json(_v("doc", "$.result.reviews", "variant")).alias("reviews"), F.to_json(_v("doc", "$.result.opening_hours", "variant")).alias("opening_hours"),
    )


def distances(replies: DataFrame) -> DataFrame:
    """Origin x destination rows of a distance matrix reply."""
    rows = _rows(_doc(replies), "$.rows", ["reply_id", "doc"], "row").withColumnRenamed("pos", "origin_pos")
    cells = rows.select("reply_id", "doc", "origin_pos", F.posexplode(_v("row", "$.elements", "array<variant>")).alias("destination_pos", "cell"))
    names = {n: _v("doc", f"$.{n}_addresses", "array<string>") for n in ("origin", "destination")}
    return cells.select(
        "reply_id", "origin_pos", "destination_pos",
        F.get(names["origin"], F.col("origin_pos")).alias("origin"), F.get(names["destination"], F.col("destination_pos")).alias("destination"),
        _v("cell", "$.status", "string").alias("status"), _v("cell", "$.distance.value", "double").alias("distance_m"),
        _v("cell", "$.duration.value", "double").alias("duration_s"),
    )


def elevations(replies: DataFrame) -> DataFrame:
    return _rows(_doc(replies), "$.results", ["reply_id"]).select(
        "reply_id", "pos", _v("item", "$.elevation", "double").alias("elevation"), _v("item", "$.location.lat", "double").alias("lat"),
        _v("item", "$.location.lng", "double").alias("lng"), _v("item", "$.resolution", "double").alias("resolution"),
    )


def routes(replies: DataFrame) -> DataFrame:
    """First leg of each route; routes without legs are dropped."""
    r = _rows(_doc(replies), "$.routes", ["reply_id"]).withColumn("leg", _v("item", "$.legs[0]", "variant")).where("leg IS NOT NULL")
    steps = F.transform(
        F.coalesce(_v("leg", "$.steps", "array<variant>"), F.array().cast("array<variant>")),
        lambda s: F.struct(
            F.try_variant_get(s, "$.html_instructions", "string").alias("instructions"), F.try_variant_get(s, "$.distance.value", "double").alias("distance_m"),
            F.try_variant_get(s, "$.duration.value", "double").alias("duration_s"), F.try_variant_get(s, "$.travel_mode", "string").alias("travel_mode"),
        ),
    )
    return r.select(
        "reply_id", "pos", _v("item", "$.summary", "string").alias("summary"), _v("leg", "$.distance.value", "double").alias("distance_m"),
        _v("leg", "$.duration.value", "double").alias("duration_s"), steps.alias("steps"),
    )


ARCHIVE_SERIES = [
    "apparent_temperature_mean", "apparent_temperature_min", "apparent_temperature_max", "rain_sum", "precipitation_sum", "snowfall_sum",
    "precipitation_hours", "daylight_duration", "sunshine_duration",
]
FORECAST_SERIES = ["temperature_2m_max", "temperature_2m_min", "rain_sum", "weather_code"]
CURRENT = ["temperature_2m", "relative_humidity_2m", "weather_code"]


def _daily(replies: DataFrame, series: list[str], extra: list[Column]) -> DataFrame:
    d = _doc(replies, ok=False)
    numeric = {s: _v("doc", f"$.daily.{s}", "array<double>") for s in series}
    clock = {s: _v("doc", f"$.daily.{s}", "array<string>") for s in ("sunrise", "sunset")}
    days = F.posexplode(_v("doc", "$.daily.time", "array<string>")).alias("pos", "day")
    base = d.select("reply_id", *extra, *[c.alias(n) for n, c in {**numeric, **clock}.items()], days)
    keep = ["reply_id", "pos", "day", *[c for c in base.columns if c.startswith("current_")]]
    return base.select(*keep, *[F.get(F.col(n), F.col("pos")).alias(n) for n in (*series, "sunrise", "sunset")])


def weather_archive(replies: DataFrame) -> DataFrame:
    """One row per day with the daily series."""
    return _daily(replies, ARCHIVE_SERIES, [])


def weather_forecast(replies: DataFrame) -> DataFrame:
    """One row per day with the daily series and the current values."""
    return _daily(replies, FORECAST_SERIES, [_v("doc", f"$.current.{c}", "double").alias(f"current_{c}") for c in CURRENT])


def select_paths(replies: DataFrame) -> DataFrame:
    """Values of dotted selectors, one row per selector: ``replies(reply_id, output, selectors)``; missing ones null."""
    s = replies.select("reply_id", "output", F.posexplode("selectors").alias("pos", "selector"))
    value = F.call_function("get_json_object", F.col("output"), F.concat(F.lit("$."), F.col("selector")))
    usable = ~F.rlike("selector", F.lit(r"(^|\.)(\.|$)"))
    return s.select("reply_id", "selector", F.when(usable, value).alias("value"))


def search_sections(replies: DataFrame, sections: list[str], num_results: int) -> DataFrame:
    """Chosen sections of a search reply, lists cut to ``num_results`` (kept within 1 to 10)."""
    n = max(1, min(num_results, 10))
    names = F.explode(F.array(*[F.lit(x) for x in sections])).alias("section")
    d = _doc(replies, ok=False).select("reply_id", "doc", names)
    by_name = F.coalesce(*[F.when(F.col("section") == x, _v("doc", f"$.{x}", "variant")) for x in sections])
    cut = F.slice(F.try_variant_get(by_name, "$", "array<variant>"), 1, n)
    return d.select("reply_id", "section", F.when(cut.isNotNull(), F.to_json(cut)).otherwise(F.to_json(by_name)).alias("value"))


# --- facts joined by name and day ----------------------------------------------------------


def country_facts(requests: DataFrame, countries: DataFrame) -> DataFrame:
    """First country matching a name: ``requests(request_id, country)``, ``countries(pos, name, common, population, area)``."""
    firsts = countries.groupBy(F.lower("name").alias("low")).agg(F.min_by(F.struct("common", "population", "area"), "pos").alias("c"))
    return requests.join(firsts, F.lower(requests["country"]) == F.col("low")).select("request_id", F.col("c.common").alias("country"), "c.population", "c.area")


def asof_prices(requests: DataFrame, prices: DataFrame, days: int = 5) -> DataFrame:
    """Last trading day on or before the requested one within ``days``: ``requests(ticker, day)``,
    ``prices(ticker, day, close, volume)``.

    Distinct requests are spread over the days they may fall back to and meet the prices by
    equality on (ticker, day); so a busy ticker is split by day, and no range join is needed.
    """
    wanted = requests.select("ticker", "day").distinct()
    tries = wanted.select("ticker", F.col("day").alias("asked"), F.explode(F.sequence(F.lit(0), F.lit(days))).alias("back"))
    hits = tries.select("ticker", "asked", F.date_sub("asked", F.col("back")).alias("day")).join(prices, ["ticker", "day"])
    best = hits.groupBy("ticker", "asked").agg(F.max_by(F.struct("day", "close", "volume"), "day").alias("p"))
    found = best.select("ticker", F.col("asked").alias("day"), F.col("p.day").alias("actual_day"), F.bround("p.close", 2).alias("close_price"), "p.volume")
    return requests.join(found, ["ticker", "day"])


def coin_prices(requests: DataFrame, primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Exact-day price of a pair, from the first venue that answered: ``venue(symbol, day, close, volume, quote_volume)``."""
    r = requests.withColumn("symbol", F.upper("symbol"))
    cols = ["close", "volume", "quote_volume"]

    def venue(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("symbol", "day").agg(F.min(F.struct(*cols)).alias(name))

    joined = r.join(venue(primary, "a"), ["symbol", "day"], "left").join(venue(fallback, "b"), ["symbol", "day"], "left")
    return joined.withColumn("k", F.coalesce("a", "b")).where("k IS NOT NULL").select(*r.columns, "k.close", "k.volume", "k.quote_volume")


# --- one value per reply -------------------------------------------------------------------


def _num(path: str) -> Column:
    return F.try_variant_get("doc", path, "double")


def _truthy(path: str) -> Column:
    """Text at a path, where zero and blank count as missing."""
    t = F.try_variant_get("doc", path, "string")
    return F.when((t != "") & ~F.coalesce(to_float(t) == 0, F.lit(False)), t)


def reply_values(replies: DataFrame, only_places: bool = False) -> DataFrame:
    """Adds ``value``: the single value of each reply as text, by the rule of its tool.

    ``replies(tool_name, output_key, output)``. Coordinates become a JSON object; a reply without the
    sought field stays as it is; a text that is no JSON gives its first number.
    """
    tool, key, raw = F.col("tool_name"), F.col("output_key"), F.col("output")
    lat = F.coalesce(*[_truthy(p) for p in ("$.location.lat", "$.location.latitude", "$.lat", "$.latitude")])
    lng = F.coalesce(*[_truthy(p) for p in ("$.location.lng", "$.location.longitude", "$.location.lon", "$.lng", "$.longitude")])
    coords = F.when(lat.isNotNull() & lng.isNotNull(), F.to_json(F.struct(lat.alias("latitude"), lng.alias("longitude"))))

    n_places = F.size(F.coalesce(F.try_variant_get("doc", "$.places", "array<variant>"), F.array().cast("array<variant>")))
    rating = F.coalesce(_num("$.places[0].rating"), F.lit(0.0))
    if only_places:
        found = F.when(key == "poi_count", n_places.cast("string")).when(key == "place_rating", number_text(rating))
        is_doc = F.startswith(F.schema_of_variant("doc"), F.lit("OBJECT"))
        return replies.withColumn("doc", F.try_parse_json("output")).withColumn("value", F.when((tool == "maps_search_places") & is_doc, found)).drop("doc")

    def first(*values: Column) -> Column:
        return number_text(F.coalesce(*values))

    def nonzero(c: Column) -> Column:
        return F.when(c != 0, c)

    cell = "$.results[0].elements[0]"
    km = F.coalesce(
        _num("$.distance.value") / 1000, nonzero(_num("$.distance")), nonzero(_num("$.distance_km")),
        _num(f"{cell}.distance.value") / 1000, nonzero(_num(f"{cell}.distance")),
    )
    flat = F.coalesce(_truthy("$.distance"), _truthy("$.distance_km"))
    no_route = flat.isNull() & (F.try_variant_get("doc", f"{cell}.status", "string") == "ZERO_RESULTS")
    minutes = F.coalesce(whole(_num("$.routes[0].duration.value") / 60), whole(_num("$.routes[0].duration")))
    def series(name: str) -> Column:
        return F.coalesce(F.when(_num(f"$.{name}") != 0, _num(f"$.{name}")), _num(f"$.{name}[0]"))

    picked = [F.get_json_object(raw, f"$['daily.{s}[0]']").try_cast("double") for s in ("precipitation_sum", "snowfall_sum", "sunshine_duration")]
    weather = F.coalesce(*picked, *[series(n) for n in ("temperature_2m_max", "max_temp", "temperature")])
    out = strip(F.try_variant_get("doc", "$.stdout", "string"))
    stdout = F.when((F.try_variant_get("doc", "$.exit_code", "int") == 0) & (out != ""), out)
    by_tool = (
        F.when(tool == "maps_geocode", coords)
        .when(tool == "maps_elevation", first(_num("$.elevation"), _num("$.results[0].elevation")))
        .when(tool == "maps_distance_matrix", number_text(km))
        .when(tool == "maps_directions", minutes.cast("string"))
        .when((tool == "maps_search_places") & (key == "poi_count"), n_places.cast("string"))
        .when((tool == "maps_search_places") & (key == "place_rating"), number_text(rating))
        .when(tool == "countries_population", whole(_num("$.population")).cast("string"))
        .when(tool == "countries_area", number_text(_num("$.area_km2")))
        .when(tool.isin("stock_historical_price", "crypto_historical_price"), number_text(_num("$.close_price")))
        .when(tool == "stock_volume", whole(_num("$.volume")).cast("string"))
        .when(tool == "crypto_volume", number_text(_num("$.volume")))
        .when(tool == "weather_historical", number_text(weather))
        .when(tool == "python_execute_code", stdout)
    )
    is_object = F.startswith(F.schema_of_variant("doc"), F.lit("OBJECT"))
    text_value = F.when(tool == "python_execute_code", strip(raw)).otherwise(F.coalesce(F.regexp_substr(raw, F.lit(r"[-+]?\d+\.?\d*")), raw))
    value = (
        F.when(F.col("doc").isNull(), text_value)
        .when(~is_object, F.coalesce(F.try_variant_get("doc", "$", "string"), strip(raw)))
        .when((tool == "maps_distance_matrix") & no_route, F.lit(None))
        .otherwise(F.coalesce(by_tool, raw))
    )
    return replies.withColumn("doc", F.try_parse_json("output")).withColumn("value", value).drop("doc")


# --- chains --------------------------------------------------------------------------------

THREADED = ["__from_previous", "__from_previous_as_locations", "__from_previous_as_origins_destinations"]


def args_key(args: Column) -> Column:
    """Canonical text of arguments: JSON with sorted keys."""
    return F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(args)))), F.lit("{}"))


def resolve_args(args: Column, context: Column) -> Column:
    """Arguments with references to earlier outputs replaced by their values.

    ``context`` maps output keys to value texts. Objects give their keys, single values keep
    the name of their output.
    """
    text_map, text_array = "map<string,string>", "array<string>"

    def at(ref: Column) -> Column:
        return F.try_element_at(context, ref)

    def is_object(v: Column) -> Column:
        return F.startswith(F.ltrim(v), F.lit("{"))

    def names(v: Column) -> Column:
        return F.when(F.startswith(v, F.lit("[")), F.from_json(v, text_array)).otherwise(F.array(v))

    def entries(ref: Column) -> Column:
        v = at(ref)
        own = F.array(F.struct(ref.alias("key"), v.alias("value")))
        return F.when(v.isNull(), F.array().cast("array<struct<key:string,value:string>>")).when(
            is_object(v), F.map_entries(F.from_json(v, text_map))
        ).otherwise(own)

    none = F.array().cast("array<struct<key:string,value:string>>")
    prev = F.try_element_at(args, F.lit("__from_previous"))
    threaded = F.when(prev.isNotNull(), F.flatten(F.transform(names(prev), entries))).otherwise(none)
    loc = at(F.try_element_at(args, F.lit("__from_previous_as_locations")))
    located = F.when(
        F.coalesce(is_object(loc), F.lit(False)), F.array(F.struct(F.lit("locations").alias("key"), F.concat(F.lit("["), loc, F.lit("]")).alias("value")))
    ).otherwise(none)
    ends = F.try_element_at(args, F.lit("__from_previous_as_origins_destinations"))

    def point(i: int) -> Column:
        v = at(F.get(names(ends), i))
        pair = F.concat_ws(",", F.coalesce(F.get_json_object(v, "$.latitude"), F.lit("")), F.coalesce(F.get_json_object(v, "$.longitude"), F.lit("")))
        text = F.when(v.isNull(), ",").when(is_object(v), pair).otherwise(v)
        return F.to_json(F.array(text))

    matrix = F.when(
        F.coalesce(F.size(names(ends)) >= 2, F.lit(False)),
        F.array(F.struct(F.lit("origins").alias("key"), point(0).alias("value")), F.struct(F.lit("destinations").alias("key"), point(1).alias("value"))),
    ).otherwise(none)
    plain = F.map_entries(F.map_filter(args, lambda k, _v: ~k.isin(THREADED)))
    # of equal names the later one stays
    joined = F.concat(threaded, located, matrix, plain)
    last = let(joined, lambda es: F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.size(es)), lambda x: x["key"] == e["key"])))
    return F.map_from_entries(last)


def replay_chains(
    chain: DataFrame, replies: DataFrame, max_steps: int | None = None, keys: Sequence[str] = ("trail_id", "stop_index")
) -> DataFrame:
    """Value of each stop's tool chain: steps in order, each call a join with its reply.

    ``chain(trail_id, stop_index, step, tool_name, args, output_key)``. The chain stops at the first
    unknown call or error, and its value is then null. The steps of one stop (a handful) travel
    in one row. Returns the keys of the chains and (value, calls, error).
    """
    # a stop's chain is one bounded list of its document
    packed = chain.groupBy(*keys).agg(F.array_sort(F.collect_list(packed_step(F.col("step"), F.col("tool_name"), F.col("output_key"), F.col("args")))).alias("steps"))
    packed = written(packed, "steps")
    if max_steps is None:
        max_steps = (packed.agg(F.max(F.element_at("steps", -1)["step"])).first()[0] or 0) + 1
    return replay_packed(packed, replies, max_steps).select(*keys, "value", "calls", "error")


def packed_step(step: Column, tool: Column, output_key: Column, args: Column) -> Column:
    return F.struct(step.alias("step"), tool.alias("tool_name"), output_key.alias("output_key"), args_key(args).alias("args"))


def replay_packed(packed: DataFrame, replies: DataFrame, max_steps: int) -> DataFrame:
    """Rows with their chain in ``steps`` (an array of :func:`packed_step`, in order), and value, calls and error of the chain.

    What a chain gives depends on its steps alone, so equal chains are replayed once; rows come to their results by a join on the steps.
    """
    results = _replayed(packed.select("steps").distinct(), replies, max_steps)
    return join_counted(packed, results, ["steps"])


def _known_replies(replies: DataFrame) -> DataFrame:
    """One row per call (tool, canonical arguments) with its reply read."""
    # values are read once per reply; only place searches depend on the output key
    parsed = reply_values(replies.withColumn("output_key", F.lit("")))
    for key in ("poi_count", "place_rating"):
        parsed = reply_values(parsed.withColumnRenamed("value", "__kept").withColumn("output_key", F.lit(key)), only_places=True)
        parsed = parsed.withColumnRenamed("value", key).withColumnRenamed("__kept", "value")
    # one reply per call, so that a stop stays one row: of repeated ones a good one, then the least by its texts
    reply = F.struct(
        F.col("error").isNotNull().alias("failed"), F.col("error").alias("reply_error"), F.col("value").alias("reply_value"), F.col("poi_count").alias("poi_count"), F.col("place_rating").alias("place_rating")
    )
    known = parsed.select("tool_name", args_key(F.col("args")).alias("args_key"), reply.alias("reply")).groupBy("tool_name", "args_key").agg(F.min("reply").alias("reply"))
    return cut_lineage(known.select("tool_name", "args_key", F.lit(True).alias("answered"), "reply.reply_error", "reply.reply_value", "reply.poi_count", "reply.place_rating"))


def _replayed(chains: DataFrame, replies: DataFrame, max_steps: int) -> DataFrame:
    """``chains(steps)``, different ones, with value, calls and error."""
    known = _known_replies(replies)
    state = chains.select(
        "steps", F.create_map().cast("map<string,string>").alias("context"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("calls"), F.lit(None).cast("string").alias("value"),
    )
    for p in range(max_steps):
        s = F.get("steps", p)
        live = s.isNotNull() & F.col("error").isNull()
        named = state.withColumn("tool_name", s["tool_name"]).withColumn("output_key", s["output_key"]).withColumn("live", live)
        resolved = named.withColumn(
            "args_key", F.when(live, args_key(resolve_args(F.from_json(s["args"], "map<string,string>"), F.col("context"))))
        )
        # rows without a call get keys of their own, so they do not gather in one task
        idle = F.concat_ws("|", F.lit("idle"), F.xxhash64("steps").cast("string"))
        keyed = resolved.withColumn("args_key", F.coalesce("args_key", idle)).withColumn("tool_name", F.coalesce("tool_name", F.lit("")))
        joined = keyed.withColumnRenamed("value", "last_value").join(known, ["tool_name", "args_key"], "left")
        by_key = F.when(F.col("tool_name") == "maps_search_places", F.when(F.col("output_key") == "poi_count", F.col("poi_count")).when(F.col("output_key") == "place_rating", F.col("place_rating")))
        joined = joined.withColumn("value", F.coalesce(by_key, F.col("reply_value")))
        failed = F.col("live") & (F.col("answered").isNull() | F.col("reply_error").isNotNull())
        err = F.when(failed, F.coalesce("reply_error", F.concat(F.lit("no reply: "), F.col("tool_name"))))
        got = F.col("live") & ~failed
        # a context key may be set again; the later value stays
        kept = F.map_filter("context", lambda key, _v: ~F.equal_null(key, F.col("output_key")))
        added = F.map_concat(kept, F.create_map(F.coalesce("output_key", F.lit("result")), F.col("value")))
        state = joined.select(
            "steps", F.when(got, added).otherwise(F.col("context")).alias("context"), F.coalesce("error", err).alias("error"),
            (F.col("calls") + F.col("live").cast("int")).alias("calls"), F.when(got, F.col("value")).otherwise(F.col("last_value")).alias("value"),
        )
    return state.select("steps", F.when(F.col("error").isNull(), F.col("value")).alias("value"), "calls", "error")
