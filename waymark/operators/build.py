"""Trail building: plans to stops, tool templates, trimming, reason stops, bridges, compute stop.

Random draws are md5 orders over (seed, trail, stop, salt), so they repeat on any cluster layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark import fixed
from waymark.functions import numbers as nums
from waymark.functions.skew import ARRAY_ROWS, counted, dense_index, draw_int, draw_order, first_per_key, first_upto, hot_keys, running_sum, shuffled, with_earlier
from waymark.functions.text import clean_markdown, strip
from waymark.functions.values import int_view, to_float
from waymark.operators import transforms
from waymark.operators.dims import level_config, table, texts
from waymark.operators.facts import is_geocodable, page_entities
from waymark.session import cut_lineage, written

K = ["trail_id", "stop_index"]


def _bucket(col: str = "stop_index") -> Column:
    return F.floor(F.col(col) / 1024)


# --- plans ---------------------------------------------------------------------------------


def stop_budget(plans: DataFrame) -> DataFrame:
    """Stops to plan: ``plans(plan_id, depth, tool_stops)``; a third more tool stops absorb failures."""
    over = F.greatest(F.lit(1), F.floor(F.col("tool_stops") / 3))
    content = F.col("depth") - 1 + over
    tools = F.col("tool_stops") + over
    pages = content - tools
    return plans.select(
        "plan_id", over.alias("overplan"), content.alias("content_stops"),
        F.when(pages < 1, content - 1).otherwise(tools).alias("planned_tools"), F.greatest(pages, F.lit(1)).alias("page_stops"),
    )


def check_plans(planned: DataFrame, pages: DataFrame) -> DataFrame:
    """First fault of each plan: a page that is not in the graph, or one that was named before.

    ``planned(plan_id, pos, url)``; tool stops that name a page count as well.
    """
    named = planned.where("url <> ''")
    first = named.groupBy("plan_id", "url").agg(F.min("pos").alias("first_pos"))
    known = pages.select("url").distinct().withColumn("known", F.lit(True))
    fault = F.when(F.col("known").isNull(), "unknown_page").when(F.col("pos") > F.col("first_pos"), "repeated_page")
    faults = named.join(first, ["plan_id", "url"]).join(known, "url", "left").select("plan_id", "pos", fault.alias("fault")).where("fault IS NOT NULL")
    return faults.groupBy("plan_id").agg(F.min_by("fault", "pos").alias("fault"), F.min("pos").alias("pos"))


def draw_earlier(stops: DataFrame, values: DataFrame, salt: str, seed: int = 0, extra: Column | None = None) -> DataFrame:
    """One drawn value per stop among the values of earlier stops of its trail.

    ``values(trail_id, stop_index, value)``. The draw is an ordinal, fetched from the trail's array of values or, where a trail
    has many, by an equi-join, so stops and values are never multiplied out. ``extra`` is one more candidate of the stop itself, or null.
    """
    cols = stops.columns
    v = values.select("trail_id", "stop_index", "value")
    stops = stops.withColumn("__extra", F.lit(None).cast("string") if extra is None else extra)
    n = F.col("n_before") + F.col("__extra").isNotNull().cast("int")
    pick = F.when(n > 0, F.pmod(draw_int(seed, salt, *K), n))
    drawn = F.when(F.col("__pick") < F.col("n_before"), F.col("__value")).when(F.col("__pick").isNotNull(), F.col("__extra"))
    hot = hot_keys(v, ["trail_id"], ARRAY_ROWS)

    def plain(some: DataFrame, known: DataFrame) -> DataFrame:
        s = with_earlier(some, known, "value").withColumn("__pick", pick)
        return s.withColumn("__value", F.get("__all", F.col("__pick").cast("int"))["value"]).select(*cols, drawn.alias(salt))

    if hot is None:
        return plain(stops, v)
    rest = plain(*(df.join(shuffled(hot), "trail_id", "left_anti") for df in (stops, v)))
    stops, v = (df.join(shuffled(hot), "trail_id", "left_semi") for df in (stops, v))
    numbered = dense_index(v, ["trail_id"], [F.col("stop_index"), F.col("value")], _bucket(), "ord")
    marks = stops.select(*K, F.lit(0).alias("is_value")).unionByName(v.select(*K, F.lit(1).alias("is_value")))
    before = running_sum(marks, ["trail_id"], [F.col("stop_index"), F.col("is_value")], _bucket(), F.col("is_value"), "n_before")
    s = stops.join(before.where("is_value = 0").select(*K, "n_before"), K).withColumn("__pick", pick)
    picked = numbered.select("trail_id", F.col("ord").alias("__pick"), F.col("value").alias("__value"))
    return rest.unionByName(s.join(picked, ["trail_id", "__pick"], "left").select(*cols, drawn.alias(salt)))


# --- tool templates ------------------------------------------------------------------------

CHAIN_TYPE = "array<struct<step:int,tool_name:string,args:map<string,string>,output_key:string>>"


def _step(pos: int, tool: str, key: str, **args: Column) -> Column:
    pairs = [x for name, value in args.items() for x in (F.lit(name), value.cast("string"))]
    return F.struct(F.lit(pos).alias("step"), F.lit(tool).alias("tool_name"), F.create_map(*pairs).alias("args"), F.lit(key).alias("output_key"))


def _weather(location: Column, day: Column, series: str, key: str) -> Column:
    select = F.lit(f'["daily.{series}[0]"]')
    return F.array(
        _step(0, "maps_geocode", "coords", address=location),
        _step(1, "weather_historical", key, __from_previous=F.lit("coords"), start_date=day, end_date=day, select=select),
    )


def template_rows(location: Column, other: Column, country: Column, ticker: Column, coin: Column, days: Column, number: Column, draw: Column, reference: Column) -> Column:
    """All templates a stop can use, as an array of (template, chain); ``days`` maps templates to days.

    An array per stop and one generator keep the plan flat: no join with a template table and no
    filter on a large expression.
    """

    def day_of(name: str) -> Column:
        return F.try_element_at(days, F.lit(name))

    def trading_day_of(name: str) -> Column:
        d = day_of(name)
        return F.date_sub(d, F.greatest(F.weekday(d) - 4, F.lit(0)))

    poi = F.get(texts(fixed.POI_TYPES), F.pmod(draw, F.lit(len(fixed.POI_TYPES))).cast("int"))
    factors = F.array(*[F.lit(f) for _a, _b, f in fixed.UNIT_FACTORS])
    factor = F.get(factors, F.pmod(draw, F.lit(len(fixed.UNIT_FACTORS))).cast("int"))
    geocode = _step(0, "maps_geocode", "coords", address=location)
    days_code = F.concat(F.lit("days_between("), day_of("date_computation").cast("string"), F.lit(", "), reference.cast("string"), F.lit(")"))
    unit_code = F.concat(F.lit("int("), number.cast("string"), F.lit(" * "), factor.cast("string"), F.lit(")"))
    two_places = location.isNotNull() & other.isNotNull() & (location != other)

    def dated(name: str, steps: Column, needs: Column = location) -> tuple[Column, Column]:
        return needs.isNotNull() & day_of(name).isNotNull(), steps

    def series(name: str, column: str, key: str) -> tuple[Column, Column]:
        return dated(name, _weather(location, day_of(name), column, key))

    stock_day, volume_day = trading_day_of("stock_price"), trading_day_of("stock_volume")
    chains = {
        "geocode_elevation": (location.isNotNull(), F.array(geocode, _step(1, "maps_elevation", "elevation", __from_previous_as_locations=F.lit("coords")))),
        "geocode_weather_historical": dated(
            "geocode_weather_historical",
            F.array(geocode, _step(1, "weather_historical", "temperature", __from_previous=F.lit("coords"), date=day_of("geocode_weather_historical"))),
        ),
        "geocode_distance": (
            two_places,
            F.array(
                _step(0, "maps_geocode", "coords_a", address=location), _step(1, "maps_geocode", "coords_b", address=other),
                _step(2, "maps_distance_matrix", "distance_km", __from_previous_as_origins_destinations=F.lit('["coords_a","coords_b"]')),
            ),
        ),
        "date_computation": (day_of("date_computation").isNotNull(), F.array(_step(0, "python_execute_code", "days", code=days_code))),
        "geocode_directions_duration": (two_places, F.array(_step(0, "maps_directions", "duration", origin=location, destination=other, mode=F.lit("driving")))),
        "geocode_weather_precipitation": series("geocode_weather_precipitation", "precipitation_sum", "precipitation"),
        "math_conversion": (number.isNotNull(), F.array(_step(0, "python_execute_code", "converted", code=unit_code))),
        "nearby_poi_count": (location.isNotNull(), F.array(_step(0, "maps_search_places", "poi_count", query=F.concat(poi, F.lit(" near "), location)))),
        "place_rating": (location.isNotNull(), F.array(_step(0, "maps_search_places", "place_rating", query=location))),
        "country_population": (country.isNotNull(), F.array(_step(0, "countries_population", "population", country=country))),
        "country_area": (country.isNotNull(), F.array(_step(0, "countries_area", "area_km2", country=country))),
        "historical_snowfall": series("historical_snowfall", "snowfall_sum", "snowfall"),
        "historical_sunshine": series("historical_sunshine", "sunshine_duration", "sunshine"),
        "stock_price": dated("stock_price", F.array(_step(0, "stock_historical_price", "stock_price", ticker=ticker, date=stock_day)), ticker),
        "stock_volume": dated("stock_volume", F.array(_step(0, "stock_volume", "stock_volume", ticker=ticker, date=volume_day)), ticker),
        "crypto_price": dated("crypto_price", F.array(_step(0, "crypto_historical_price", "crypto_price", symbol=coin, date=day_of("crypto_price"))), coin),
        "crypto_volume": dated("crypto_volume", F.array(_step(0, "crypto_volume", "crypto_volume", symbol=coin, date=day_of("crypto_volume"))), coin),
    }
    rows = [F.when(ok, F.struct(F.lit(name).alias("template"), steps.cast(CHAIN_TYPE).alias("chain"))) for name, (ok, steps) in chains.items()]
    return F.array_compact(F.array(*rows))


def templates(spark) -> DataFrame:
    rows = [(n, i) for i, n in enumerate(fixed.FALLBACK_TEMPLATES)] + [(n, None) for n in fixed.MARKET_TEMPLATES]
    return table(spark, rows, "template string, fallback_rank int")


def expand_templates(tool_stops: DataFrame, dates: DataFrame, reference_day: str = "2024-01-01", seed: int = 0) -> DataFrame:
    """Every template a tool stop can use, with its chain.

    ``tool_stops(trail_id, stop_index, tool_type, location, other_location, country, ticker, coin, number)``, ``dates`` as of
    :func:`waymark.operators.facts.tool_dates`. Stock days move to the trading day before. 17 fixed
    rows per stop at most.
    """
    # nine dated templates per stop at most
    days = dates.groupBy(*K).agg(F.map_from_entries(F.collect_list(F.struct("template", "day"))).alias("days"))
    c = F.col
    rows = template_rows(
        c("location"), c("other_location"), c("country"), c("ticker"), c("coin"), c("days"), c("number"), draw_int(seed, "template", *K), F.lit(reference_day)
    )
    ranks = templates(tool_stops.sparkSession)
    e = tool_stops.join(days, K, "left").select(*K, "tool_type", F.inline(rows)).join(ranks, "template")
    rank = F.when(c("template") == c("tool_type"), -1).otherwise(c("fallback_rank"))
    return e.select(*K, "template", rank.alias("priority"), "chain")


def choose_templates(expanded: DataFrame) -> DataFrame:
    """The planned template where possible, else the first possible one in the fallback order."""
    return first_per_key(expanded.where("priority IS NOT NULL"), K, [F.col("priority")])


def stops_from_plan(planned: DataFrame, chosen: DataFrame, page_info: DataFrame, dates: DataFrame, seed: int = 0, reference_day: str = "2024-01-01") -> DataFrame:
    """Stops of a plan: ``planned(trail_id, stop_index, type, tool_type, url)``, ``chosen`` facts per page stop
    (trail_id, stop_index, description, section, value, value_type).

    Trails with a page stop without fact are dropped, impossible tool stops are skipped, and the
    rest is numbered densely. Returns stops with their tool chain.
    """
    # pages are many and their texts short only in Spark's estimate: held when counted as few
    named = planned.where("url IS NOT NULL").select("url").distinct()
    ents = counted(page_entities(page_info).join(counted(named), "url", "left_semi"))
    pages = planned.where("type = 'page'").select(*K, "url").join(chosen.select(*K, "description", "section", "value", "value_type"), K, "left")
    failed = shuffled(pages.where("value IS NULL").select("trail_id").distinct())
    pages = pages.where("value IS NOT NULL").join(failed, "trail_id", "left_anti")
    plan = planned.join(failed, "trail_id", "left_anti")

    # values that later tool stops may draw from
    hinted = F.when(
        (F.col("value_type") == "text") & (F.length("value") < 60) & ~F.rlike("value", F.lit(r"\d")) & is_geocodable(strip(F.col("value"))), strip(F.col("value"))
    )
    # used several times below: written once
    here = cut_lineage(pages.join(ents, "url", "left"))
    pages = here
    locs = here.select(*K, F.inline(F.array(F.struct(F.lit(0).alias("src"), hinted.alias("value")), F.struct(F.lit(1).alias("src"), F.col("location").alias("value")))))
    locs = locs.where("value IS NOT NULL")
    firsts = locs.groupBy("trail_id", "value").agg(F.min(F.struct("stop_index", "src")).alias("first"))
    # every hint counts, a page's own location only once per trail
    locations = locs.join(firsts, ["trail_id", "value"]).where(
        (F.col("src") == 0) | (F.struct("stop_index", "src") == F.col("first"))
    ).where(is_geocodable(clean_markdown(F.col("value")))).select(*K, clean_markdown(F.col("value")).alias("value"))
    countries = here.where("country IS NOT NULL").groupBy("trail_id", F.col("country").alias("value")).agg(F.min("stop_index").alias("stop_index"))
    numbers = pages.where("value_type = 'number'").select(*K, to_float(F.col("value")).cast("string").alias("value"))

    tools = plan.where("type = 'tool'").select(*K, F.coalesce("tool_type", F.lit("geocode_elevation")).alias("tool_type"), "url")
    tools = tools.join(ents.withColumnRenamed("country", "own_country"), "url", "left").withColumn("location", clean_markdown(F.col("location")))
    seen = countries.select("trail_id", F.col("value").alias("own_country"), F.col("stop_index").alias("seen_at"))
    tools = tools.join(seen, ["trail_id", "own_country"], "left")
    own = F.when(F.col("seen_at").isNull() | (F.col("seen_at") > F.col("stop_index")), F.col("own_country"))
    tools = cut_lineage(tools.select(*K, "tool_type", "location", "ticker", "coin", own.alias("own")))
    own = F.col("own")
    tools = draw_earlier(tools, locations, "other_location", seed)
    tools = draw_earlier(tools, countries, "country", seed, extra=own)
    tools = draw_earlier(tools, numbers, "number", seed)
    used = choose_templates(expand_templates(tools, dates, reference_day, seed))

    page_rows = pages.select(
        *K, F.lit("page").alias("stop_type"), F.col("url").alias("page_url"), F.col("description").alias("extraction_target"), F.col("section").alias("extraction_section"),
        F.col("value").alias("value_str"), "value_type", F.lit(None).cast("string").alias("template"), F.lit(None).cast(CHAIN_TYPE).alias("chain"),
    )
    tool_rows = plan.select(*K, "url").join(used, K).select(
        *K, F.lit("tool").alias("stop_type"), F.col("url").alias("page_url"), F.col("template").alias("extraction_target"), F.lit(None).cast("string").alias("extraction_section"),
        F.lit(None).cast("string").alias("value_str"), F.lit("number").alias("value_type"), "template", "chain",
    )
    return reindex(page_rows.unionByName(tool_rows))


# --- index work ----------------------------------------------------------------------------


def reindex(stops: DataFrame) -> DataFrame:
    """Dense numbering by the present order; the former index stays as ``old_index``."""
    return dense_index(stops.withColumnRenamed("stop_index", "old_index"), ["trail_id"], [F.col("old_index")], _bucket("old_index"), "stop_index")


def drop_failed_tools(stops: DataFrame, values: DataFrame) -> DataFrame:
    """Tool stops with a chain get their replayed value; those without one leave; the rest is renumbered.

    ``values(trail_id, stop_index, value)`` has a row for every stop with a chain.
    """
    v = values.select(*K, F.col("value").alias("__v"), F.lit(True).alias("__chained"))
    s = stops.join(v, K, "left")
    tool = (F.col("stop_type") == "tool") & F.coalesce("__chained", F.lit(False))
    kept = s.where(~tool | F.col("__v").isNotNull())
    kept = kept.withColumn("value_str", F.when(tool, F.col("__v")).otherwise(F.col("value_str")))
    return reindex(kept.drop("__v", "__chained"))


def trim(stops: DataFrame, depths: DataFrame) -> DataFrame:
    """Too short trails leave; too long ones lose tool stops from the end, then any from the end.

    ``depths(trail_id, depth_min, depth)``. At most ``depth - 1`` stops stay: all other stops as far as
    they fit, and the first tool stops for what is left.
    """
    sizes = stops.groupBy("trail_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("stop_type") != "tool").alias("others"))
    room = sizes.join(depths, "trail_id").where(F.col("n") + 1 >= F.col("depth_min")).select(
        "trail_id", "n", (F.col("depth") - 1).alias("m"), F.greatest(F.col("depth") - 1 - F.col("others"), F.lit(0)).alias("tools_kept")
    )
    s = stops.join(room, "trail_id").withColumn("is_tool", F.col("stop_type") == "tool")
    short = s.where("n <= m")
    kept = first_upto(s.where("n > m"), ["trail_id", "is_tool"], [F.col("stop_index")], F.when(F.col("is_tool"), F.col("tools_kept")).otherwise(F.col("m")))
    return reindex(short.unionByName(kept).drop("n", "m", "tools_kept", "is_tool"))


def insert_stops(stops: DataFrame, insertions: DataFrame) -> DataFrame:
    """Insert rows after given stops and renumber: ``insertions(trail_id, after, seq, ...)``.

    ``seq`` numbers rows inserted after the same stop from 0. A trail has few insertions (a level's
    maximum), so their places travel as one small array per trail. References of reason stops
    follow their stop; a reference to another reason stop falls back to the stop before.
    """
    # a row per changed trail, of packed files whose bytes say little: never held by every executor
    places = shuffled(insertions.groupBy("trail_id").agg(F.array_sort(F.collect_list("after")).alias("__places")))
    none = F.array().cast("array<bigint>")

    def shifted(index: Column) -> Column:
        return index + F.size(F.filter(F.coalesce("__places", none), lambda a: a < index))

    # the kind of stop a reason refers to decides whether the reference can follow
    if "reason_source_stop" not in stops.columns:
        stops = stops.withColumn("reason_source_stop", F.lit(None).cast("bigint"))
    kinds = stops.select("trail_id", F.col("stop_index").alias("reason_source_stop"), F.col("stop_type").alias("__src_type"))
    s = stops.join(shuffled(kinds), ["trail_id", "reason_source_stop"], "left").join(places, "trail_id", "left")
    new_index = shifted(F.col("stop_index"))
    source = F.when(
        (F.col("stop_type") == "reason") & F.col("reason_source_stop").isNotNull(),
        F.when(F.col("__src_type").isNotNull() & (F.col("__src_type") != "reason"), shifted(F.col("reason_source_stop"))).otherwise(
            F.greatest(F.lit(0), new_index - 1)
        ),
    )
    # new names first: an alias that repeats an input name would be picked up inside the lambdas
    named = s.withColumns({"__new_index": new_index.cast("bigint"), "__new_source": source.cast("bigint")})
    old = named.select(
        "trail_id", F.col("__new_index").alias("stop_index"), F.col("__new_source").alias("reason_source_stop"),
        *[c for c in stops.columns if c not in ("trail_id", "stop_index", "reason_source_stop")],
    )
    new = insertions.join(places, "trail_id").withColumn("__at", shifted(F.col("after")))
    new = new.withColumn("stop_index", (F.col("__at") + 1 + F.col("seq")).cast("bigint"))
    is_reason = F.col("stop_type") == "reason"
    new = new.withColumn("reason_source_stop", F.when(is_reason, F.col("__at")).cast("bigint"))
    return old.unionByName(new.drop("after", "seq", "__at", "__places"), allowMissingColumns=True)


# --- reason stops --------------------------------------------------------------------------


def draw_reasons(stops: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """Reason stops to insert: ``targets(trail_id, target)`` per trail.

    Eligible page and tool stops are drawn first; each then takes its first drawn transform with a
    result other than 0 and 1, or stays without.
    """
    eligible = stops.where("stop_type IN ('page', 'tool')")
    sources = transforms.has_transform(eligible).withColumn("draw", draw_order(seed, "reason", *K))
    sources = sources.select(*K, "page_url", "value_str", "value_type", "draw").join(targets, "trail_id")
    picked = first_upto(sources, ["trail_id"], [F.col("draw"), F.col("stop_index")], F.col("target"))
    # a level's maximum of stops per trail, read for transforms and for their pages
    picked = written(picked.select(*K, "page_url", "value_str", "value_type"), "reason-sources")

    def drawn(name: Column) -> Column:
        return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in K], name, F.lit("transform")))

    best = transforms.first_valid(picked, drawn)
    return best.join(shuffled(picked.select(*K, "page_url")), K).select(
        "trail_id", F.col("stop_index").alias("after"), F.lit(0).alias("seq"), F.lit("reason").alias("stop_type"), "page_url",
        F.col("result").cast("string").alias("value_str"), F.col("result").cast("double").alias("value_num"), F.lit("int").alias("value_kind"),
        F.lit("number").alias("value_type"), F.lit("compute").alias("bridge_type"), F.col("transform").alias("reason_transform"),
    )


def reason_targets(stops: DataFrame, trails: DataFrame) -> DataFrame:
    """Reason stops a trail gets: a third of its stops within the range of its level."""
    n = stops.groupBy("trail_id").agg(F.count(F.lit(1)).alias("n"))
    c = trails.select("trail_id", "level").join(level_config(trails.sparkSession), "level").join(n, "trail_id").where("reason_max > 0")
    target = F.greatest(F.col("reason_min"), F.least(F.col("reason_max"), F.floor(F.col("n") / 3)))
    return c.select("trail_id", target.cast("int").alias("target"))


def insert_reasons(stops: DataFrame, trails: DataFrame, seed: int = 0) -> DataFrame:
    # drawn once: the rows are inserted, and their places shift the others
    return insert_stops(stops, written(draw_reasons(stops, reason_targets(stops, trails), seed), "reasons"))


# --- bridges and compute stop ----------------------------------------------------------------


def build_bridges(stops: DataFrame, links: DataFrame, pages: DataFrame) -> DataFrame:
    """Bridge from each stop to the next: ``links(url, target_url)``, ``pages(url, title)``.

    Tool and reason stops keep theirs, and so does the last stop. The next stop is found by
    an equi-join on its index.
    """
    nxt = stops.select("trail_id", (F.col("stop_index") - 1).alias("stop_index"), F.col("page_url").alias("next_url"), F.lit(True).alias("has_next"))
    direct = links.select(F.col("url").alias("page_url"), F.col("target_url").alias("next_url")).distinct().withColumn("linked", F.lit(True))
    titles = pages.select(F.col("url").alias("next_url"), "title").distinct()
    # only stops with a next page look it up: the others share no key and would meet in one task
    s = stops.join(nxt, K, "left")
    paged = s.where("next_url <> ''").join(direct, ["page_url", "next_url"], "left").join(titles, "next_url", "left")
    s = paged.unionByName(s.where("next_url IS NULL OR next_url = ''"), allowMissingColumns=True)
    open_end = F.coalesce(F.col("has_next"), F.lit(False)) & ~F.col("stop_type").isin("tool", "reason")
    to_page = F.coalesce(F.col("next_url"), F.lit("")) != ""
    linked = F.col("linked").isNotNull()
    kept = [c for c in stops.columns if c not in ("bridge_type", "target_url", "search_query", "expected_result_url")]

    def value(new: Column, old: str) -> Column:
        stored = F.col(old) if old in stops.columns else F.lit(None).cast("string")
        return F.when(open_end, new).otherwise(stored).alias(old)

    return s.select(
        *kept,
        value(F.when(to_page & ~linked, "search_query").otherwise("link_follow"), "bridge_type"),
        value(F.when(to_page & linked, F.col("next_url")), "target_url"),
        value(F.when(to_page & ~linked, F.concat(F.coalesce("title", "next_url"), F.lit(" wikipedia"))), "search_query"),
        value(F.when(to_page & ~linked, F.col("next_url")), "expected_result_url"),
    )


def compute_stops(stops: DataFrame, seed: int = 0) -> DataFrame:
    """Final digit of each trail with two or more integer values.

    Two to four values are drawn and put in stop order; one of three expressions gives the digit.
    """
    content = stops.where("stop_type IN ('page', 'tool', 'reason')")
    n = content.groupBy("trail_id").agg(F.count(F.lit(1)).alias("n"))
    usable = content.select(*K, int_view(F.col("value_str")).alias("v")).where("v IS NOT NULL").withColumn("draw", draw_order(seed, "compute", *K))
    drawn = first_per_key(usable, ["trail_id"], [F.col("draw"), F.col("stop_index")], 4)
    # four rows per trail at most are left
    ranked = drawn.withColumn("rk", F.row_number().over(Window.partitionBy("trail_id").orderBy("draw", "stop_index")))
    wanted = 2 + F.pmod(draw_int(seed, "compute_n", "trail_id"), F.lit(3))
    picked = ranked.where(F.col("rk") <= wanted).groupBy("trail_id").agg(F.array_sort(F.collect_list(F.struct("stop_index", "v"))).alias("picked"))
    vals = F.col("picked.v")
    total = F.array_join(F.transform(vals, lambda v: v.cast("string")), " + ")
    kind = F.pmod(draw_int(seed, "compute_kind", "trail_id"), F.lit(3))
    expression = (
        F.when(kind == 0, F.concat(F.lit("digital_root("), total, F.lit(")")))
        .when(kind == 1, F.concat(F.lit("("), total, F.lit(") % 10")))
        .otherwise(F.concat(F.lit("abs("), F.get(vals, 0).cast("string"), F.lit(" - "), F.get(vals, 1).cast("string"), F.lit(") % 10")))
    )
    digit = F.when(kind == 0, nums.digit_digital_root(vals)).when(kind == 1, nums.digit_mod10(vals)).otherwise(nums.digit_abs_diff(vals))
    return picked.where(F.size("picked") >= 2).join(n, "trail_id").select(
        "trail_id", F.col("n").alias("stop_index"), F.lit("compute").alias("stop_type"), digit.cast("string").alias("value_str"), digit.cast("double").alias("value_num"),
        F.lit("int").alias("value_kind"), F.lit("number").alias("value_type"), F.lit("compute").alias("bridge_type"), expression.alias("expression"), F.col("picked.stop_index").alias("referenced_stops"),
    )


def with_compute(stops: DataFrame, seed: int = 0) -> DataFrame:
    """Stops with a rebuilt compute stop at the end (none where the values do not suffice)."""
    return stops.where("stop_type <> 'compute'").unionByName(compute_stops(stops, seed).drop("referenced_stops"), allowMissingColumns=True)


def roll_up(stops: DataFrame) -> DataFrame:
    """Depth, counts, extraction difficulty, bridge obscurity and passcode of each trail."""
    page, section = F.col("stop_type") == "page", F.col("extraction_section")
    cross = page & F.contains(F.lower(section), F.lit("cross"))
    prose = page & (section != "") & (section != "infobox")
    g = stops.groupBy("trail_id").agg(
        F.count(F.lit(1)).alias("depth"), F.count_if(F.col("stop_type") == "tool").alias("tool_stop_count"), F.count_if(F.col("stop_type") == "reason").alias("reason_stop_count"),
        F.coalesce(F.max(cross), F.lit(False)).alias("cross"), F.coalesce(F.max(prose), F.lit(False)).alias("prose"),
        F.coalesce(F.max(F.col("bridge_type") == "search_query"), F.lit(False)).alias("search"), F.max_by(F.struct("stop_type", "value_str"), "stop_index").alias("last"),
    )
    code = F.when(F.col("last.stop_type") == "compute", F.pmod(int_view(F.col("last.value_str")), F.lit(10)))
    return g.select(
        "trail_id", "depth", "tool_stop_count", "reason_stop_count",
        F.when(F.col("cross"), "cross_section").when(F.col("prose"), "prose").otherwise("infobox").alias("extraction_difficulty"),
        F.when(F.col("search"), "search").otherwise("direct_link").alias("bridge_obscurity"), F.coalesce(code, F.lit(-1)).cast("bigint").alias("passcode"),
    )
