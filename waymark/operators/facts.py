"""Fact jobs and page-level normalisation.

Facts: ``(url, pos, description, section, value, value_type, confidence, source_tier)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark import fixed
from waymark.functions.skew import ARRAY_ROWS, dense_index, draw_int, first_per_key, hot_keys, join_counted, running_sum, shuffled, with_earlier
from waymark.functions.text import clean_markdown, strip, strip_chars, unfence, unquote, words
from waymark.functions.values import close, let, number_text, parse_date, to_float
from waymark.operators.dims import table, texts

# --- extraction ----------------------------------------------------------------------------


def infobox_facts(page_info: DataFrame) -> DataFrame:
    """Typed facts of infobox fields; a pattern whose value type does not fit passes the field on."""

    def fact(f: Column) -> Column:
        key, num = f["key"], f["numeric_value"]
        text_ok = strip(strip_chars(strip(f["value"]), "|")) != ""
        options = []
        for pattern, kind, description in fixed.FACT_PATTERNS:
            fits = F.rlike(key, F.lit(f"(?i){pattern}")) & (num.isNotNull() if kind == "number" else text_ok)
            value = number_text(num) if kind == "number" else f["value"]
            options.append(F.when(fits, F.struct(F.lit(kind).alias("value_type"), F.lit(description).alias("about"), value.alias("value"))))
        clean_key = F.when(F.contains(key, F.lit("geohack")), strip(F.substring_index(key, ":", 1))).otherwise(key)
        return let(F.coalesce(*options), lambda o: F.struct(
            F.concat(o["about"], F.lit(" (field: '"), clean_key, F.lit("')")).alias("description"),
            o["value"].alias("value"), o["value_type"].alias("value_type"), f["value"].alias("field_value"),
        ))

    facts = F.filter(F.transform("infobox", fact), lambda x: x["value_type"].isNotNull())
    # the outer form keeps Spark from working the array out a second time, for a filter on its size
    return page_info.select("url", F.posexplode_outer(facts).alias("pos", "f")).where("pos IS NOT NULL").select(
        "url", "pos", "f.*", F.lit("infobox").alias("section"), F.lit(1.0).alias("confidence"), F.lit("infobox").alias("source_tier")
    )


_ITEM = "struct<description:variant,section:variant,value:variant,value_type:variant>"


def parse_replies(replies: DataFrame, max_facts: int = 10) -> DataFrame:
    """Facts in model replies (a JSON list, possibly fenced): ``replies(url, reply)``.

    Only the first ``max_facts`` items of a reply are read; ``reply`` tables may carry their own
    ``max_items``. Items without description or value are dropped; odd types become text.
    """
    limit = F.col("max_items") if "max_items" in replies.columns else F.lit(max_facts)
    items = F.try_variant_get(F.try_parse_json(unfence(F.col("reply"))), "$", "array<variant>")
    rows = replies.select("url", F.posexplode(items).alias("pos", "item"), limit.alias("__limit")).where("pos < __limit")

    def field(name: str) -> Column:
        return F.try_variant_get("item", f"$.{name}", "string")

    kind = F.when(field("value_type").isin(fixed.VALUE_TYPES), field("value_type")).otherwise("text")
    confidence = F.when(kind == "number", 0.8).when(kind == "date", 0.75).otherwise(0.6)
    # an absent type defaults to text, an absent value drops the item
    return rows.where(field("description").isNotNull() & (field("description") != "") & field("value").isNotNull()).select(
        "url", "pos", field("description").alias("description"), field("section").alias("section"),
        field("value").alias("value"), kind.alias("value_type"), confidence.alias("confidence"), F.lit("prose").alias("source_tier"),
    )


def rank_facts(infobox: DataFrame, prose: DataFrame, max_facts: int = 10) -> DataFrame:
    """Best facts per page: infobox first; prose only fills up to ``max_facts``; numbers win ties."""
    boxed = infobox.groupBy("url").agg(F.count(F.lit(1)).alias("boxed"))
    room = max_facts - F.coalesce("boxed", F.lit(0))
    filler = prose.join(boxed, "url", "left").where(F.col("pos") < room).drop("boxed")
    cols = ["url", "pos", "description", "section", "value", "value_type", "confidence", "source_tier"]
    both = infobox.select(*cols, F.lit(0).alias("tier")).unionByName(filler.select(*cols, F.lit(1).alias("tier")))
    order = [F.col("confidence").desc(), (F.col("value_type") == "number").desc(), F.col("tier"), F.col("pos")]
    kept = first_per_key(both, ["url"], order, max_facts)
    # at most max_facts rows per page are left here
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("url").orderBy(*order))).drop("tier")


def facts_match(a: Column, b: Column, value_type: Column) -> Column:
    """Compare of two extractions of one fact; nulls never match."""
    digits = F.regexp_replace(F.replace(a, F.lit(","), F.lit("")), r"[^\d.\-+]", "")
    number = F.when(to_float(digits).isNotNull(), digits).otherwise(a)
    same = F.lower(strip(a)) == F.lower(strip(b))
    return F.coalesce(F.when(a.isNotNull() & b.isNotNull(), F.when(value_type == "number", close(number, b)).otherwise(same)), F.lit(False))


def agreement(facts: DataFrame, trials: DataFrame, num_trials: int = 3) -> DataFrame:
    """Share of re-extractions that agree: ``trials(url, pos, extracted)``; infobox facts count as 1."""
    hits = (
        trials.join(facts.select("url", "pos", "value", "value_type"), ["url", "pos"])
        .groupBy("url", "pos")
        .agg(F.count_if(facts_match(F.col("extracted"), F.col("value"), F.col("value_type"))).alias("hits"))
    )
    sure = (F.col("source_tier") == "infobox") & (F.col("confidence") >= 1.0)
    score = F.when(sure, 1.0).otherwise(F.coalesce("hits", F.lit(0)) / num_trials)
    return facts.join(hits, ["url", "pos"], "left").select("url", "pos", score.alias("agreement"))


def hint_scores(hints: DataFrame, facts: DataFrame) -> DataFrame:
    """Every fact of the hinted page with the words it shares with the hint, plus 0.5 for numbers."""
    shared = F.size(F.array_intersect(words(F.lower("hint")), words(F.lower("description"))))
    score = shared + F.when(F.col("value_type") == "number", 0.5).otherwise(0.0)
    return hints.join(shuffled(facts), "url").withColumn("score", F.when(F.coalesce("hint", F.lit("")) != "", score))


def best_facts(hints: DataFrame, facts: DataFrame) -> DataFrame:
    """Best fact per hint, first one on ties: ``hints(hint_id, url, hint)``; blank hints match nothing."""
    scored = hint_scores(hints.select("url", "hint").distinct(), facts).where("score IS NOT NULL")
    best = first_per_key(scored, ["url", "hint"], [F.col("score").desc(), F.col("pos")])
    # stops that put one hint to one page share its fact; blank hints have no score, so no hint is null here
    return join_counted(hints, best, ["url", "hint"])


def choose_facts(hints: DataFrame, facts: DataFrame) -> DataFrame:
    """Fact of each planned stop: best one for the hint, else the first; cleaned; blank ones give way.

    ``hints(trail_id, hint_id, url, hint)``. A trail with a stop that has no usable fact is dropped.
    """
    # stops that put one hint to one page share its fact; no hint counts as a blank one, which has no score
    asked = hints.select("url", F.coalesce("hint", F.lit("")).alias("asked"))
    cleaned = hint_scores(asked.distinct().withColumnRenamed("asked", "hint"), facts).withColumn("value", clean_markdown(F.col("value")))
    # the best match leads only while its own value is usable; the others follow in fact order
    place = F.struct("pos", *[c for c in facts.columns if c not in ("url", "pos")])
    usable = strip(F.col("value")) != ""
    best = F.max_by(F.struct(place.alias("fact"), usable.alias("usable")), F.struct("score", (-F.col("pos")).alias("back")))
    picked = cleaned.groupBy("url", "hint").agg(
        F.when(F.max("score").isNotNull(), best).alias("lead"), F.min_by(F.when(usable, place), F.when(usable, F.col("pos"))).alias("first")
    )
    fact = F.when(F.col("lead.usable"), F.col("lead.fact")).otherwise(F.col("first"))
    picked = picked.select("url", F.col("hint").alias("asked"), fact.alias("fact")).where("fact IS NOT NULL")
    chosen = join_counted(hints.withColumn("asked", F.coalesce("hint", F.lit(""))), picked, ["url", "asked"], "left").drop("asked")
    failed = chosen.where("fact IS NULL").select("trail_id").distinct()
    return chosen.join(shuffled(failed), "trail_id", "left_anti").select(*hints.columns, "fact.*")


# --- verification against page text ----------------------------------------------------------


def section_text(markdown: Column, section: Column) -> Column:
    """Text from a heading (any case) to the next heading; the whole text when there is none."""
    quoted = F.concat(F.lit(r"(?imdU)^#{1,6}\s+\Q"), section, F.lit(r"\E\s*$([\s\S]*)"))
    after = F.regexp_substr(markdown, quoted)
    body = F.regexp_replace(after, r"\A[^\n]*", "")
    cut = F.split(body, r"(?mdU)^#{1,6}\s+", 2)[0]
    return F.coalesce(cut, markdown)


NUMBER = r"[-+]?[\d,]+\.?\d*"
COORDINATES = r"(-?\d+\.?\d*)\s*[°,]\s*(-?\d+\.?\d*)"

#: Width of the buckets of numbers, on the scale of :func:`_bucket`, and values of a page that travel in one array.
WIDTH = 0.0102
VALUES_PER_ARRAY = 256


def find_text(text: Column, expected: Column, value_type: Column) -> Column:
    """A stored value that is no number as found again in a text, null when it is not there; coordinates are ``[lat, lon]`` texts."""
    s = strip(expected)
    as_text = F.when(F.contains(F.lower(text), F.lower(s)), s)
    tail = F.element_at(F.split(s, "/wiki/"), -1)
    as_url = F.when(F.contains(text, s) | (F.contains(s, F.lit("/wiki/")) & F.contains(text, tail)), s)
    year = F.regexp_extract(s, r"\b(\d{4})\b", 1)
    as_date = F.when(F.contains(text, s) | ((year != "") & F.contains(text, year)), s)
    lat, lon = (F.regexp_extract(s, r"^\[\s*(-?[\d.]+)\s*,\s*(-?[\d.]+)\s*\]$", g).try_cast("double") for g in (1, 2))
    lats, lons = (F.transform(F.regexp_extract_all(text, F.lit(COORDINATES), F.lit(g)), lambda m: m.try_cast("double")) for g in (1, 2))
    hits = F.filter(
        F.zip_with(lats, lons, lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        lambda p: F.coalesce((F.abs(p["a"] - lat) < 0.01) & (F.abs(p["b"] - lon) < 0.01), F.lit(False)),
    )
    as_coords = let(F.get(hits, 0), lambda p: F.concat(F.lit("["), p["a"].cast("string"), F.lit(", "), p["b"].cast("string"), F.lit("]")))
    return F.when(value_type == "url", as_url).when(value_type == "date", as_date).when(value_type == "coords", as_coords).otherwise(as_text)


def _bucket(x: Column) -> Column:
    """Number of the bucket of a number. A number within 1 % of another (within 0.01 below 1) is in its bucket or a neighbouring one.

    The scale is sign * log(1 + size): the slope is below 1 / size and below 1, so such a distance is below ``WIDTH`` on it.
    """
    return F.floor(F.signum(x) * F.log1p(F.abs(x)) / WIDTH)


def _find_numbers(asked: DataFrame, texts: DataFrame, place: list[str]) -> DataFrame:
    """(place, value_str, found): the first number of the text within 1 %, for the numbers in ``asked``.

    The numbers of a text are read once, and meet the sought ones in an equi-join on (place, bucket), so that neither the text nor the
    numbers of a page travel with every stop that names the page.
    """
    said = texts.select(*place, F.posexplode(F.regexp_extract_all("text", F.lit(NUMBER), F.lit(0))).alias("pos", "said"))
    numbers = said.select(*place, "pos", to_float(F.replace("said", F.lit(","), F.lit(""))).alias("x")).where(F.col("x").isNotNull())
    first = numbers.groupBy(*place, "x").agg(F.min("pos").alias("pos")).withColumn("bucket", _bucket(F.col("x")))
    want, x = F.col("want"), F.col("x")
    wanted = asked.select(*place, "value_str", to_float(F.col("value_str")).alias("want")).where(~F.isnan("want") & (F.abs("want") < float("inf")))
    wanted = wanted.withColumn("bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: _bucket(want) + d)))
    near = F.when(want == 0, x == 0).otherwise(F.abs(x - want) / F.greatest(F.abs(want), F.lit(1.0)) < 0.01)
    hits = wanted.join(shuffled(first), [*place, "bucket"]).where(near)
    return hits.groupBy(*place, "value_str").agg(number_text(F.min_by("x", "pos")).alias("found"))


def look_up(stops: DataFrame, pages: DataFrame, strict: bool = False) -> DataFrame:
    """``stops`` with ``there`` (the page exists) and ``found``, the stored value as its page has it (null when it doesn't).

    Numbers give the first number within 1 %. The whole page is searched; ``strict`` restricts the search to the stop's section. Each
    different value is looked for once per page, and a page's text is joined to arrays of such values, never to the stops. Pages
    with one url count as one. Texts and their numbers are never held by every executor, the urls of pages only when counted as few.
    """
    section = F.coalesce(F.col("extraction_section"), F.lit("")) if strict else F.lit("")
    s = stops.withColumn("part", F.when(section == "infobox", "").otherwise(section))
    place = ["page_url", "part"]
    asked = s.where("page_url IS NOT NULL").select(*place, "value_type", "value_str").distinct()
    texts = asked.select(*place).distinct().join(shuffled(pages.select(F.col("url").alias("page_url"), "markdown").where("markdown IS NOT NULL")), "page_url")
    texts = texts.select(*place, F.when(F.col("part") != "", section_text(F.col("markdown"), F.col("part"))).otherwise(F.col("markdown")).alias("text"))
    is_number = F.coalesce(F.col("value_type") == "number", F.lit(False)) & F.col("value_str").isNotNull()
    numbers = _find_numbers(asked.where(is_number), texts, place).withColumn("value_type", F.lit("number"))

    others = asked.where(~is_number)
    parts = others.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / VALUES_PER_ARRAY).alias("parts")).where("parts > 1")
    dealt = join_counted(others, parts, place, "left").withColumn("array", F.pmod(F.xxhash64("value_str"), F.coalesce("parts", F.lit(1).cast("bigint"))))
    arrays = dealt.groupBy(*place, "array").agg(F.collect_list(F.struct("value_type", "value_str")).alias("values"))
    each = F.transform("values", lambda v: F.struct(v["value_type"].alias("value_type"), v["value_str"].alias("value_str"), find_text(F.col("text"), v["value_str"], v["value_type"]).alias("found")))
    rest = arrays.join(shuffled(texts), place).select(*place, F.inline(each)).groupBy(*place, "value_type", "value_str").agg(F.max("found").alias("found"))

    known = numbers.unionByName(rest, allowMissingColumns=True).where("found IS NOT NULL").select(*[F.col(c).alias(f"__{c}") for c in (*place, "value_type", "value_str")], "found")
    there = pages.where("markdown IS NOT NULL").select(F.col("url").alias("page_url")).distinct().withColumn("there", F.lit(True))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*place, "value_type", "value_str")]
    out = join_counted(s, there, ["page_url"], "left").join(shuffled(known), same, "left")
    return out.select(*stops.columns, F.coalesce("there", F.lit(False)).alias("there"), "found")


def verify_values(stops: DataFrame, pages: DataFrame, strict: bool = False) -> DataFrame:
    """Stored values of the page stops whose pages exist, looked up in them: ``pages(url, markdown)``; see :func:`look_up`."""
    return look_up(stops, pages, strict).where("there").select("trail_id", "stop_index", "value_type", "value_str", "found")


# --- normalisation -------------------------------------------------------------------------


def is_geocodable(name: Column) -> Column:
    """Likely a place: place words allow, organisation words deny, person-like names are denied."""

    def judge(n: Column) -> Column:
        low, ws = F.lower(n), words(n)
        place = F.exists(texts(fixed.PLACE_WORDS), lambda k: F.contains(low, k))
        other = F.exists(texts(fixed.NON_PLACE_WORDS), lambda k: F.contains(low, k))
        particle = F.exists(texts(fixed.PLACE_PARTICLES), lambda k: F.contains(low, k))
        capital = F.forall(ws, lambda w: ~F.rlike(w, F.lit(r"^\p{L}")) | F.rlike(w, F.lit(r"^\p{Lu}")))
        short = F.forall(ws, lambda w: F.length(w) < 15)
        count = F.size(ws)
        person = (count >= 2) & (count <= 4) & ~F.contains(n, F.lit(",")) & capital & ~particle & short
        return (F.length(n) >= 2) & (place | (~other & ~person))

    return let(F.coalesce(name, F.lit("")), judge)


def _head(value: Column) -> Column:
    """Part before the first comma."""
    return strip(F.substring_index(value, ",", 1))


def _first_field(box: Column, keep, value) -> Column:
    """First non-null result of ``value`` over the fields that ``keep`` accepts."""
    return F.get(F.filter(F.transform(F.filter(box, keep), value), lambda v: v.isNotNull()), 0)


def page_location(box: Column, title: Column) -> Column:
    def keep(f: Column) -> Column:
        low = F.replace(F.lower(f["key"]), F.lit(" "), F.lit("_"))
        base = strip(strip_chars(F.substring_index(low, ":", 1), "_"))
        return base.isin(fixed.LOCATION_KEYS) | low.isin(fixed.LOCATION_KEYS)

    def value(f: Column) -> Column:
        return let(_head(clean_markdown(f["value"])), lambda v: F.when((v != "") & is_geocodable(v), v))

    prefix = "^(" + "|".join(fixed.COORDINATE_PREFIXES) + ")"
    has_coords = F.exists(box, lambda f: F.rlike(F.lower(f["key"]), F.lit(prefix)))
    by_title = let(clean_markdown(title), lambda t: F.when(has_coords & (F.length(title) < 50) & is_geocodable(t), t))
    plain = F.when((F.length(title) < 40) & ~F.contains(title, F.lit("(")) & is_geocodable(title), title)
    return F.coalesce(_first_field(box, keep, value), by_title, plain)


def _clean_key(f: Column) -> Column:
    return strip(F.lower(clean_markdown(f["key"])))


def page_country(box: Column) -> Column:
    return _first_field(box, lambda f: _clean_key(f).isin(fixed.COUNTRY_KEYS), lambda f: _head(clean_markdown(f["value"])))


def page_ticker(box: Column) -> Column:
    def keep(f: Column) -> Column:
        return F.replace(_clean_key(f), F.lit(" "), F.lit("_")).isin(fixed.TICKER_KEYS)

    def value(f: Column) -> Column:
        def read(raw: Column) -> Column:
            listed = F.nullif(F.regexp_extract(raw, fixed.EXCHANGE, 1), F.lit(""))
            word = F.nullif(F.regexp_extract(raw, r"(?U)\b([A-Z]{1,5})\b", 1), F.lit(""))
            return F.coalesce(listed, F.when(~word.isin(fixed.NOT_TICKERS), word))

        return let(F.upper(clean_markdown(f["value"])), read)

    return _first_field(box, keep, value)


def page_coin(box: Column, title: Column) -> Column:
    low = F.lower(title)
    by_title = F.coalesce(*[F.when(F.contains(low, F.lit(name)), pair) for name, pair in fixed.COIN_PAIRS.items()])

    def value(f: Column) -> Column:
        pair = let(strip(F.upper(clean_markdown(f["value"]))), lambda r: F.when(F.rlike(r, F.lit(r"^\p{L}{2,6}$")), F.concat(r, F.lit("USDT"))))
        return let(pair, lambda p: F.when(p.isin(list(fixed.COIN_PAIRS.values())), p))

    return F.coalesce(by_title, _first_field(box, lambda f: _clean_key(f).isin(fixed.COIN_KEYS), value))


def page_entities(page_info: DataFrame) -> DataFrame:
    """Location, country, ticker and coin pair of each page."""
    box, title = F.col("infobox"), F.col("title")
    return page_info.select(
        "url", page_location(box, title).alias("location"), page_country(box).alias("country"),
        page_ticker(box).alias("ticker"), page_coin(box, title).alias("coin"),
    )


def title_place(url: Column) -> Column:
    """Title of a page URL without a closing parenthesis; null when shorter than two characters."""
    title = F.replace(unquote(F.element_at(F.split(url, "/wiki/"), -1)), F.lit("_"), F.lit(" "))
    plain = F.regexp_replace(title, r"(?U)\s*\(.*?\)\s*$", "")
    return F.when(F.contains(url, F.lit("/wiki/")) & (F.length(plain) >= 2), plain)


def stop_places(stops: DataFrame) -> DataFrame:
    """Location and country of each stop, from its text value or its page title."""
    text = F.when(F.col("value_type") == "text", F.nullif(strip(F.col("value_str")), F.lit("")))
    s = stops.withColumn("__text", text).withColumn("__title", title_place(F.col("page_url")))
    location = F.coalesce(F.when(is_geocodable(F.col("__text")) & (F.length("__text") < 60), F.col("__text")), F.col("__title"))
    countries = table(stops.sparkSession, [(c,) for c in fixed.KNOWN_COUNTRIES], "known string")
    by_title = countries.withColumnRenamed("known", "title_country")
    by_text = countries.withColumnRenamed("known", "text_country")
    s = s.join(by_title, F.col("__title") == F.col("title_country"), "left").join(by_text, F.col("__text") == F.col("text_country"), "left")
    return s.withColumn("location", location).withColumn("country", F.coalesce("title_country", "text_country")).drop(
        "__text", "__title", "title_country", "text_country"
    )


def date_rules(spark) -> DataFrame:
    rows = [(n, "|".join(keys), year, suffix, default) for n, keys, year, suffix, default in fixed.TOOL_DATES]
    return table(spark, rows, "template string, keys string, year_pattern string, suffix string, fallback string")


def tool_dates(stops: DataFrame, pages: DataFrame, earlier: DataFrame, seed: int = 0) -> DataFrame:
    """One drawn day per stop and dated tool template, and the number of days it was drawn from.

    ``stops(trail_id, stop_index, url)``, ``pages(url, infobox, first_paragraph)``,
    ``earlier(trail_id, stop_index, day)`` days found at stops of the trail. Candidates, in this order:
    days of earlier stops, days in fitting infobox fields, the year in the lead with a fixed
    day, else the fixed day of market templates. A drawn earlier day is fetched by its ordinal in
    the trail, so stops and earlier days are never multiplied out: from the trail's array of days, or by a join where a trail has many.
    Only pages that stops name are read for days. Both inputs of stops are read several times.
    """
    key, at = ["trail_id"], F.floor(F.col("stop_index") / 1024)
    earlier = earlier.select("trail_id", "stop_index", "day")
    hot = hot_keys(earlier, key, ARRAY_ROWS)
    few, few_days = (stops, earlier) if hot is None else (df.join(shuffled(hot), key, "left_anti") for df in (stops, earlier))
    no_days = F.array().cast("array<date>")
    asked = with_earlier(few.select("trail_id", "stop_index", "url"), few_days, "day").withColumn("days", F.coalesce("__all.day", no_days)).drop("__all")
    if hot is not None:
        many, many_days = (df.join(shuffled(hot), key, "left_semi") for df in (stops, earlier))
        marks = many.select("trail_id", "stop_index", "url", F.lit(0).alias("is_day")).unionByName(
            many_days.select("trail_id", "stop_index", F.lit(None).cast("string").alias("url"), F.lit(1).alias("is_day"))
        )
        # at equal stop_index the stop comes before its own day
        counted = running_sum(marks, key, [F.col("stop_index"), F.col("is_day")], at, F.col("is_day"), "n_before").where("is_day = 0")
        asked = asked.unionByName(counted.select("trail_id", "stop_index", "url", "n_before", F.lit(None).cast("array<date>").alias("days")))

    rules = date_rules(stops.sparkSession)
    # nine fixed rules per page; the days of a page stay in its row
    fields = F.filter("infobox", lambda f: F.rlike(F.lower(f["key"]), F.col("keys")))
    days = F.array_compact(F.transform(fields, lambda f: parse_date(f["value"])))
    year = F.regexp_substr("first_paragraph", F.col("year_pattern"))
    in_lead = F.concat(year, F.col("suffix")).try_cast("date")
    own = join_counted(pages, stops.select("url").distinct(), ["url"], "left_semi").join(rules).select(
        "url", "template", F.concat(days, F.array_compact(F.array(in_lead))).alias("own"), F.col("fallback").try_cast("date").alias("fallback")
    )
    n = F.col("n_before") + F.size("own")
    rows = join_counted(asked, own, ["url"]).withColumn("n", n).withColumn(
        "pick", F.when(n > 0, F.pmod(draw_int(seed, "date", "trail_id", "stop_index", "template"), n))
    )
    drawn = rows.where("days IS NOT NULL").withColumn("earlier_day", F.get("days", F.col("pick").cast("int")))
    if hot is not None:
        numbered = dense_index(many_days, key, [F.col("stop_index"), F.col("day")], at, "ord")
        numbered = numbered.select("trail_id", F.col("ord").alias("pick"), F.col("day").alias("earlier_day"))
        drawn = drawn.unionByName(rows.where("days IS NULL").join(shuffled(numbered), ["trail_id", "pick"], "left"))
    day = F.when(n == 0, F.col("fallback")).when(F.col("pick") < F.col("n_before"), F.col("earlier_day")).otherwise(
        F.get("own", (F.col("pick") - F.col("n_before")).cast("int"))
    )
    return drawn.select("trail_id", "stop_index", "template", F.col("n").alias("candidates"), day.alias("day")).where("day IS NOT NULL")
