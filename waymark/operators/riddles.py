"""Riddle quality: title leaks, round-trip plans, alignment, implied digits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark import fixed
from waymark.functions.skew import counted, first_per_key, kept_here
from waymark.functions.text import drop_final_parenthesis, strip, tail_title, unfence
from waymark.session import written

K = ["trail_id", "stop_index"]


def forbidden_titles(stops: DataFrame) -> DataFrame:
    """Titles a riddle must not name: pages of all stops but the first, longer than three characters."""
    titled = stops.where("stop_index <> 0 AND page_url <> ''").select(*K, "page_url", _any_title(F.col("page_url")).alias("title"))
    return titled.where(F.length("title") > 3)


def _any_title(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("/wiki/")), tail_title(url)).otherwise(F.replace(url, F.lit("_"), F.lit(" ")))


def leaks_strict(stops: DataFrame, riddles: DataFrame) -> DataFrame:
    """Stops whose exact title stands in the riddle, any case; the first stop may be named."""
    titled = stops.where("stop_index <> 0 AND page_url <> ''").select(*K, _any_title(F.col("page_url")).alias("title"))
    low = riddles.select("trail_id", F.lower("riddle").alias("low"))
    return titled.join(low, "trail_id").where(F.contains("low", F.lower("title"))).drop("low")


def corpus_leaks(riddles: DataFrame, stops: DataFrame) -> DataFrame:
    """Leaked titles of seed (index -1) and stops: six characters, closing parenthesis cut, first of equal titles."""
    seeds = riddles.select("trail_id", F.lit(-1).cast("bigint").alias("stop_index"), F.col("seed_title").alias("title"))
    pages = stops.where("page_url LIKE '%/wiki/%'").select(*K, tail_title(F.col("page_url")).alias("title"))
    rows = seeds.unionByName(pages).where(F.length("title") >= 6).withColumn("needle", F.lower(drop_final_parenthesis(F.col("title"))))
    low = riddles.where("riddle <> ''").select("trail_id", F.lower("riddle").alias("low"))
    hits = rows.where(F.length("needle") >= 6).join(low, "trail_id").where(F.contains("low", F.col("needle"))).select(*K, "title")
    return first_per_key(hits.withColumn("k", F.lower("title")), ["trail_id", "k"], [F.col("stop_index")]).drop("k")


def leak_report(riddles: DataFrame, leaks: DataFrame) -> DataFrame:
    per = leaks.groupBy("trail_id").agg(F.count(F.lit(1)).alias("leaks"))
    t = riddles.select("trail_id", "level").join(per, "trail_id", "left")
    return t.groupBy("level").agg(F.count(F.lit(1)).alias("trails"), F.count("leaks").alias("with_leaks"), F.coalesce(F.sum("leaks"), F.lit(0)).alias("leaks"))


def accept_rewrites(before: DataFrame, rewritten: DataFrame, stops: DataFrame) -> DataFrame:
    """Verdict per leaking trail: ``fixed`` (no leak left), ``partial`` (fewer), ``kept`` (no better)."""
    def count(df: DataFrame, name: str) -> DataFrame:
        return corpus_leaks(df, stops).groupBy("trail_id").agg(F.count(F.lit(1)).alias(name))

    both = count(before, "old").join(count(rewritten, "new"), "trail_id", "left").fillna(0, ["new"])
    verdict = F.when(F.col("new") == 0, "fixed").when(F.col("new") < F.col("old"), "partial").otherwise("kept")
    return both.select("trail_id", F.col("old").alias("leaks_before"), F.col("new").alias("leaks_after"), verdict.alias("verdict"))


def plan_steps(plans: DataFrame) -> DataFrame:
    """Steps of round-trip plans (a JSON list, possibly fenced): ``plans(trail_id, reply)``."""
    items = F.try_variant_get(F.try_parse_json(unfence(F.col("reply"))), "$", "array<variant>")
    # the outer form keeps Spark from parsing a reply a second time, for a filter on its size
    rows = plans.select("trail_id", F.posexplode_outer(items).alias("pos", "item")).where("pos IS NOT NULL")
    return rows.select("trail_id", "pos", *[F.coalesce(F.try_variant_get("item", f"$.{f}", "string"), F.lit("")).alias(f) for f in fixed.PLAN_FIELDS])


def trail_tool_types(stops: DataFrame, chain: DataFrame) -> DataFrame:
    """Distinct kinds of tools a trail needs: ``chain`` with ``output_key`` and ``args``."""
    name, args = F.col("tool_name"), F.col("args")

    def has(word: str) -> Column:
        return F.contains(name, F.lit(word))

    select = F.coalesce(F.try_element_at(args, F.lit("select")), F.lit(""))
    code = F.coalesce(F.try_element_at(args, F.lit("code")), F.lit(""))
    kind = (
        F.when(has("elevation"), "elevation")
        .when(has("weather"), F.when(F.contains(select, F.lit("snowfall")), "snowfall").when(F.contains(select, F.lit("sunshine")), "sunshine").otherwise("weather"))
        .when(has("distance"), "distance")
        .when(has("directions"), "directions")
        .when(has("search_places"), F.when(F.contains("output_key", F.lit("rating")), "rating").otherwise("places"))
        .when(has("countries_population"), "population")
        .when(has("countries_area"), "area")
        .when(has("python"), F.when(F.contains(F.lower(code), F.lit("convert")) | F.contains(code, F.lit("* ")), "conversion").otherwise("computation"))
    )
    tools = stops.where("stop_type = 'tool'").select(*K)
    by_tool = chain.join(tools, K, "left_semi").select("trail_id", kind.alias("kind")).where("kind IS NOT NULL")
    by_type = stops.where("stop_type IN ('reason', 'compute')").select("trail_id", F.when(F.col("stop_type") == "reason", "reasoning").otherwise("computation").alias("kind"))
    return by_tool.unionByName(by_type).distinct()


def _names_any(text: Column, words: list[str]) -> Column:
    """Whether a text has one of the words anywhere in it."""
    return F.rlike(text, F.lit("|".join(rf"\Q{w}\E" for w in words)))


def _named_kinds(steps: DataFrame) -> DataFrame:
    """Steps with ``named``, the kinds of tools that their method and aim name."""
    text = kept_here(F.concat(F.lower("tool_or_method"), F.lit(" "), F.lower("what_to_find")))
    hits = [F.when(_names_any(F.col("__text"), words), F.lit(kind)) for kind, words in fixed.TOOL_WORDS.items()]
    return steps.withColumn("__text", text).withColumn("named", F.array_compact(F.array(*hits))).drop("__text")


def step_tool_types(steps: DataFrame) -> DataFrame:
    """Distinct kinds of tools the plan steps name."""
    return _named_kinds(steps).select("trail_id", F.explode_outer("named").alias("kind")).where("kind IS NOT NULL").distinct()


def alignment(stops: DataFrame, chain: DataFrame, plans: DataFrame) -> DataFrame:
    """Agreement of a plan with its trail in 0..1: step count, topics, tool kinds, a formula; no steps give 0.

    Replies are parsed once: all that their steps say is gathered in one row per trail.
    """
    # no word spans a line, so none is found across two fields
    formula = _names_any(F.lower(F.concat_ws("\n", *fixed.PLAN_FIELDS[1:])), fixed.FORMULA_WORDS)
    # a plan is one reply document, so its topics fit one row; the kinds of tools are few
    per_plan = _named_kinds(plan_steps(plans)).groupBy("trail_id").agg(
        F.count(F.lit(1)).alias("n_steps"), F.max(formula).alias("formula"), F.collect_set(F.when(F.col("page_or_topic") != "", F.lower("page_or_topic"))).alias("topics"),
        F.array_distinct(F.flatten(F.collect_set("named"))).alias("named"),
    )
    per_plan = written(per_plan, "plans")
    title = F.lower(F.replace(F.element_at(F.split("page_url", "/wiki/"), -1), F.lit("_"), F.lit(" ")))
    sizes = stops.groupBy("trail_id").agg(F.count(F.lit(1)).alias("n_stops"))
    wanted = stops.where("page_url <> ''").select("trail_id", title.alias("topic")).distinct()
    long_words = F.filter(F.split("topic", " "), lambda w: F.length(w) > 3)
    seen = F.exists("topics", lambda t: F.contains(t, F.col("topic")) | F.contains(F.col("topic"), t) | F.exists(long_words, lambda w: F.contains(t, w)))
    topic_sums = wanted.join(per_plan.select("trail_id", "topics"), "trail_id").groupBy("trail_id").agg(F.count(F.lit(1)).alias("n_topics"), F.count_if(seen).alias("seen"))
    golden = trail_tool_types(stops, chain).groupBy("trail_id").agg(F.collect_set("kind").alias("golden"))
    t = sizes.join(per_plan, "trail_id", "left").join(topic_sums, "trail_id", "left").join(golden, "trail_id", "left")
    gap = F.abs(F.col("n_stops") - F.col("n_steps"))
    count_score = F.when(gap <= 2, 1.0).when(gap <= 4, 0.5).otherwise(0.0)
    topic_score = F.when(F.coalesce("n_topics", F.lit(0)) == 0, 1.0).when(F.size("topics") == 0, 0.0).otherwise(F.col("seen") / F.col("n_topics"))
    kind_score = F.when(F.col("golden").isNull(), 1.0).otherwise(F.size(F.array_intersect("golden", F.coalesce("named", F.array().cast("array<string>")))) / F.size("golden"))
    score = (count_score + topic_score + kind_score + F.when(F.col("formula"), 1.0).otherwise(0.0)) / 4.0
    return t.select("trail_id", F.when(F.col("n_steps").isNull(), 0.0).otherwise(score).alias("alignment"))


def implied_digit(reply: Column) -> Column:
    """Last digit of the last line of a reply, else of the whole reply."""
    r = strip(reply)
    pattern = r"(?s)(\d)\D*$"
    last = F.regexp_extract(F.element_at(F.split(r, "\n"), -1), pattern, 1)
    return F.coalesce(F.nullif(last, F.lit("")), F.nullif(F.regexp_extract(r, pattern, 1), F.lit(""))).cast("int")


def adopt(attempts: DataFrame, trails: DataFrame, min_alignment: float = 0.7) -> DataFrame:
    """Riddle to keep per trail: ``attempts(trail_id, attempt, leaks, alignment, implied)``.

    First attempt without leaks, aligned, implying the passcode; else, if two or more aligned ones
    imply the same other digit, the best aligned of the most frequent digit, with that digit.
    """
    a = attempts.join(trails.select("trail_id", "passcode"), "trail_id").where((F.col("leaks") == 0) & (F.col("alignment") >= min_alignment) & F.col("implied").isNotNull())
    right = a.where("implied = passcode").groupBy("trail_id").agg(F.min("attempt").alias("attempt"))
    other = a.where("implied <> passcode").join(right, "trail_id", "left_anti")
    votes = other.groupBy("trail_id", "implied").agg(
        F.count(F.lit(1)).alias("votes"), F.min("attempt").alias("first_seen"), F.max_by("attempt", F.struct("alignment", (-F.col("attempt")).alias("neg"))).alias("attempt")
    )
    best = first_per_key(votes, ["trail_id"], [F.col("votes").desc(), F.col("first_seen")]).where("votes >= 2")
    kept = right.join(trails.select("trail_id", F.col("passcode").cast("int").alias("digit")), "trail_id").select("trail_id", "attempt", "digit", F.lit("accepted").alias("outcome"))
    return kept.unionByName(best.select("trail_id", "attempt", F.col("implied").cast("int").alias("digit"), F.lit("adopted").alias("outcome")))


def stop_contexts(stops: DataFrame, pages: DataFrame, links: DataFrame, chain: DataFrame, deps: DataFrame, intro_chars: int = 300, next_chars: int = 200) -> DataFrame:
    """Context text of each stop for riddle writing: ``pages(url, title, first_paragraph)``, ``links(url, pos, text, target_url)``.

    Page, target, value type and section of every stop; tools with their own arguments of tool stops; the clues that a merge, a reason or a
    compute stop draws on; for page stops with a following one, the way there. ``intro_chars`` and ``next_chars`` cut the introductions.
    Stops without a page don't take part in the page joins.
    """
    nxt = stops.select("trail_id", (F.col("stop_index") - 1).alias("stop_index"), F.col("page_url").alias("next_url"), F.lit(True).alias("has_next"))
    text = links.groupBy(F.col("url").alias("page_url"), F.col("target_url").alias("next_url")).agg(F.min_by("text", "pos").alias("link_text"))
    # pages that stops name and links between them: held when counted as few, as all stops of such a page would meet in one task
    named = stops.where("page_url <> ''").select(F.col("page_url").alias("url")).distinct()
    pages = counted(pages.select("url", "title", "first_paragraph").join(counted(named), "url", "left_semi"))
    text = counted(text)
    here = pages.select(F.col("url").alias("page_url"), "title", F.substring("first_paragraph", 1, intro_chars).alias("intro"), F.lit(True).alias("known"))
    there = pages.select(F.col("url").alias("next_url"), F.substring("first_paragraph", 1, next_chars).alias("next_intro"))
    own = F.map_filter("args", lambda k, _v: ~F.startswith(k, F.lit("__from_previous")))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries(own), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ", ")
    steps = chain.groupBy(*K).agg(F.array_sort(F.collect_list(F.struct("step", "tool_name", shown.alias("args")))).alias("steps"))
    needs = deps.groupBy(*K).agg(F.array_sort(F.collect_list(F.col("dep") + 1)).alias("clues"))
    s = stops.join(nxt, K, "left").join(steps, K, "left").join(needs, K, "left")
    paged = s.where("page_url <> ''").join(here, "page_url", "left")
    follow = paged.where("next_url <> ''").join(there, "next_url", "left").join(text, ["page_url", "next_url"], "left")
    s = follow.unionByName(paged.where("next_url IS NULL OR next_url = ''"), allowMissingColumns=True).unionByName(s.where("page_url IS NULL OR page_url = ''"), allowMissingColumns=True)

    def of(name: str, kind: str = "string") -> Column:
        return (F.col(name) if name in stops.columns else F.lit(None)).cast(kind)

    def line(label: str, value: Column, when: Column | None = None) -> Column:
        said = F.when(value != "", F.concat(F.lit(f"{label}: "), value))
        return said if when is None else F.when(when, said)

    def clues(numbers: Column) -> Column:
        return F.array_join(F.transform(numbers, lambda x: x.cast("string")), ", ")

    kind = F.col("stop_type")
    leads = (kind == "page") & F.coalesce("has_next", F.lit(False))
    follows, searches = leads & (F.col("bridge_type") == "link_follow") & (F.col("next_url") != ""), leads & (F.col("bridge_type") == "search_query")
    calls = F.transform("steps", lambda t: F.when(t["args"] != "", F.concat(F.lit("Arguments of "), t["tool_name"], F.lit(": "), t["args"])))
    number = (F.col("stop_index") + 1).cast("string")
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("Stop "), number, F.lit(" ("), kind, F.lit(")")),
        F.when(F.col("known"), line("Page", F.col("title"))).otherwise(line("Page URL", F.col("page_url"))), line("Intro", F.col("intro")),
        line("Target", of("extraction_target")), line("Value type", F.col("value_type")), line("Section", of("extraction_section")),
        line("Tools", F.array_join(F.col("steps.tool_name"), ", "), kind == "tool"), F.when(kind == "tool", F.array_join(F.array_compact(calls), "\n")),
        line("Merges clues", clues(F.col("clues")), F.size("clues") >= 2),
        line("Transform", of("reason_transform"), kind == "reason"), line("Transforms clue", (F.coalesce("reason_source_stop", F.lit(0)) + 1).cast("string"), kind == "reason"),
        line("Expression", F.col("expression"), kind == "compute"), line("Expression code", of("expression_code"), kind == "compute"),
        line("Refers to clues", clues(F.transform(of("referenced_stops", "array<bigint>"), lambda x: x + 1)), kind == "compute"),
        F.when(follows, "Next: follow a link").when(searches, "Next: search"), line("Link text", F.col("link_text"), follows), line("Search", F.col("search_query"), searches),
        line("Next intro", F.col("next_intro"), follows | searches),
    )
    return s.select(*K, F.regexp_replace(lines, "\n+", "\n").alias("context"))


def target_lengths(stops: DataFrame) -> DataFrame:
    """Words a riddle should have, by number of stops."""
    n = stops.groupBy("trail_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("trail_id", F.when(F.col("n") <= 4, "100-200").when(F.col("n") <= 7, "200-350").otherwise("300-500").alias("target_length"))


