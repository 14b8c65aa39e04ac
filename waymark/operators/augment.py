"""Augmentation of existing trails: missing tool and reason stops, and diamonds (fork and merge)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark import fixed
from waymark.functions.skew import draw_int, draw_order, first_per_key, first_upto, shuffled
from waymark.functions.values import to_float, whole
from waymark.operators import build, checks
from waymark.operators.dims import level_config, table
from waymark.operators.facts import is_geocodable, stop_places
from waymark.operators.replies import packed_step, replay_packed
from waymark.session import written

K = ["trail_id", "stop_index"]


def needed_stops(trails: DataFrame, stops: DataFrame) -> DataFrame:
    """Tool and reason stops a trail lacks to reach the minimum of its level (0 for unknown levels)."""
    n = stops.groupBy("trail_id").agg(F.count_if(F.col("stop_type") == "tool").alias("tools"), F.count_if(F.col("stop_type") == "reason").alias("reasons"))
    t = trails.select("trail_id", "level").join(level_config(trails.sparkSession), "level", "left").join(n, "trail_id", "left").fillna(0, ["tools", "reasons"])

    def lack(low: str, have: str):
        return F.greatest(F.lit(0), F.coalesce(F.col(low), F.lit(0)) - F.col(have)).cast("int")

    return t.select("trail_id", "level", lack("tool_min", "tools").alias("tool_needed"), lack("reason_min", "reasons").alias("reason_needed"))


def needed_totals(needed: DataFrame) -> DataFrame:
    """Dry run: stops and trails to change per level."""
    return needed.groupBy("level").agg(
        F.sum("tool_needed").alias("tool_stops"), F.sum("reason_needed").alias("reason_stops"), F.count_if((F.col("tool_needed") > 0) | (F.col("reason_needed") > 0)).alias("trails")
    )


_KINDS = [
    ("location", "geocode_elevation"), ("location", "place_rating"), ("location", "nearby_poi_count"), ("location", "geocode_weather_historical"),
    ("country", "country_population"), ("country", "country_area"),
]


def _placed(stops: DataFrame) -> DataFrame:
    """Stops with their location, where it is usable, and country."""
    return stop_places(stops).withColumn("location", F.when(is_geocodable(F.col("location")), F.col("location")))


def _source_chains(placed: DataFrame, kinds: DataFrame, seed: int) -> DataFrame:
    """Chains for the given templates at page stops with their places: (trail_id, stop_index, page_url, template, chain) and the columns of ``kinds``."""
    s = placed.select(*K, "page_url", "location", "country")
    null = F.lit(None).cast("string")
    dated = ("geocode_weather_historical", "geocode_weather_precipitation")
    days = F.create_map(*[x for t in dated for x in (F.lit(t), F.lit(fixed.AUGMENT_DATE).cast("date"))])
    rows = build.template_rows(F.col("location"), null, F.col("country"), null, null, days, null, draw_int(seed, "poi", *K), F.lit(fixed.AUGMENT_DATE))
    return s.select(*K, "page_url", F.inline(rows)).join(kinds, "template")


def _values(chains: DataFrame, replies: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of chains with their replayed values; empty and zero values are dropped."""
    steps = F.transform("chain", lambda c: packed_step(c["step"], c["tool_name"], c["output_key"], c["args"]))
    packed = written(chains.select(*keep, steps.alias("steps")), "chains")
    # chains of the templates have at most three steps
    got = replay_packed(packed, replies, max_steps=3).where("value IS NOT NULL").select(*keep, "value")
    return got.where(~F.coalesce(to_float(F.col("value")) == 0, F.lit(False)))


def candidate_tools(stops: DataFrame, replies: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """Tool stops to insert after page stops: ``targets(trail_id, target)``.

    All chains of a source are tried; the first drawn one with a non-zero value counts, and the
    first drawn sources fill the target.
    """
    kinds = table(stops.sparkSession, [(t,) for _s, t in _KINDS], "template string")
    placed = _placed(stops.where("stop_type = 'page' AND page_url <> ''"))
    good = _values(_source_chains(placed, kinds, seed), replies, [*K, "template", "page_url", "chain"]).withColumn("draw", draw_order(seed, "tool", *K, "template"))
    best = first_per_key(good, K, [F.col("draw"), F.col("template")]).withColumn("source_draw", draw_order(seed, "source", *K))
    first = first_upto(best.join(targets, "trail_id"), ["trail_id"], [F.col("source_draw"), F.col("stop_index")], F.col("target"))
    num = to_float(F.col("value"))
    return first.select(
        "trail_id", F.col("stop_index").alias("after"), F.lit(0).alias("seq"), F.lit("tool").alias("stop_type"), "page_url", F.col("value").alias("value_str"), num.alias("value_num"),
        F.when(num.isNull(), "string").when(num == F.floor(num), "int").otherwise("float").alias("value_kind"), F.when(num.isNull(), "text").otherwise("number").alias("value_type"),
        F.lit("tool_call").alias("bridge_type"), "template", "chain",
    )


def candidate_reasons(stops: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """Reason stops to insert; stops that feed a reason stop already are passed over."""
    taken = stops.where("stop_type = 'reason' AND reason_source_stop IS NOT NULL").select("trail_id", F.col("reason_source_stop").alias("stop_index")).distinct()
    return build.draw_reasons(stops.join(taken, K, "left_anti"), targets, seed)


class Augmented(NamedTuple):
    outcome: DataFrame  # trail_id, status (unchanged, augmented, rejected), added
    stops: DataFrame  # stops of unchanged and augmented trails
    chain: DataFrame  # their tool chains


def attach_chains(stops: DataFrame, chain: DataFrame) -> DataFrame:
    """Stops with their own chain as an array, so that it moves along when stops are renumbered."""
    step = F.struct(F.col("step").cast("int").alias("step"), "tool_name", "args", F.col("output_key").alias("output_key"))
    c = chain if "output_key" in chain.columns else chain.withColumn("output_key", F.lit("result"))
    packed = c.select(*K, F.col("step").alias("at"), step.alias("s")).groupBy(*K).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", F.to_json("s").alias("j")))), lambda x: F.from_json(x["j"], "struct<step:int,tool_name:string,args:map<string,string>,output_key:string>")).alias("chain")
    )
    return stops.join(shuffled(packed), K, "left")


def augment(trails: DataFrame, stops: DataFrame, chain: DataFrame, replies: DataFrame, seed: int = 0) -> Augmented:
    """Bring trails to the minimum of their level and keep those that pass the critical checks.

    Nothing needed: unchanged. Nothing could be added, or a critical issue remains: rejected.
    """
    need = needed_stops(trails, stops)
    tools = candidate_tools(stops, replies, need.where("tool_needed > 0").select("trail_id", F.col("tool_needed").alias("target")), seed)
    ends = stops.groupBy("trail_id").agg(F.max_by("stop_type", "stop_index").alias("t")).where("t = 'compute'").select("trail_id")
    # rows that are read several times are written packed
    packed = written(attach_chains(stops, chain), "chained-stops")
    tools = written(tools, "tools")
    s1 = build.insert_stops(packed.where("stop_type <> 'compute'"), tools)
    reasons = candidate_reasons(s1, need.where("reason_needed > 0").select("trail_id", F.col("reason_needed").alias("target")), seed)
    reasons = written(reasons, "reasons")
    s2 = written(build.insert_stops(s1, reasons), "inserted")
    added = tools.select("trail_id").unionByName(reasons.select("trail_id")).groupBy("trail_id").agg(F.count(F.lit(1)).alias("added"))
    added = shuffled(added)  # a row per changed trail, and so are the codes and the bad trails
    rebuilt = build.compute_stops(s2, seed).drop("referenced_stops").join(shuffled(ends), "trail_id", "left_semi")
    s3 = s2.unionByName(rebuilt, allowMissingColumns=True).join(added, "trail_id", "left_semi").withColumn("stored_index", F.col("stop_index"))
    s3 = written(s3, "rebuilt")
    chain3 = s3.select(*K, F.inline("chain"))
    codes = build.roll_up(s3.withColumn("extraction_section", F.lit(None).cast("string"))).select("trail_id", F.col("passcode").alias("new_code"))
    t3 = trails.join(shuffled(codes), "trail_id").withColumn("passcode", F.when(F.col("new_code") >= 0, F.col("new_code")).otherwise(F.col("passcode"))).drop("new_code")
    about = written(checks.trail_facts(t3, s3), "trail-facts")
    issues = (
        checks.check_structure(t3, s3, about)
        .unionByName(checks.check_passcode(t3, s3, about))
        .unionByName(checks.check_values(s3, chain3))
        .unionByName(checks.check_bridges(s3, chain3))
        .unionByName(checks.check_tool_steps(chain3))
        .unionByName(checks.check_citations(s3))
    )
    bad = shuffled(issues.where("severity = 'critical'").select("trail_id").distinct().withColumn("bad", F.lit(True)))
    status = (
        F.when((F.col("tool_needed") == 0) & (F.col("reason_needed") == 0), "unchanged")
        .when(F.col("added").isNull() | F.col("bad").isNotNull(), "rejected")
        .otherwise("augmented")
    )
    outcome = need.join(added, "trail_id", "left").join(bad, "trail_id", "left").select("trail_id", status.alias("status"), F.coalesce("added", F.lit(0)).alias("added"))
    same = packed.join(outcome.where("status = 'unchanged'").select("trail_id"), "trail_id", "left_semi")
    changed = s3.join(outcome.where("status = 'augmented'").select("trail_id"), "trail_id", "left_semi")
    out = same.unionByName(changed, allowMissingColumns=True)
    return Augmented(outcome, out.drop("chain"), out.select(*K, F.inline("chain")))


# --- diamonds ------------------------------------------------------------------------------


def diamond_sources(stops: DataFrame) -> DataFrame:
    """Page stops, except among the last two stops, with a usable location or a known country."""
    n = stops.groupBy("trail_id").agg(F.count(F.lit(1)).alias("n"))
    s = stops.where("stop_type = 'page'").join(n, "trail_id").where("stop_index < n - 2").drop("n")
    return _placed(s).where("location IS NOT NULL OR country IS NOT NULL")


def diamond_branches(stops: DataFrame, replies: DataFrame, seed: int = 0) -> DataFrame:
    """Diamond types whose two branches both replay to a non-zero number, per eligible source."""
    spark = stops.sparkSession
    sides = [(name, side, t) for name, _src, a, b in fixed.DIAMONDS for side, t in (("a", a), ("b", b))]
    kinds = table(spark, sides, "diamond string, side string, template string")
    chains = _source_chains(diamond_sources(stops).where("page_url <> ''"), kinds, seed)
    good = _values(chains, replies, [*K, "diamond", "side", "page_url"]).withColumn("num", to_float(F.col("value"))).where("num IS NOT NULL")
    return good.groupBy(*K, "diamond").agg(
        F.first("page_url").alias("page_url"), F.max(F.when(F.col("side") == "a", F.col("num"))).alias("a"), F.max(F.when(F.col("side") == "b", F.col("num"))).alias("b")
    ).where("a IS NOT NULL AND b IS NOT NULL")


def build_diamonds(trails: DataFrame, stops: DataFrame, branches: DataFrame, seed: int = 0) -> DataFrame:
    """Branch A, branch B and merge rows to insert after the drawn sources.

    The number of diamonds is drawn from the range of the level and cannot exceed the eligible
    sources. A merge is the sum or the absolute difference of the integer-cut values, whichever is
    drawn first and not zero.
    """
    spark = trails.sparkSession
    per_level = table(spark, fixed.DIAMONDS_PER_LEVEL, "level string, lo int, hi int")
    wanted = F.col("lo") + F.pmod(draw_int(seed, "diamonds", "trail_id"), F.col("hi") - F.col("lo") + 1)
    quota = trails.select("trail_id", "level").join(per_level, "level", "left").select("trail_id", F.coalesce(wanted, 1 + F.pmod(draw_int(seed, "diamonds", "trail_id"), F.lit(2))).alias("target"))
    a, b = whole(F.col("a")), whole(F.col("b"))
    add_first = F.pmod(draw_int(seed, "merge", *K), F.lit(2)) == 0
    added, gap = F.nullif(a + b, F.lit(0)), F.nullif(F.abs(a - b), F.lit(0))
    merged = F.when(add_first, F.coalesce(added, gap)).otherwise(F.coalesce(gap, added))
    ops = branches.withColumn("merged", merged).withColumn("op", F.when(F.when(add_first, added.isNotNull()).otherwise(gap.isNull()), "add").otherwise("abs_diff")).where("merged IS NOT NULL")
    best = first_per_key(ops.withColumn("draw", draw_order(seed, "diamond", *K, "diamond")), K, [F.col("draw"), F.col("diamond")])
    best = best.withColumn("source_draw", draw_order(seed, "fork", *K))
    chosen = first_upto(best.join(quota, "trail_id"), ["trail_id"], [F.col("source_draw"), F.col("stop_index")], F.col("target"))

    def row(seq: int, role: str, value):
        return F.struct(F.lit(seq).alias("seq"), F.lit(role).alias("role"), value.cast("double").alias("value_num"))

    rows = chosen.select(
        "trail_id", F.col("stop_index").alias("after"), "page_url", "diamond", "op",
        F.inline(F.array(row(0, "branch", F.col("a")), row(1, "branch", F.col("b")), row(2, "merge", F.col("merged")))),
    )
    v = F.col("value_num")
    return rows.select(
        "*", F.lit("tool").alias("stop_type"), F.when(v == F.floor(v), v.cast("bigint").cast("string")).otherwise(v.cast("string")).alias("value_str"),
        F.when(v == F.floor(v), "int").otherwise("float").alias("value_kind"), F.lit("number").alias("value_type"), F.lit("tool_call").alias("bridge_type"),
    )


def insert_diamonds(stops: DataFrame, diamonds: DataFrame) -> DataFrame:
    """Stops with the diamond rows put in and renumbered; compute stops are left out (rebuild them after)."""
    base = stops.where("stop_type <> 'compute'").withColumn("role", F.lit(None).cast("string"))
    return build.insert_stops(base, diamonds)


def dependencies(stops: DataFrame) -> DataFrame:
    """Dependency edges of trails with roles: ``stops(trail_id, stop_index, stop_type, role, reason_source_stop, referenced_stops)``.

    Branches depend on their source (one or two stops before), merges on the two branches, reason stops on
    their source, compute stops on their references, the first stop on nothing, all others on the
    stop before.
    """
    i = F.col("stop_index")
    prev = stops.select("trail_id", (F.col("stop_index") + 1).alias("stop_index"), F.col("role").alias("prev_role"))
    s = stops.join(prev, K, "left")
    second = F.col("prev_role") == "branch"
    branch = F.array(F.when(second, i - 2).otherwise(i - 1))
    refs = F.col("referenced_stops") if "referenced_stops" in stops.columns else F.lit(None).cast("array<bigint>")
    dep = (
        F.when(F.col("role") == "branch", branch)
        .when(F.col("role") == "merge", F.array(i - 2, i - 1))
        .when((F.col("stop_type") == "reason") & F.col("reason_source_stop").isNotNull(), F.array(F.col("reason_source_stop")))
        .when((F.col("stop_type") == "compute") & (F.size(refs) > 0), refs)
        .when(i == 0, F.array().cast("array<bigint>"))
        .otherwise(F.array(i - 1))
    )
    return s.select(*K, F.explode(dep).alias("dep"))


def diamond_totals(trails: DataFrame, diamonds: DataFrame) -> DataFrame:
    """Trails changed, trails without a diamond and diamonds per level."""
    per = diamonds.groupBy("trail_id").agg((F.count(F.lit(1)) / 3).cast("bigint").alias("diamonds"))
    t = trails.select("trail_id", "level").join(per, "trail_id", "left")
    return t.groupBy("level").agg(F.count("diamonds").alias("modified"), F.count_if(F.col("diamonds").isNull()).alias("failed"), F.coalesce(F.sum("diamonds"), F.lit(0)).alias("diamonds"))
