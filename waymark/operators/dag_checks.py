"""Checks of the dependency DAG, for trails in which any stop has dependencies.

``deps(trail_id, stop_index, dep)`` has one row per dependency; a null ``dep`` stands for an entry
that is no integer.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.numbers import recompute
from waymark.functions.values import to_float, whole
from waymark.operators.checks import CRITICAL, WARNING, clue_count, issue, issues_of, last_digit, trail_facts
from waymark.session import cut_lineage, written

K = ["trail_id", "stop_index"]


def _dag_only(df: DataFrame, deps: DataFrame) -> DataFrame:
    return df.join(deps.select("trail_id").distinct(), "trail_id", "left_semi")


def _summaries(stops: DataFrame, deps: DataFrame) -> DataFrame:
    """Stops of DAG trails with the number of their dependencies."""
    per = deps.groupBy(*K).agg(F.count(F.lit(1)).alias("n_deps"), F.max("dep").alias("one_dep"))
    return _dag_only(stops, deps).join(per, K, "left").fillna(0, ["n_deps"])


def check_no_stops(trails: DataFrame, stops: DataFrame) -> DataFrame:
    empty = trails.join(stops.select("trail_id").distinct(), "trail_id", "left_anti")
    return issues_of(empty, issue(F.lit(True), "diamond_no_stops", CRITICAL))


def check_dependencies(stops: DataFrame, deps: DataFrame) -> DataFrame:
    """Root with dependencies, stops without any, out-of-range, forward and non-integer entries.

    An entry equal to the stop itself counts as forward.
    """
    i, dep, n = F.col("stop_index"), F.col("dep"), F.col("n")
    at_stop = issues_of(
        _summaries(stops, deps),
        issue((i == 0) & (F.col("n_deps") > 0), "diamond_root_has_deps", WARNING, i),
        issue((i > 0) & (F.col("n_deps") == 0), "diamond_missing_depends_on", WARNING, i),
    )
    sizes = stops.groupBy("trail_id").agg(F.count(F.lit(1)).alias("n"))
    outside = (dep < 0) | (dep >= n)
    at_edge = issues_of(
        deps.join(sizes, "trail_id"),
        issue(dep.isNull(), "diamond_invalid_dep_type", CRITICAL, i),
        issue(outside, "diamond_dep_out_of_range", CRITICAL, i, dep),
        issue(~outside & (dep >= i), "diamond_forward_dep", CRITICAL, i, dep),
    )
    return at_stop.unionByName(at_edge)


def _first_line_value(code: Column) -> Column:
    """Right side of the first line of a code text, recomputed as a closed form."""
    line = F.substring_index(code, "\n", 1)
    return F.when(F.contains(line, F.lit("=")), recompute(F.regexp_extract(line, r"^[^=]*=(.*)$", 1)))


def check_merges(stops: DataFrame, chain: DataFrame, deps: DataFrame) -> DataFrame:
    """Merge stops (two or more dependencies, not compute) and branch stops (tool, one far dependency)."""
    i = F.col("stop_index")
    s = _summaries(stops, deps)
    first = chain.where("step = 0").select(*K, F.col("tool_name").alias("first_tool"), F.try_element_at("args", F.lit("code")).alias("code"))
    merges = s.where("n_deps >= 2 AND stop_type <> 'compute'").select(*K, "stop_type", "value_str").join(first, K, "left")
    is_tool = F.col("stop_type") == "tool"
    coded = F.coalesce(F.col("first_tool") == "python_execute_code", F.lit(False))
    stored, got = whole(to_float(F.col("value_str"))), _first_line_value(F.col("code"))
    at_merge = issues_of(
        merges,
        issue(~is_tool, "diamond_merge_wrong_type", CRITICAL, i, F.col("stop_type")),
        issue(is_tool & ~coded, "diamond_merge_no_code", CRITICAL, i, F.col("first_tool")),
        issue(is_tool & coded & (got != stored), "diamond_merge_value_mismatch", CRITICAL, i, got),
    )
    sizes = stops.groupBy("trail_id").agg(F.count(F.lit(1)).alias("n"))
    # a negative entry counts from the end, as an index does
    target = F.when(F.col("dep") < 0, F.col("n") + F.col("dep")).otherwise(F.col("dep"))
    types = stops.select("trail_id", F.col("stop_index").alias("at"), F.col("stop_type").alias("dep_type"))
    edges = deps.join(sizes, "trail_id").select(*K, target.alias("at")).join(types, ["trail_id", "at"])
    branches = s.where("stop_type = 'tool' AND n_deps = 1 AND one_dep <> stop_index - 1").select(*K)
    at_merge_edge = issues_of(
        edges.join(merges.where(is_tool & coded).select(*K), K),
        issue(~F.col("dep_type").isin("tool", "page", "reason"), "diamond_merge_dep_wrong_type", WARNING, i, F.col("dep_type")),
    )
    at_branch_edge = issues_of(
        edges.join(branches, K), issue(F.col("dep_type") != "page", "diamond_branch_dep_not_page", WARNING, i, F.col("dep_type"))
    )
    return at_merge.unionByName(at_merge_edge).unionByName(at_branch_edge)


def check_final_digit(trails: DataFrame, stops: DataFrame, deps: DataFrame) -> DataFrame:
    facts = _dag_only(trail_facts(trails, stops), deps).where("last.stop_type = 'compute'")
    digit, at = last_digit(F.col("last")), F.col("n") - 1
    return issues_of(
        facts,
        issue(digit.isNull(), "diamond_compute_not_numeric", CRITICAL, at, F.col("last.value_str")),
        issue(digit.isNotNull() & ~F.equal_null(F.col("passcode"), digit), "diamond_passcode_mismatch", CRITICAL, at, digit),
    )


def check_clues(riddles: DataFrame, stops: DataFrame, deps: DataFrame) -> DataFrame:
    """Numbered clue lines (also indented ones) against the number of stops."""
    sizes = _dag_only(stops, deps).groupBy("trail_id").agg(F.count(F.lit(1)).alias("n"))
    clues = clue_count(F.col("riddle"), indented=True)
    return issues_of(
        riddles.join(sizes, "trail_id"), issue((clues > 0) & (clues != F.col("n")), "diamond_riddle_clue_mismatch", WARNING, detail=clues)
    )


def unreachable_stops(stops: DataFrame, deps: DataFrame) -> DataFrame:
    """Stops that no root reaches. Roots have no dependencies; without any, stop 0 is the root.

    A stop with an earlier dependency inside the trail always leads back to a root or to a
    stop all of whose entries point forward or outside. Trails without such a dead-end stop are
    reachable as a whole, so only the other trails are walked: those of up to 63 stops in their row, as bits of a number; larger ones in
    rounds. Each round marks the stops next to a reached one, points
    every other stop to one of its dependencies and doubles these pointers, so that a chain of any length is walked in a number of
    steps that grows with its logarithm; rounds end when nothing new is reached.
    """
    trails = written(_reach_masks(stops, deps).where("dead"), "dead-ends")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("at").cast("int"))
    lost = trails.where("NOT large").withColumn("lost", F.col("all_stops").bitwiseAND(F.bitwise_not(_reached())))
    lost = lost.where("lost <> 0").select("trail_id", "lost", F.explode(F.sequence(F.lit(0), F.lit(MASK_STOPS - 1))).alias("at"))
    lost = lost.where(F.col("lost").bitwiseAND(bit) != 0).select("trail_id", F.col("at").cast("bigint").alias("stop_index"))
    large = trails.where("large").select("trail_id")
    return lost if large.isEmpty() else lost.unionByName(_walked(stops, deps, large))


#: Stops that one number has bits for.
MASK_STOPS = 63


def _reach_masks(stops: DataFrame, deps: DataFrame) -> DataFrame:
    """One row per trail: bits of its stops and of its roots, and an array of (at, bits of its dependencies) of the stops that have some.

    ``dead`` says whether a stop has no earlier dependency though it has some; ``large`` whether a stop is beyond the bits, which such a
    row then doesn't have. A row has at most ``MASK_STOPS`` entries, however large the trail.
    """
    i, dep = F.col("stop_index"), F.col("dep")

    def fits(c: Column) -> Column:
        return (c >= 0) & (c < MASK_STOPS)

    def bit(c: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), c.cast("int"))

    marks = stops.select(*K, F.lit(True).alias("is_stop"), F.lit(None).cast("bigint").alias("dep")).unionByName(deps.select(*K, F.lit(False).alias("is_stop"), dep.cast("bigint").alias("dep")))
    back = F.coalesce((dep >= 0) & (dep < i), F.lit(False))
    per_stop = marks.groupBy(*K).agg(
        F.max("is_stop").alias("is_stop"), F.max(~F.col("is_stop")).alias("bears"), F.max(back).alias("leads_back"), F.max(dep.isNotNull()).alias("has_edge"),
        F.coalesce(F.bit_or(F.when(fits(dep), bit(dep))), F.lit(0)).cast("bigint").alias("deps"),
    )
    inside = fits(i)
    per_trail = per_stop.groupBy("trail_id").agg(
        F.max(F.col("bears") & ~F.col("leads_back")).alias("dead"), F.max(~inside).alias("large"),
        F.bit_or(F.when(inside & F.col("is_stop"), bit(i))).alias("all_stops"), F.bit_or(F.when(inside & F.col("is_stop") & ~F.col("bears"), bit(i))).alias("roots"),
        F.array_sort(F.collect_list(F.when(inside & (F.col("deps") != 0), F.struct(i.alias("at"), "deps")))).alias("edges"),
        F.max((i == 0) & (F.col("is_stop") | F.col("has_edge"))).alias("has_first"),
    )
    return per_trail.where("all_stops IS NOT NULL OR large")


def _reached() -> Column:
    """Bits of the stops of a :func:`_reach_masks` row that a root reaches.

    A pass over the edges in stop order follows all that lead on; each further pass follows at least one that leads back.
    """
    def follow(mask: Column, e: Column) -> Column:
        there = F.call_function("shiftleft", F.lit(1).cast("bigint"), e["at"].cast("int"))
        return F.when(e["deps"].bitwiseAND(mask) != 0, mask.bitwiseOR(there)).otherwise(mask)

    later = F.size(F.filter("edges", lambda e: F.call_function("shiftright", e["deps"], e["at"].cast("int")) != 0))
    first = F.coalesce(F.col("roots"), F.col("has_first").cast("bigint"))
    return F.aggregate(F.sequence(F.lit(0), later), first, lambda mask, _i: F.aggregate(F.col("edges"), mask, follow))


def _walked(stops: DataFrame, deps: DataFrame, suspects: DataFrame) -> DataFrame:
    """Unreachable stops of trails of any size, by pointers."""
    s = cut_lineage(stops.join(suspects, "trail_id", "left_semi").select(*K).distinct())
    e = cut_lineage(deps.join(suspects, "trail_id", "left_semi").where("dep IS NOT NULL").select("trail_id", "dep", "stop_index"))
    roots = s.join(e.select(*K).distinct(), K, "left_anti").join(deps.where("dep IS NULL").select(*K).distinct(), K, "left_anti")
    rootless = s.select("trail_id").distinct().join(roots.select("trail_id").distinct(), "trail_id", "left_anti")
    first = roots.unionByName(rootless.select("trail_id", F.lit(0).cast("bigint").alias("stop_index"))).withColumn("ok", F.lit(True))
    nodes = s.unionByName(e.select(*K)).distinct()
    state = cut_lineage(nodes.join(first, K, "left").select(*K, F.coalesce("ok", F.lit(False)).alias("ok")))
    longest = state.groupBy("trail_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    reached = state.where("ok").count()
    while True:
        other = state.select("trail_id", F.col("stop_index").alias("dep"), F.col("ok").alias("dep_ok"))
        # an earlier dependency if there is one: pointers then run towards the start of the trail
        leads = e.join(other, ["trail_id", "dep"]).groupBy(*K).agg(
            F.max("dep_ok").alias("next"), F.min(F.struct((F.col("dep") >= F.col("stop_index")).alias("later"), "dep")).alias("to")
        )
        ptr = cut_lineage(state.join(leads, K, "left").select(*K, (F.col("ok") | F.coalesce("next", F.lit(False))).alias("ok"), F.col("to.dep").alias("ptr")))
        if ptr.where("ok").count() == reached:
            return s.join(ptr.where("ok"), K, "left_anti")
        # two doublings between checkpoints
        for _ in range(math.ceil(math.log2(longest) / 2)):
            ptr = cut_lineage(_doubled(_doubled(ptr)))
        state = ptr.select(*K, "ok")
        reached = state.where("ok").count()


def _doubled(ptr: DataFrame) -> DataFrame:
    """Pointers to where their targets point; a stop whose target is reached is reached."""
    there = ptr.select("trail_id", F.col("stop_index").alias("ptr"), F.col("ok").alias("ptr_ok"), F.col("ptr").alias("beyond"))
    out = ptr.join(there, ["trail_id", "ptr"], "left")
    return out.select(*K, (F.col("ok") | F.coalesce("ptr_ok", F.lit(False))).alias("ok"), F.coalesce("beyond", "ptr").alias("ptr"))


def check_reachability(stops: DataFrame, deps: DataFrame) -> DataFrame:
    lost = unreachable_stops(stops, deps).groupBy("trail_id").agg(F.count(F.lit(1)).alias("lost"))
    return issues_of(lost, issue(F.lit(True), "diamond_unreachable_stops", WARNING, detail=F.col("lost")))


def check_dags(trails: DataFrame, stops: DataFrame, chain: DataFrame, deps: DataFrame) -> DataFrame:
    """All DAG checks; the clue check needs a riddle column."""
    out = (
        check_no_stops(trails, stops)
        .unionByName(check_dependencies(stops, deps))
        .unionByName(check_merges(stops, chain, deps))
        .unionByName(check_final_digit(trails, stops, deps))
        .unionByName(check_reachability(stops, deps))
    )
    if "riddle" in trails.columns:
        out = out.unionByName(check_clues(trails.select("trail_id", "riddle"), stops, deps))
    return out
