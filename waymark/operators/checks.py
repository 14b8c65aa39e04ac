"""Static checks of trails: issue rows ``(trail_id, category, severity, stop_index, detail)``.

Row checks of one table are made in one projection; checks of a whole trail are one aggregation
with partial sums. ``stops`` carries ``value_kind`` (int, float, string, null), ``value_str`` and
``value_num`` next to the stored fields; ``stored_index`` is the index written in the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark import fixed
from waymark.functions.text import drop_final_parenthesis, has_citation, is_specific_title, tail_title
from waymark.functions.values import is_weekend, iso_date, to_float, whole
from waymark.operators.dims import level_config
from waymark.session import cut_lineage

CRITICAL, WARNING = "critical", "warning"
ISSUE_COLUMNS = ["trail_id", "category", "severity", "stop_index", "detail"]


def issue(cond: Column, category: str, severity: str, stop: Column | None = None, detail: Column | None = None) -> Column:
    return F.when(
        cond,
        F.struct(
            F.lit(category).alias("category"),
            F.lit(severity).alias("severity"),
            (F.lit(None) if stop is None else stop).cast("bigint").alias("stop_index"),
            (F.lit(None) if detail is None else detail).cast("string").alias("detail"),
        ),
    )


def issues_of(df: DataFrame, *found: Column) -> DataFrame:
    return df.select("trail_id", F.inline(F.array_compact(F.array(*found)))).select(*ISSUE_COLUMNS)


def trail_facts(trails: DataFrame, stops: DataFrame) -> DataFrame:
    """One row per trail with stop counts and the last stop."""
    last = F.struct("stop_type", "value_str", "value_kind")
    sums = stops.groupBy("trail_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("stop_type") == "tool").alias("tools"),
        F.count_if(F.col("stop_type") == "reason").alias("reasons"),
        F.max_by(last, "stop_index").alias("last"),
    )
    return trails.join(sums, "trail_id", "left").fillna(0, ["n", "tools", "reasons"])


def last_digit(last: Column) -> Column:
    """Digit of the last stop's value; null when it is no finite number."""
    return F.pmod(whole(to_float(last["value_str"])), F.lit(10))


def check_structure(trails: DataFrame, stops: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """``facts`` are those of :func:`trail_facts` where the caller has them."""
    facts = trail_facts(trails, stops) if facts is None else facts
    at_trail = issues_of(
        facts,
        issue(F.col("n") == 0, "no_stops", CRITICAL),
        issue((F.col("n") > 0) & (F.col("last.stop_type") != "compute"), "no_compute_stop", CRITICAL, detail=F.col("last.stop_type")),
    )
    i = F.col("stop_index")
    at_stop = issues_of(
        stops,
        issue(F.col("stored_index") != i, "index_mismatch", WARNING, i, F.col("stored_index")),
        issue(~F.col("stop_type").isin(fixed.STOP_TYPES), "invalid_stop_type", CRITICAL, i, F.col("stop_type")),
    )
    return at_trail.unionByName(at_stop)


def check_passcode(trails: DataFrame, stops: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    facts = trail_facts(trails, stops) if facts is None else facts
    code = F.col("passcode")
    valid = F.coalesce((code >= 0) & (code <= 9), F.lit(False))
    digit = last_digit(F.col("last"))
    return issues_of(
        facts,
        issue(~valid, "invalid_passcode", CRITICAL, detail=code),
        issue(valid & (F.col("last.stop_type") == "compute") & (digit != code), "passcode_mismatch", CRITICAL, detail=digit),
    )


def check_counts(trails: DataFrame, stops: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Stop counts against the ranges of the level; levels without ranges are passed over."""
    facts = (trail_facts(trails, stops) if facts is None else facts).join(level_config(trails.sparkSession), "level")

    def outside(n: str, low: str, high: Column) -> Column:
        return (F.col(n) < F.col(low)) | (F.col(n) > high)

    return issues_of(
        facts,
        issue(outside("n", "depth_min", F.col("depth_max") + 1), "stop_count_out_of_range", WARNING, detail=F.col("n")),
        issue(outside("tools", "tool_min", F.col("tool_max")), "tool_stop_count_out_of_range", WARNING, detail=F.col("tools")),
        issue(outside("reasons", "reason_min", F.col("reason_max")), "reason_stop_count_out_of_range", WARNING, detail=F.col("reasons")),
    )


def clue_count(riddle: Column, indented: bool = False) -> Column:
    """Numbered clue lines in a riddle."""
    return F.regexp_count(riddle, F.lit(r"(?m)^\s*\d+\." if indented else r"(?m)^\d+\."))


def leak_title(title: Column) -> Column:
    """Lower-case text whose presence in a riddle is a leak; null for titles that cannot leak."""
    short = drop_final_parenthesis(title)
    return F.when(is_specific_title(title) & (F.length(short) >= 6), F.lower(short))


def check_riddle(trails: DataFrame, stops: DataFrame) -> DataFrame:
    """Riddle length, clue count and title leaks. ``trails`` carries riddle and seed title."""
    riddle = F.coalesce("riddle", F.lit(""))
    sizes = stops.groupBy("trail_id").agg(F.count(F.lit(1)).alias("n"))
    facts = trails.join(sizes, "trail_id", "left").fillna(0, ["n"])
    ok = F.length(riddle) >= 50
    clues = clue_count(riddle)
    at_trail = issues_of(
        facts,
        issue(~ok, "missing_riddle", CRITICAL, detail=F.length(riddle)),
        issue(ok & (clues > 0) & (clues != F.col("n")), "riddle_clue_count_mismatch", WARNING, detail=clues),
        issue(ok & F.contains(F.lower(riddle), leak_title(F.col("seed_title"))), "title_leak_in_riddle", WARNING, detail=F.col("seed_title")),
    )
    titled = stops.where("page_url <> ''").select("trail_id", "stop_index", tail_title(F.col("page_url")).alias("title"))
    titled = titled.withColumn("needle", leak_title(F.col("title"))).where("needle IS NOT NULL")
    leaks = titled.join(trails.where(ok).select("trail_id", F.lower(riddle).alias("low")), "trail_id")
    at_stop = issues_of(
        leaks, issue(F.contains("low", F.col("needle")), "title_leak_in_riddle", WARNING, F.col("stop_index"), F.col("title"))
    )
    return at_trail.unionByName(at_stop)


def check_values(stops: DataFrame, chain: DataFrame) -> DataFrame:
    i, kind, num = F.col("stop_index"), F.col("value_kind"), F.col("value_num")
    numeric = kind.isin("int", "float")
    bad_float = F.isnan(num) | (F.abs(num) == float("inf"))
    vtype = F.col("value_type")
    at_stop = issues_of(
        stops,
        issue(kind == "null", "null_extracted_value", CRITICAL, i, F.col("stop_type")),
        issue((kind == "float") & bad_float, "nan_or_inf_value", CRITICAL, i, F.col("value_str")),
        issue((vtype == "number") & (kind == "string") & to_float(F.col("value_str")).isNull(), "value_type_mismatch", WARNING, i, F.col("value_str")),
        issue((vtype != "") & ~vtype.isin(fixed.VALUE_TYPES), "invalid_value_type", WARNING, i, vtype),
    )
    suspicious = chain.where(F.col("tool_name").isin(fixed.ZERO_SUSPICIOUS_TOOLS) & (F.col("step") == 0)).select("trail_id", "stop_index", "tool_name")
    zero = stops.where((F.col("stop_type") == "tool") & numeric & (num == 0)).select("trail_id", "stop_index").join(suspicious, ["trail_id", "stop_index"])
    repeated = (
        stops.where((F.col("stop_type") != "compute") & numeric & (F.abs(num) > 100))
        .groupBy("trail_id", "value_num")
        .agg(F.count(F.lit(1)).alias("times"), F.min("stop_index").alias("stop_index"))
        .where("times > 1")
    )
    return (
        at_stop.unionByName(issues_of(zero, issue(F.lit(True), "zero_tool_value", CRITICAL, i, F.col("tool_name"))))
        .unionByName(issues_of(repeated, issue(F.lit(True), "duplicate_extracted_value", WARNING, i, num)))
    )


def _missing(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit("")) == ""


def check_bridges(stops: DataFrame, chain: DataFrame) -> DataFrame:
    i, bridge = F.col("stop_index"), F.col("bridge_type")
    chained = chain.select("trail_id", "stop_index").distinct().withColumn("chained", F.lit(True))
    s = stops.join(chained, ["trail_id", "stop_index"], "left")
    lacking = (
        F.when(bridge == "link_follow", _missing("target_url"))
        .when(bridge == "search_query", _missing("search_query"))
        .when(bridge == "tool_call", F.col("chained").isNull())
        .when((bridge == "compute") & (F.col("stop_type") == "compute"), _missing("expression"))
    )
    return issues_of(
        s,
        issue((bridge != "") & ~bridge.isin(fixed.BRIDGE_TYPES), "invalid_bridge_type", CRITICAL, i, bridge),
        issue(lacking, "missing_bridge_field", WARNING, i, bridge),
        issue((F.col("stop_type") == "tool") & F.col("chained").isNull(), "empty_tool_chain", CRITICAL, i),
    )


def check_tool_steps(chain: DataFrame) -> DataFrame:
    """Unknown tools, weekend dates of stock tools, citation marks in text arguments."""
    i, tool = F.col("stop_index"), F.col("tool_name")
    day = F.try_element_at("args", F.lit("date"))
    at_step = issues_of(
        chain,
        issue((tool != "") & ~tool.isin(fixed.VALID_TOOLS), "invalid_tool_name", CRITICAL, i, tool),
        issue(tool.isin(fixed.STOCK_TOOLS) & is_weekend(iso_date(day)), "stock_weekend_date", CRITICAL, i, day),
    )
    args = chain.select("trail_id", "stop_index", F.explode("args").alias("name", "value"))
    return at_step.unionByName(
        issues_of(args, issue(has_citation(F.col("value")), "citation_in_tool_arg", CRITICAL, i, F.col("name")))
    )


def check_citations(stops: DataFrame) -> DataFrame:
    text = F.when(F.col("value_kind") == "string", F.col("value_str"))
    return issues_of(stops, issue(has_citation(text), "citation_in_value", CRITICAL, F.col("stop_index"), text))


def check_reason_sources(stops: DataFrame) -> DataFrame:
    i, src = F.col("stop_index"), F.col("reason_source_stop")
    bad = (F.col("stop_type") == "reason") & ((src < 0) | (src >= i))
    return issues_of(stops, issue(bad, "invalid_reason_source", WARNING, i, src))


def check_depends_on(deps: DataFrame) -> DataFrame:
    i, dep = F.col("stop_index"), F.col("dep")
    return issues_of(deps, issue(dep.isNull() | (dep < 0) | (dep >= i), "invalid_depends_on", CRITICAL, i, dep))


def invalid_documents(documents: DataFrame) -> DataFrame:
    """Documents that are not JSON, null texts among them: ``documents(trail_id, text)``.

    Spark's parser stops after the first value of a text ("12 monkeys" gives 12). So the text is put in front of a key that no text can hold,
    its own digest: it is one value exactly if that leaves an object of these two fields.
    """
    mark = F.md5("text")
    wrapped = F.try_parse_json(F.concat(F.lit('{"a":'), F.col("text"), F.lit(',"'), mark, F.lit('":0}')))
    fields = F.map_keys(F.try_variant_get(wrapped, "$", "map<string,variant>"))
    whole = F.coalesce((F.size(fields) == 2) & F.array_contains(fields, mark), F.lit(False))
    return issues_of(documents, issue(~whole, "invalid_json", CRITICAL, detail=F.substring("text", 1, 80)))


def check_trails(trails: DataFrame, stops: DataFrame, chain: DataFrame, deps: DataFrame) -> DataFrame:
    """All static check groups. ``trails`` without a riddle column skips the riddle group."""
    facts = cut_lineage(trail_facts(trails, stops))  # one row per trail, read by three groups
    parts = [
        check_structure(trails, stops, facts),
        check_passcode(trails, stops, facts),
        check_counts(trails, stops, facts),
        check_values(stops, chain),
        check_bridges(stops, chain),
        check_tool_steps(chain),
        check_citations(stops),
        check_reason_sources(stops),
        check_depends_on(deps),
    ]
    if "riddle" in trails.columns:
        parts.append(check_riddle(trails, stops))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def verdicts(trails: DataFrame, issues: DataFrame) -> DataFrame:
    """Valid means: no critical issue."""
    per = issues.groupBy("trail_id").agg(
        F.count_if(F.col("severity") == CRITICAL).alias("criticals"), F.count_if(F.col("severity") == WARNING).alias("warnings")
    )
    return (
        trails.select("trail_id", "level")
        .join(per, "trail_id", "left")
        .fillna(0, ["criticals", "warnings"])
        .withColumn("is_valid", F.col("criticals") == 0)
    )


def check_report(trails: DataFrame, issues: DataFrame, severity: str | None = None) -> DataFrame:
    """Scanned, flagged, critical, warning-only and clean trails per level and overall (level null)."""
    kept = issues if severity is None else issues.where(F.col("severity") == severity)
    v = verdicts(trails, kept)
    flagged = (F.col("criticals") + F.col("warnings")) > 0
    return v.rollup("level").agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(flagged).alias("flagged"),
        F.count_if(F.col("criticals") > 0).alias("critical"),
        F.count_if(flagged & (F.col("criticals") == 0)).alias("warning_only"),
        F.count_if(~flagged).alias("clean"),
    )


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("category", "severity").agg(F.count(F.lit(1)).alias("times"))


def split_flagged(trails: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined): trails without and with a critical issue."""
    critical = issues.where(F.col("severity") == CRITICAL).select("trail_id").distinct()
    return trails.join(critical, "trail_id", "left_anti"), trails.join(critical, "trail_id", "left_semi")


