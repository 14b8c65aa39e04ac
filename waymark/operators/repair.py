"""Repairs of trails. Each job returns the repaired table; fix counts come from the same conditions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark import fixed
from waymark.functions.text import drop_citations
from waymark.functions.values import is_weekend, iso_date, number_text, parse_number, trading_day
from waymark.operators.checks import last_digit, trail_facts


class Repaired(NamedTuple):
    trails: DataFrame
    stops: DataFrame
    chain: DataFrame
    fixes: DataFrame


def _stop_fixes(stops: DataFrame) -> DataFrame:
    """Stops with the outcome of each fix next to the stored fields."""
    text = F.when(F.col("value_kind") == "string", F.col("value_str"))
    cleaned = drop_citations(text)
    s = stops.withColumn("cleaned", cleaned).withColumn(
        "parsed", F.when(F.col("value_type") == "number", parse_number(text))
    )
    no_target = F.coalesce("target_url", F.lit("")) == ""
    return s.withColumn("fix_value", F.col("parsed").isNotNull()).withColumn(
        "fix_citation", F.coalesce(F.col("cleaned") != text, F.lit(False))
    ).withColumn(
        "fix_target", F.coalesce((F.col("bridge_type") == "link_follow") & no_target & (F.col("page_url") != ""), F.lit(False))
    )


def repair_stops(stops: DataFrame) -> DataFrame:
    """Numbers stored as text, citation marks in text values, link bridges without a target.

    A text that carries a citation stays a text (without the mark), even where a number
    could be read from it.
    """
    s = _stop_fixes(stops)
    num = F.col("parsed")
    kind = F.when(num == F.floor(num), "int").otherwise("float")

    def choose(cleaned: Column, parsed: Column, stored: str) -> Column:
        return F.when(F.col("fix_citation"), cleaned).when(F.col("fix_value"), parsed).otherwise(F.col(stored))

    return s.select(
        *[c for c in stops.columns if c not in ("value_kind", "value_str", "value_num", "target_url")],
        choose(F.lit("string"), kind, "value_kind").alias("value_kind"),
        choose(F.col("cleaned"), number_text(num), "value_str").alias("value_str"),
        choose(F.lit(None).cast("double"), num, "value_num").alias("value_num"),
        F.when(F.col("fix_target"), F.col("page_url")).otherwise(F.col("target_url")).alias("target_url"),
    )


def _weekend(chain: DataFrame) -> Column:
    day = iso_date(F.try_element_at("args", F.lit("date")))
    return F.col("tool_name").isin(fixed.STOCK_TOOLS) & is_weekend(day)


def repair_chain(chain: DataFrame) -> DataFrame:
    """Weekend dates of stock tools become the Friday before; citation marks leave all arguments."""
    day = iso_date(F.try_element_at("args", F.lit("date")))
    friday = trading_day(day).cast("string")
    moved = F.when(
        _weekend(chain),
        F.transform_values("args", lambda k, v: F.when(k == "date", friday).otherwise(v)),
    ).otherwise(F.col("args"))
    return chain.withColumn("args", F.transform_values(moved, lambda _k, v: drop_citations(v)))


def passcode_fix(trails: DataFrame, stops: DataFrame) -> DataFrame:
    """Trails whose passcode differs from the digit of their compute stop."""
    facts = trail_facts(trails, stops).withColumn("digit", last_digit(F.col("last")))
    return facts.where((F.col("last.stop_type") == "compute") & F.col("digit").isNotNull() & ~F.equal_null("passcode", "digit")).select(
        "trail_id", F.col("passcode").alias("old_passcode"), F.col("digit").alias("passcode")
    )


def fix_counts(trails: DataFrame, stops: DataFrame, chain: DataFrame) -> DataFrame:
    """Fixes per trail and kind (also the dry run)."""
    def of(df: DataFrame, kind: str, times: Column) -> DataFrame:
        return df.select("trail_id", F.lit(kind).alias("fix"), times.cast("bigint").alias("times"))

    s = _stop_fixes(stops)
    stop_kinds = F.array_compact(
        F.array(
            F.when(F.col("fix_value"), "value_type_fixed"),
            F.when(F.col("fix_target"), "target_url_fixed"),
            F.when(F.col("fix_citation"), "citation_in_value_fixed"),
        )
    )
    at_stop = s.select("trail_id", F.explode(stop_kinds).alias("fix"), F.lit(1).cast("bigint").alias("times"))
    weekend = of(chain.where(_weekend(chain)), "weekend_date_fixed", F.lit(1))
    dirty = F.size(F.map_filter("args", lambda _k, v: drop_citations(v) != v))
    in_args = of(chain.where(dirty > 0), "citation_in_arg_fixed", dirty)
    code = of(passcode_fix(trails, stops), "passcode_fixed", F.lit(1))
    rows = at_stop.unionByName(weekend).unionByName(in_args).unionByName(code)
    return rows.groupBy("trail_id", "fix").agg(F.sum("times").alias("times"))


def repair(trails: DataFrame, stops: DataFrame, chain: DataFrame) -> Repaired:
    """All fixes; the passcode is set from the repaired last value of every changed trail."""
    fixes = fix_counts(trails, stops, chain)
    new_stops, new_chain = repair_stops(stops), repair_chain(chain)
    before = passcode_fix(trails, stops).select("trail_id", F.col("passcode").alias("first_digit"))
    after = trail_facts(trails, new_stops).select(
        "trail_id", F.when(F.col("last.stop_type") == "compute", last_digit(F.col("last"))).alias("last_digit")
    )
    changed = fixes.select("trail_id").distinct().withColumn("changed", F.lit(True))
    joined = trails.join(before, "trail_id", "left").join(after, "trail_id", "left").join(changed, "trail_id", "left")
    code = F.coalesce(F.when(F.col("changed"), F.col("last_digit")), F.col("first_digit"), F.col("passcode")).cast("bigint")
    new_trails = joined.withColumn("passcode", code).select(*trails.columns)
    return Repaired(new_trails, new_stops, new_chain, fixes)


def fix_totals(trails: DataFrame, fixes: DataFrame) -> DataFrame:
    """Fixes by level and kind, and trails touched (kind ``files``)."""
    leveled = fixes.join(trails.select("trail_id", "level"), "trail_id")
    kinds = leveled.groupBy("level", "fix").agg(F.sum("times").alias("times"))
    touched = leveled.select("level", "trail_id").distinct().groupBy("level").agg(F.count(F.lit(1)).alias("times"))
    return kinds.unionByName(touched.withColumn("fix", F.lit("files")))
