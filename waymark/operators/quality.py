"""Quality gates for seed pages and crawled graphs.

Page rows carry ``title, page_length, n_links, n_sections, infobox, first_paragraph, raw_markdown`` and
the arrival position ``ord``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark import fixed
from waymark.functions.text import strip, words
from waymark.functions.values import let
from waymark.operators.dims import level_config


def is_bad_title(title: Column) -> Column:
    return (
        F.rlike(title, F.lit(fixed.BAD_TITLE))
        | F.rlike(title, F.lit(fixed.FICTION_TITLE))
        | (F.length(title) <= 2)
        | F.rlike(strip(title), F.lit(r"(?U)^\d+$"))
    )


def is_taxonomy(box: Column) -> Column:
    """At least four taxonomy keys that make up 40 % of the infobox."""
    hits = F.size(F.filter(box, lambda f: F.regexp_replace(strip(F.lower(f["key"])), ":+$", "").isin(fixed.TAXONOMY_KEYS)))
    return (hits >= 4) & (hits / F.size(box) >= 0.4)


def is_english(lead: Column, markdown: Column) -> Column:
    """At least 70 % ASCII in the lead, else in a sample of the body; short texts pass."""
    text = F.when(F.length(F.coalesce(lead, F.lit(""))) < 50, F.coalesce(F.nullif(F.substring(markdown, 501, 2000), F.lit("")), lead)).otherwise(lead)

    def judge(t: Column) -> Column:
        ascii_chars = F.length(F.regexp_replace(t, r"[^\x00-\x7F]", ""))
        return F.when(F.coalesce(F.length(t), F.lit(0)) < 50, F.lit(True)).otherwise(ascii_chars / F.length(t) >= 0.7)

    return let(text, judge)


def has_number(box: Column) -> Column:
    return F.exists(box, lambda f: f["numeric_value"].isNotNull() | F.rlike(f["value"], F.lit(r"(?U)\d")))


def seed_gate(pages: DataFrame, min_length: int = 5000, min_links: int = 15, min_sections: int = 4, min_fields: int = 3) -> DataFrame:
    """First failed test of each page (null: passed) and its fallback score."""
    box = F.col("infobox")
    reason = (
        F.when(is_bad_title(F.col("title")), "bad_title")
        .when(F.col("page_length") < min_length, "too_short")
        .when(F.col("n_links") < min_links, "few_links")
        .when(F.col("n_sections") < min_sections, "few_sections")
        .when(~is_english(F.col("first_paragraph"), F.col("raw_markdown")), "not_english")
        .when(is_taxonomy(box), "taxonomy")
        .when(F.size(box) < min_fields, "few_fields")
        .when(~has_number(box), "no_number")
    )
    score = F.col("page_length") + 100 * F.col("n_links") + 50 * F.col("n_sections")
    return pages.withColumn("reject_reason", reason).withColumn("score", F.when(F.col("reject_reason").isin("few_fields", "no_number"), score))


def choose_seed(gated: DataFrame) -> DataFrame:
    """First passing page by position, else the best fallback (first one on ties)."""
    ok = F.when(F.col("reject_reason").isNull(), F.col("ord"))
    best = F.when(F.col("score") > 0, F.struct("score", (-F.col("ord")).alias("neg")))
    picked = gated.agg(
        F.min(ok).alias("ok"), F.max(best).alias("best")
    ).select(F.coalesce("ok", -F.col("best.neg")).alias("ord"), F.col("ok").isNull().alias("is_fallback"))
    return gated.join(F.broadcast(picked), "ord").select("ord", "title", "is_fallback")


def reject_counts(gated: DataFrame) -> DataFrame:
    return gated.groupBy(F.coalesce("reject_reason", F.lit("passed")).alias("outcome")).agg(F.count(F.lit(1)).alias("pages"))


def majority(rows: DataFrame, key: str, *item: str) -> DataFrame:
    """(key, top): how many rows the item has that more than half of a key's rows share; keys without such an item are left out.

    If an item has more than half of the rows, each bit of its hash has it too, so the bits that are set in most rows name the only candidate:
    one fixed set of counters per key, added up in any order, instead of a row per item. A second count keeps the candidates that hold.
    """
    hashed = rows.select(key, *item, F.xxhash64(*[F.col(c).isNull() for c in item], *item).alias("__h"))
    bits = [F.sum(F.call_function("shiftright", F.col("__h"), F.lit(i)).bitwiseAND(1)).alias(f"b{i}") for i in range(64)]
    counted = hashed.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), *bits)
    set_bits = [F.when(F.col(f"b{i}") * 2 > F.col("__n"), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)) for i in range(64)]
    candidate = reduce(lambda x, y: x.bitwiseOR(y), set_bits)
    candidates = counted.select(key, candidate.alias("__h"), "__n")
    held = hashed.join(candidates, [key, "__h"]).groupBy(key, *item).agg(F.count(F.lit(1)).alias("top"), F.first("__n").alias("__n"))
    return held.where(F.col("top") * 2 > F.col("__n")).select(key, "top")


def graph_gate(pages: DataFrame, graphs: DataFrame) -> DataFrame:
    """First reason a crawled graph is unfit (null: fit): ``pages(graph_id, title, infobox)``, ``graphs(graph_id, level)``."""
    box = F.col("infobox")
    prefix = F.lower(F.array_join(F.slice(words(F.col("title")), 1, 2), " "))
    rows = pages.select("graph_id", prefix.alias("prefix"), (F.size(box) > 0).alias("boxed"), ((F.size(box) > 0) & has_number(box)).alias("numeric"))
    sums = rows.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("boxed").alias("boxed"), F.count_if("numeric").alias("numeric"))
    narrow = majority(rows, "graph_id", "prefix").select("graph_id", F.lit(True).alias("narrow"))
    g = graphs.join(level_config(pages.sparkSession), "level").join(sums, "graph_id", "left").join(narrow, "graph_id", "left").fillna(0, ["n", "boxed", "numeric"])
    need = F.greatest(F.lit(3), F.floor(F.col("depth_min") / 2))
    reason = (
        F.when(F.col("n") < F.col("depth_min"), "few_pages")
        .when(F.col("boxed") < need, "few_infobox_pages")
        .when((F.col("n") >= 8) & F.col("narrow").isNotNull(), "narrow_topic")
        .when(F.col("numeric") < 2, "few_numeric_pages")
    )
    return g.select("graph_id", "level", reason.alias("reject_reason"))
