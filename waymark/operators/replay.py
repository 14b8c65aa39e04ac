"""Replay of whole trails, agreement over trials, refreshed golden values.

``replay_stops(trail_id, stop_index, stop_type, expected, actual, match, error)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.numbers import recompute
from waymark.functions.skew import shuffled
from waymark.functions.values import close, to_float, whole
from waymark.operators import transforms
from waymark.operators.facts import look_up
from waymark.operators.replies import replay_chains
from waymark.session import written

K = ["trail_id", "stop_index"]


def _out(df: DataFrame, actual: Column, match: Column, error: Column) -> DataFrame:
    return df.select(
        *K, "stop_type", F.col("value_str").alias("expected"), actual.alias("actual"),
        F.coalesce(match, F.lit(False)).alias("match"), error.cast("string").alias("error"),
    )


def replay_pages(stops: DataFrame, pages: DataFrame) -> DataFrame:
    """A page stop succeeds once its page exists; the stored value stands in where it is not found."""
    s = look_up(stops.where("stop_type = 'page'"), pages)
    there = F.col("there")
    error = F.when(F.coalesce("page_url", F.lit("")) == "", "no page URL").when(~there, "page not found")
    return _out(s, F.when(there, F.coalesce("found", "value_str")), there, error)


def replay_tools(stops: DataFrame, chain: DataFrame, replies: DataFrame, max_steps: int | None = None) -> DataFrame:
    """Tool chains against the replies; a stop without a stored value accepts what it gets."""
    values = replay_chains(chain, replies, max_steps).select(*K, "value", F.lit(True).alias("chained"))
    s = stops.where("stop_type = 'tool'").join(values, K, "left")
    v = F.col("value")
    error = F.when(F.col("chained").isNull(), "empty tool chain").when(v.isNull(), "tool chain returned no value")
    return _out(s, v, v.isNotNull() & (F.col("value_str").isNull() | close(v, F.col("value_str"))), error)


def replay_code(stops: DataFrame) -> DataFrame:
    """Reason and compute stops recomputed from their closed forms."""
    s = stops.where("stop_type IN ('reason', 'compute')")
    source = stops.select("trail_id", F.col("stop_index").alias("reason_source_stop"), F.col("value_str").alias("__value"), F.col("value_type").alias("__kind"))
    named = s.where("stop_type = 'reason'").join(source, ["trail_id", "reason_source_stop"], "left")
    asked = named.select(*K, "stop_type", F.col("value_str").alias("stored"), "reason_transform", F.col("__value").alias("value_str"), F.col("__kind").alias("value_type"))
    reason = transforms.apply_named(asked, "reason_transform").withColumn("value_str", F.col("stored"))
    compute = s.where("stop_type = 'compute'").withColumn("result", recompute(F.col("expression")))
    both = reason.select(*K, "stop_type", "value_str", "result", F.col("reason_transform").alias("code")).unionByName(
        compute.select(*K, "stop_type", "value_str", "result", F.col("expression").alias("code"))
    )
    same = F.col("value_str").isNull() | (to_float(F.col("value_str")) == F.col("result"))
    return _out(both, F.col("result").cast("string"), F.col("result").isNotNull() & same, F.when(F.col("code").isNull(), "no code"))


def replay_stops(stops: DataFrame, chain: DataFrame, pages: DataFrame, replies: DataFrame, max_steps: int | None = None) -> DataFrame:
    odd = stops.where("stop_type NOT IN ('page', 'tool', 'reason', 'compute')")
    unknown = _out(odd, F.lit(None).cast("string"), F.lit(False), F.concat(F.lit("unknown stop type: "), F.col("stop_type")))
    parts = [replay_pages(stops, pages), replay_tools(stops, chain, replies, max_steps), replay_code(stops), unknown]
    return reduce(DataFrame.unionByName, parts)


def replay_trails(replayed: DataFrame) -> DataFrame:
    """Success and passcode per trail; tool and reason stops with a value count as matched."""
    ok = F.when(F.col("stop_type").isin("tool", "reason") & F.col("actual").isNotNull(), True).otherwise(F.col("match"))
    g = replayed.groupBy("trail_id").agg(F.bool_and(ok).alias("success"), F.max_by(F.struct("actual"), "stop_index").alias("last"))
    return g.select("trail_id", "success", F.coalesce(F.pmod(whole(to_float(F.col("last.actual"))), F.lit(10)), F.lit(-1)).alias("passcode"))


def consistency(trials: DataFrame) -> DataFrame:
    """Share of trials close to the first value: ``trials(trial, trail_id, stop_index, stop_type, actual, has_forecast)``."""
    first = trials.groupBy(*K).agg(F.min_by("actual", F.when(F.col("actual").isNotNull(), F.col("trial"))).alias("reference"))
    near = F.col("reference").isNotNull() & close(F.col("actual"), F.col("reference"))
    return (
        trials.join(first, K)
        .groupBy(*K)
        .agg(
            F.first("stop_type").alias("stop_type"), F.max("has_forecast").alias("has_forecast"), F.max(F.col("reference").isNotNull()).alias("any_value"),
            (F.count_if(near) / F.count(F.lit(1))).alias("consistency"),
        )
    )


def consistency_issues(trials: DataFrame) -> DataFrame:
    """Stops without any value, unstable page, compute and non-forecast tool stops, and changing passcodes."""
    c = consistency(trials)
    low, kind = F.col("consistency") < 1, F.col("stop_type")
    issue = (
        F.when(~F.col("any_value"), "no_value")
        .when(low & kind.isin("page", "compute"), "unstable_value")
        .when(low & (kind == "tool") & ~F.col("has_forecast"), "unstable_tool")
    )
    at_stop = c.select(*K, issue.alias("issue")).where("issue IS NOT NULL")
    codes = trials.groupBy("trail_id", "trial").agg(F.max_by(F.struct("actual"), "stop_index").alias("last"))
    digit = F.coalesce(F.pmod(whole(to_float(F.col("last.actual"))), F.lit(10)), F.lit(-1))
    per = codes.groupBy("trail_id").agg(F.min(digit).alias("lo"), F.max(digit).alias("hi")).where("lo <> hi")
    return at_stop.unionByName(per.select("trail_id", F.lit(None).cast("bigint").alias("stop_index"), F.lit("passcode_changes").alias("issue")))


def search_stability(stops: DataFrame, search_replies: DataFrame) -> DataFrame:
    """Search bridges whose expected page is missing from the reply: ``search_replies(search_query, output)``.

    A bridge without a reply is counted but is no failure.
    """
    s = stops.where("bridge_type = 'search_query' AND search_query <> ''").select(*K, "search_query", F.coalesce("expected_result_url", F.lit("")).alias("want"))
    missing = (F.col("want") != "") & ~F.contains("output", F.col("want"))
    return (
        s.join(search_replies, "search_query", "left")
        .groupBy("trail_id")
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(missing).alias("failures"))
        .withColumn("unstable", F.col("failures") > F.greatest(F.lit(1), F.floor(F.col("total") / 2)))
    )


def refresh(trails: DataFrame, stops: DataFrame, replayed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trails, stops) with replayed tool and compute values and passcodes, and whether a row ``changed``; failed trails stay as they are."""
    good = replay_trails(replayed).where("success").select("trail_id", F.col("passcode").alias("new_passcode"))
    new = replayed.where("stop_type IN ('tool', 'compute') AND actual IS NOT NULL").join(good.select("trail_id"), "trail_id", "left_semi").select(*K, "actual")
    return _with_values(trails, good, stops, new)


def _with_values(trails: DataFrame, codes: DataFrame, stops: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    s = stops.join(shuffled(values), K, "left").withColumn("changed", F.coalesce(~F.col("actual").eqNullSafe(F.col("value_str")) & F.col("actual").isNotNull(), F.lit(False)))
    s = s.withColumn("value_str", F.coalesce("actual", "value_str")).withColumn("value_num", F.coalesce(to_float(F.col("actual")), F.col("value_num"))).drop("actual")
    t = trails.join(shuffled(codes), "trail_id", "left")
    t = t.withColumn("changed", F.coalesce(F.col("new_passcode") != F.col("passcode"), F.lit(False))).withColumn("passcode", F.coalesce("new_passcode", "passcode").cast("bigint"))
    return t.drop("new_passcode"), s


#: Parts of a store: a change rewrites the parts it is in.
PARTS = 64


def write_store(trails: DataFrame, stops: DataFrame, path: str, parts: int = PARTS) -> None:
    """Trails and stops as Parquet folders below ``path``, dealt into parts by trail; the number of parts belongs to the store."""
    for name, rows in (("trails", trails), ("stops", stops)):
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("trail_id"), F.lit(parts)).cast("int"))
        dealt.repartition("part", F.pmod(F.xxhash64("trail_id", F.lit("file")), F.lit(4))).write.partitionBy("part").parquet(f"{path}/{name}")


def refresh_store(spark: SparkSession, path: str, replayed: DataFrame) -> list[int]:
    """Refresh a store in place (see :func:`refresh`); the parts that were rewritten.

    Only parts with a changed row are written, by dynamic partition overwrite: the files of all others are neither read again nor touched.
    The new content lies aside, in Spark's staging folder, until all of it is written and replaces the old, so no other copy of a part is
    made. A repeated refresh changes nothing more.
    """
    replayed = written(replayed.select(*K, "stop_type", "actual", "match"), "replayed")
    good = written(replay_trails(replayed).where("success").select("trail_id", F.col("passcode").alias("new_passcode")), "good")
    new = replayed.where("stop_type IN ('tool', 'compute') AND actual IS NOT NULL").join(shuffled(good.select("trail_id")), "trail_id", "left_semi").select(*K, "actual")
    # of the values only those that differ from the stored ones, so that little is joined to the rows of a part
    stored = spark.read.parquet(f"{path}/stops").where("stop_type IN ('tool', 'compute')").select(*K, "value_str", "value_num")
    number = F.coalesce(to_float(F.col("actual")), F.col("value_num"))
    differs = ~F.col("actual").eqNullSafe(F.col("value_str")) | ~number.eqNullSafe(F.col("value_num"))
    new = written(new.join(shuffled(stored), K).where(differs).select(*K, "actual"), "new")

    def now() -> tuple[DataFrame, DataFrame]:
        return _with_values(spark.read.parquet(f"{path}/trails"), good, spark.read.parquet(f"{path}/stops"), new)

    touched: set[int] = set()
    for name, rows in zip(("trails", "stops"), now(), strict=True):
        parts = [r["part"] for r in rows.where("changed").select("part").distinct().collect()]  # at most the parts of the store
        if parts:
            fresh = rows.where(F.col("part").isin(parts)).drop("changed")
            fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{path}/{name}")
        touched.update(parts)
    return sorted(touched)
