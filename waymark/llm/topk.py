"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments, and an index has each distinct code under each of its segment values. A query looks up all values within radius r
of its own segments; codes met there are verified by their full Hamming distance. If all segments of a code are further away than r, its distance
is at least segments * (r + 1), so a query is done once its kth distance is below that; radii grow until all queries are. A pair
is taken only where it is met first (the least segment distance, then the least segment), so no pair is taken twice in all rounds, and only if it
is as near as the query's kth so far.

Equal codes are searched once, as query and as row, with their first k identifiers. Segment values that many codes share are dealt over tasks.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.skew import first_per_key
from waymark.llm.common import heavy_keys, salted_join, staged

BITS = 16
#: Queries that meet the index in one row, about.
QUERIES_PER_BLOCK = 1000


def sign_codes(rows: DataFrame, key: str, vector: str, bits: int = BITS) -> DataFrame:
    """id, code (as text), segs: bit i is set where component i is above 0. Missing components and NaN are not; a null vector has no code."""
    width = rows.agg(F.max(F.size(vector))).first()[0] or 0
    value = lambda i: F.try_element_at(F.col("vector"), i + 1)
    on = lambda i: F.when(F.isnan(value(i)), False).otherwise(F.coalesce(value(i) > 0, F.lit(False))).cast("long")
    segs = F.array(*[sum((on(F.lit(s + b)) * (1 << b) for b in range(min(bits, width - s))), F.lit(0).cast("long")) for s in range(0, width, bits)] or [F.lit(0).cast("long")])
    named = rows.select(F.col(key).alias("id"), F.col(vector).alias("vector")).where("vector is not null")
    return named.select("id", segs.alias("segs")).withColumn("code", F.concat_ws(",", F.transform("segs", lambda x: x.cast("string"))))


def apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def masks(bits: int, radius: int) -> list[int]:
    return [sum(1 << i for i in at) for at in itertools.combinations(range(bits), radius)]


def search(codes: DataFrame, queries: DataFrame, k: int, bits: int = BITS, first_radius: int = 2) -> DataFrame:
    """id, rank (from 1), neighbour, distance: the k nearest rows of ``codes`` to each row of ``queries``, both from :func:`sign_codes`.

    Ordered by distance, then identifier (null last); a row that is in both finds itself. Fewer than k rows give all of them. Repeated rows count
    each. Rounds start with all radii up to ``first_radius``.
    """
    order = [F.col("id").asc_nulls_last()]
    firsts = first_per_key(codes, ["code"], order, k)
    holder = F.sort_array(F.collect_list(F.struct(F.col("id").isNull().alias("none"), "id")))
    classes = staged(firsts.groupBy("code").agg(F.first("segs").alias("segs"), holder.alias("ids")), "classes")
    wanted = staged(queries.groupBy("code").agg(F.first("segs").alias("segs"), F.count(F.lit(1)).alias("n")), "wanted")
    at = F.posexplode("segs").alias("j", "v")
    place = (F.col("j").cast("long") * (1 << 40) + F.col("v")).alias("place")
    index = classes.select("code", "segs", at).select("code", "segs", "j", place)
    sizes = staged(index.groupBy("place").agg(F.count(F.lit(1)).alias("n")), "sizes")
    total, count = (sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], (classes.agg(F.max(F.size("segs"))).first()[0] or 0))
    heavy = heavy_keys(sizes, "place", "n", total)
    spark = codes.sparkSession
    active, best = staged(wanted.select("code", "segs", F.lit(None).cast("int").alias("kth")), "active"), None
    asked = active.count()
    blocks = 1 + asked // QUERIES_PER_BLOCK
    radius, reach = 0, first_radius
    while count and asked:
        flips = spark.createDataFrame([(r, m) for r in range(radius, reach + 1) for m in masks(bits, r)], "r int, m long")
        own = active.select(F.col("code").alias("q"), F.col("segs").alias("qsegs"), "kth", at).withColumn("r", F.explode(F.array(*map(F.lit, range(radius, reach + 1)))))
        probes = own.join(F.broadcast(flips), "r").withColumn("place", F.col("j").cast("long") * (1 << 40) + F.col("v").bitwiseXOR(F.col("m")))
        # queries that look at one place go there together, and only what can still be among the k nearest leaves it
        asks = probes.groupBy("place", F.pmod(F.xxhash64("q"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("q", "qsegs", "r", "kth")).alias("asks"))
        met = salted_join(index, asks, "place", heavy, F.col("code"), "inner")
        parts = lambda a: F.transform(F.arrays_zip(F.col("segs").alias("a"), a["qsegs"].alias("b")), lambda z: apart(z["a"], z["b"]))
        measured = F.transform("asks", lambda a: F.struct(a["q"].alias("q"), a["r"].alias("r"), a["kth"].alias("kth"), parts(a).alias("d")))
        summed = F.transform(measured, lambda a: F.struct(a["q"].alias("q"), a["r"].alias("r"), a["kth"].alias("kth"), a["d"].alias("d"), F.aggregate(a["d"], F.lit(0), lambda s, x: s + x).alias("distance")))
        first = lambda a: (F.array_min(a["d"]) == a["r"]) & (F.array_position(a["d"], a["r"]) == F.col("j") + 1)
        near = F.filter(summed, lambda a: first(a) & (a["kth"].isNull() | (a["distance"] <= a["kth"])))
        fresh = met.select("code", F.explode(near).alias("x")).select("code", "x.q", "x.distance")
        # each code holds an id at least, so the k nearest codes and those as near are enough
        near_codes = fresh.withColumn("at", F.rank().over(Window.partitionBy("q").orderBy("distance"))).where(F.col("at") <= k)
        named = near_codes.join(classes.select("code", "ids"), "code").select("q", "distance", F.explode("ids").alias("x")).select("q", "distance", "x.none", "x.id")
        both = named if best is None else named.unionByName(best)
        best = staged(first_per_key(both, ["q"], [F.col("distance"), F.col("none"), F.col("id")], k), "best")
        if reach >= bits:
            break
        kth = best.groupBy(F.col("q").alias("code")).agg(F.count(F.lit(1)).alias("found"), F.max("distance").alias("worst")).where(F.col("found") >= k)
        going = active.drop("kth").join(kth, "code", "left").where(F.col("worst").isNull() | (F.col("worst") >= count * (reach + 1)))
        active = staged(going.select("code", "segs", F.col("worst").alias("kth")), "active")
        asked = active.count()
        radius, reach = reach + 1, reach + 1
    if best is None:
        return queries.select("id", F.lit(1).alias("rank"), F.col("id").alias("neighbour"), F.lit(0).alias("distance")).limit(0)
    hits = F.sort_array(F.collect_list(F.struct("distance", "none", F.col("id").alias("neighbour"))))
    lists = best.groupBy("q").agg(hits.alias("hits")).withColumnRenamed("q", "code")
    rows = queries.count()
    out = salted_join(queries.select("id", "code"), lists, "code", heavy_keys(wanted, "code", "n", rows), F.col("id"), "inner")
    return out.select("id", F.posexplode("hits").alias("at", "x")).select("id", (F.col("at") + 1).alias("rank"), F.col("x.neighbour").alias("neighbour"), F.col("x.distance").alias("distance"))
