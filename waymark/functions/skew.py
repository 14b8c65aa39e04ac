"""Ranking helpers that stay balanced when one key holds a large share of all rows.

A plain ``row_number() over (partition by key)`` sends a whole key to one task. Here rows are
numbered inside (key, bucket), where the bucket is a coarse, order-preserving view of the sort
columns, and bucket sizes are turned into offsets by a window over one small row per bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.session import written


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    value: Column,
    out: str,
    total: str | None = None,
) -> DataFrame:
    """Sum of ``value`` over the rows of the key before each row, by ``order``.

    ``bucket`` must be non-null and must not decrease along ``order``. ``total`` also adds the
    sum over the whole key.
    """
    keys = list(keys)
    tagged = df.withColumn("__b", bucket).withColumn("__v", value.cast("bigint"))
    sizes = tagged.groupBy(*keys, "__b").agg(F.sum("__v").alias("__n"))
    by_key = Window.partitionBy(*keys)
    offsets = sizes.select(
        *keys,
        "__b",
        F.coalesce(
            F.sum("__n").over(by_key.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("__off"),
        *([F.sum("__n").over(by_key).alias(total)] if total else []),
    )
    inside = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = tagged.withColumn("__rs", F.coalesce(F.sum("__v").over(inside), F.lit(0)))
    placed = local.join(offsets, [*keys, "__b"])
    return placed.withColumn(out, (F.col("__off") + F.col("__rs")).cast("bigint")).drop("__b", "__v", "__off", "__rs")


def dense_index(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    out: str,
    total: str | None = None,
) -> DataFrame:
    """0-based position of each row inside its key, by ``order``; see :func:`running_sum`."""
    return running_sum(df, keys, order, bucket, F.lit(1), out, total)


#: Rows of a table that one task works on where a row costs much (pages that are parsed).
ROWS_PER_TASK = 10_000


def spread(df: DataFrame, key: str, rows: int = ROWS_PER_TASK) -> DataFrame:
    """A stored table dealt over tasks by its rows.

    Spark cuts a scan by bytes, so a table of few bytes and costly rows would be left to one task. The rows are counted from the
    file footers; a table of one task's rows stays as it is.
    """
    parts = -(-df.count() // rows)
    return df.repartition(parts, key) if parts > 1 else df


def kept_here(col: Column) -> Column:
    """A column that is worked out once, where it stands.

    Spark copies a built text into every expression on it and moves conditions on it below an exchange, back to the few tasks of the scan;
    it does neither with a column that it doesn't take for deterministic.
    """
    return F.when(F.monotonically_increasing_id() >= 0, col)


def shuffled(df: DataFrame) -> DataFrame:
    """A join side that is never broadcast. Spark sizes a side by the bytes of its files and default lengths of texts, which is far too low for unpacked arrays and built texts."""
    return df.hint("merge")


#: Rows up to which a join side may be held by every executor.
HELD_ROWS = 50_000


def counted(side: DataFrame) -> DataFrame:
    """A join side that is worked out and written once and counted: held by every executor while it is small, else shuffled."""
    side = written(side, "side")
    return F.broadcast(side) if side.count() <= HELD_ROWS else shuffled(side)


def join_counted(df: DataFrame, side: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a :func:`counted` side."""
    return df.join(counted(side), list(on), how)


#: Values of a trail up to which they travel as one array with each of its stops.
ARRAY_ROWS = 1_000


def hot_keys(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame | None:
    """Keys with more than ``rows`` rows, None when there are none."""
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > rows).drop("__n")
    return None if hot.isEmpty() else hot


def with_earlier(stops: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """``stops`` with ``__all``, the (stop_index, value) pairs of the trail in order, and ``n_before``, how many of them are of earlier stops.

    The earlier ones come first, so an ordinal below ``n_before`` finds one of them. Only for trails of up to ``ARRAY_ROWS`` values.
    """
    pairs = F.collect_list(F.struct("stop_index", value))
    lists = values.groupBy("trail_id").agg(F.array_sort(pairs).alias("__all"))
    before = F.filter("__all", lambda x: x["stop_index"] < F.col("stop_index"))
    s = stops.join(shuffled(lists), "trail_id", "left")
    return s.withColumn("n_before", F.coalesce(F.when(F.col("__all").isNotNull(), F.size(before)), F.lit(0)).cast("bigint"))


#: Rows of a key up to which one task numbers them all.
HOT_ROWS = 100_000


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, out: str, total: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """:func:`dense_index` and the size of each key, at the cost of one window where no key is hot.

    Keys are counted first; only those with more than ``hot_rows`` rows are numbered by buckets.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_rows).drop("__n")
    by_key = Window.partitionBy(*keys)

    def plain(rows: DataFrame) -> DataFrame:
        return rows.withColumns({out: (F.row_number().over(by_key.orderBy(*order)) - 1).cast("bigint"), total: F.count(F.lit(1)).over(by_key)})

    if sizes.isEmpty():
        return plain(df)
    hot = dense_index(df.join(sizes, list(keys), "left_semi"), keys, order, bucket, out, total)
    return plain(df.join(sizes, list(keys), "left_anti")).unionByName(hot)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """First ``k`` rows of each key.

    ``k`` is a literal, so Spark cuts each map partition to ``k`` rows per key before the
    shuffle (window group limit): a hot key never travels whole.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rk", F.row_number().over(w)).where(F.col("__rk") <= k).drop("__rk")


def first_upto(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: Column, salts: int = 64
) -> DataFrame:
    """First ``limit`` rows of each key, where the limit is a column.

    The literal cut of :func:`first_per_key` does not apply to a column limit, so rows are cut
    inside salted sub-groups first and inside the key afterwards.
    """
    salt = F.pmod(F.xxhash64(*order), F.lit(salts))
    inner = Window.partitionBy(*keys, "__salt").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("__salt", salt)
        .withColumn("__rk", F.row_number().over(inner))
        .where(F.col("__rk") <= limit)
        .withColumn("__rk", F.row_number().over(outer))
        .where(F.col("__rk") <= limit)
        .drop("__salt", "__rk")
    )


def draw_order(seed: int, salt: str, *cols: str) -> Column:
    """Repeatable pseudo-random sort key: md5 over seed, salt and the id columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols], F.lit(salt)))


def draw_int(seed: int, salt: str, *cols: str) -> Column:
    """Repeatable pseudo-random integer in 0 .. 2^32-1 from the same md5."""
    return F.conv(F.substring(draw_order(seed, salt, *cols), 1, 8), 16, 10).cast("bigint")
