"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rows up to which a side may be broadcast; its size is counted first. Beyond it the side is shuffled.
BROADCAST_ROWS = 50_000

#: Rows with texts that cross to Python at a time.
TEXT_ROWS = 500

#: Copies of the small side, and sub-groups of the rows, of a hot key.
SALTS = 32


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z, nothing else; null becomes empty."""
    return F.translate(F.coalesce(col, F.lit("")), UPPER, UPPER.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: one computation, and nothing to redo when an executor is lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame) -> DataFrame:
    """Whole texts cross to Python in batches of few rows, so that a worker's memory holds little beside its longest texts. Sets the session's batch size."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    return df


def place() -> Column:
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def at_rest(docs: DataFrame, name: str = "docs") -> DataFrame:
    """``docs`` itself if its rows have places in files, else a written copy of it."""
    if docs.inputFiles():
        try:
            docs.select(place())
            return docs
        except AnalysisException:  # derived from files, not read as they are
            pass
    return staged(docs, name)


def located(docs: DataFrame, name: str = "locator") -> DataFrame:
    """Add the place of each row: file and row number in it. A frame that isn't read from files is written first."""
    return at_rest(docs, name).select("*", place().alias(name))


def without(docs: DataFrame, gone: DataFrame, n_gone: int) -> DataFrame:
    """The rows of ``docs``, which lies in files, that are not at the places in ``gone`` (locator)."""
    name = "__place"
    while name in docs.columns:
        name += "_"
    return sized_semi_join(located(docs, name), gone.select(F.col("locator").alias(name)), [name], n_gone, "left_anti").drop(name)


def sized_semi_join(rows: DataFrame, keys: DataFrame, on: list[str], n_keys: int, how: str = "left_semi") -> DataFrame:
    """Semi or anti join of wide rows; ``keys`` (``n_keys`` rows, counted by the caller) is broadcast only while small."""
    return rows.join(F.broadcast(keys) if n_keys <= BROADCAST_ROWS else keys, on, how)


def heavy_keys(counts: DataFrame, key: str, n: str, total: int, parts: int = 1000) -> DataFrame:
    """Keys that hold more than 1/``parts`` of all rows: fewer than ``parts`` of them by arithmetic, so a broadcast is bounded."""
    return F.broadcast(counts.where(F.col(n) * parts > total).select(key))


def salted_join(rows: DataFrame, side: DataFrame, key: str, heavy: DataFrame, spread: Column, how: str = "left", salts: int = SALTS) -> DataFrame:
    """Join ``side`` (one row per key) to ``rows``, with the rows of heavy keys dealt over ``salts`` tasks.

    ``heavy`` has the hot keys (see :func:`heavy_keys`); ``spread`` differs between the rows of a key. A null key matches nothing.
    """
    hot = heavy.withColumn("__hot", F.lit(True))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    left = rows.join(hot, key, "left").withColumn("__salt", salt).drop("__hot")
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = side.join(hot, key, "left").withColumn("__salt", F.explode(copies)).drop("__hot")
    return left.join(right, [key, "__salt"], how).drop("__salt")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
