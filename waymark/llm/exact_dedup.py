"""Exact deduplication by stateful streaming.

Texts are equal when they are identical after lower-casing A-Z. A stream of (digest, identifier, content locator)
feeds a keyed aggregation whose state lies in RocksDB on the executors' disks and in the shared folder, and never expires:
per digest it holds the number of rows and the identifier and locator of the row that stays. Rows whose digest is held by
another row too (hits) are then checked on their full bytes; digests under which different texts meet are told apart there.

Everything runs as DataFrame functions. Shuffled are digests and locators of all rows (pre-aggregated per task), and the
texts of hits as grouping keys, also pre-aggregated, so that a text that holds a third of all rows travels once per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import at_rest, heavy_keys, located, lower_ascii, salted_join, settings, sized_semi_join, staged, without
from waymark.session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: State on disk, with bounded memory for all stores of an executor and without disk space that each reserves.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
}


def sha256(text):
    return F.unhex(F.sha2(text, 256))


def advance(digests: DataFrame, state_dir: str) -> None:
    """Run the stream over all rows that ``digests`` (a streaming frame of digest, id, locator) has to offer now.

    ``state_dir`` is the stream's checkpoint. A later call with the same folder goes on from the state that the
    earlier calls left there.
    """
    spark = digests.sparkSession
    with settings(spark, STATE):
        held = digests.groupBy("digest").agg(F.max(F.struct("id", "locator")).alias("keep"), F.count(F.lit(1)).alias("n"))
        run = held.writeStream.format("noop").outputMode("update").option("checkpointLocation", state_dir).trigger(availableNow=True).start()
        run.awaitTermination()


def held_state(spark: SparkSession, state_dir: str) -> DataFrame:
    """The keyed state as it is: digest, keep (id, locator), n."""
    with settings(spark, STATE):
        state = spark.read.format("statestore").load(state_dir)
        keep, n = (f.name for f in state.schema["value"].dataType.fields)
        key = state.schema["key"].dataType.fields[0].name
        return staged(state.select(F.col("key")[key].alias("digest"), F.col("value")[keep].alias("keep"), F.col("value")[n].alias("n")), "held")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", digest=sha256) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``locator``, ``keep_id``, ``keep_locator``, ``group_size``, ``kept``, ``digest``.

    Of equal texts the row with the largest ``key`` stays; of rows that also repeat the key, the one with the largest locator
    (file, row number). A null text counts as empty, a null key as smaller than any other. Long texts are read whole. An empty
    table gives an empty result. Other columns are not read, whatever their names. ``digest`` maps the normalised text to a
    binary key; weak ones give the same result, by the check on full bytes.
    """
    spark = docs.sparkSession
    norm = lower_ascii(F.col("text"))
    rows = located(docs.select(F.col(key).alias("id"), F.col(text).alias("text")))
    digests = staged(rows.select("id", digest(norm).alias("digest"), "locator"), "digests")
    folder = scratch_path(spark, "dedup-state")
    source = digests.inputFiles()
    if source:
        advance(spark.readStream.schema(digests.schema).parquet(source[0].rpartition("/")[0]), folder)
        state = held_state(spark, folder)
    else:
        state = digests.select("digest", F.struct("id", "locator").alias("keep"), F.lit(1).cast("long").alias("n"))
    copies = state.where("n > 1")
    n_copies, total = state.agg(F.count(F.when(F.col("n") > 1, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()

    hits = sized_semi_join(rows.select("id", "locator", digest(norm).alias("digest"), norm.alias("norm")), copies.select("digest"), ["digest"], n_copies)
    texts = staged(hits.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("same")).groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"), "collided")
    n_collided = texts.count()

    names = ["id", "locator", "digest", "keep", "n"]
    placed = salted_join(digests, copies, "digest", heavy_keys(copies, "digest", "n", total), F.col("locator"))
    out = placed.select("id", "locator", "digest", F.coalesce("keep", F.struct("id", "locator")).alias("keep"), F.coalesce("n", F.lit(1).cast("long")).alias("n"))
    if n_collided:
        apart = sized_semi_join(hits, texts, ["digest"], n_collided)
        groups = apart.groupBy("digest", "norm").agg(F.max(F.struct("id", "locator")).alias("keep"), F.count(F.lit(1)).alias("n"))
        out = sized_semi_join(out, texts, ["digest"], n_collided, "left_anti").unionByName(apart.join(groups, ["digest", "norm"]).select(*names))
    return out.select(
        F.col("id").alias(key), "locator", F.col("keep.id").alias("keep_id"), F.col("keep.locator").alias("keep_locator"), F.col("n").alias("group_size"),
        (F.col("locator") == F.col("keep.locator")).alias("kept"), "digest",
    )


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    docs = at_rest(docs)
    gone = staged(exact_dedup(docs, key, text).where(~F.col("kept")).select("locator"), "copies")
    return without(docs, gone, gone.count())
