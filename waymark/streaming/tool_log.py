"""The tool log as a stream: windows, sessions, running visit rate, late rows.

All jobs are plain streaming DataFrames; state is bounded by the watermark, or by the table of golden pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from waymark import fixed
from waymark.functions.skew import numbered
from waymark.functions.text import visit_url
from waymark.functions.values import share
from waymark.session import cut_lineage
from waymark.sources.readers import TOOL_LOG_SCHEMA

LATENESS = "10 minutes"


def read_log_stream(spark: SparkSession, path: str) -> DataFrame:
    """New log files as rows; malformed lines dropped; epoch seconds become event time."""
    raw = spark.readStream.schema(TOOL_LOG_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return raw.withColumn("ts", F.timestamp_micros((F.col("ts") * 1_000_000).cast("bigint")))


def read_event_stream(spark: SparkSession, schema, path: str, pattern: str) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)


def _counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("success")).alias("errors")]


def call_windows(log: DataFrame, width: str = "1 minute", lateness: str = LATENESS) -> DataFrame:
    """Calls and errors per trial and tumbling window; works on streams and tables alike."""
    marked = log.withWatermark("ts", lateness) if log.isStreaming else log
    g = marked.groupBy("trial_id", F.window("ts", width).alias("w")).agg(*_counts())
    return g.select("trial_id", F.col("w.start").alias("window_start"), "calls", "errors")


def call_sessions(log: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Sessions of a trial: calls closer than the trial time limit."""
    marked = log.withWatermark("ts", lateness) if log.isStreaming else log
    g = marked.groupBy("trial_id", F.session_window("ts", f"{fixed.TRIAL_SECONDS} seconds").alias("w")).agg(*_counts())
    return g.select("trial_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "calls", "errors")


def running_visits(log: DataFrame, stops: DataFrame) -> DataFrame:
    """First visit of each golden page per trial, as it happens; the table of golden pages is static.

    Only keys of golden pages enter the state, so it is bounded by their table and no visit comes twice, however late it is.
    """
    golden = stops.where("stop_type = 'page' AND page_url <> ''").select(F.col("trail_id").alias("trial_id"), visit_url(F.col("page_url")).alias("page")).distinct()
    seen = log.where("url <> ''").select("trial_id", "ts", visit_url(F.col("url")).alias("page"))
    if log.isStreaming:  # once, not with every micro-batch
        golden = cut_lineage(golden)
    hits = seen.join(golden, ["trial_id", "page"], "left_semi")
    if log.isStreaming:
        return hits.dropDuplicates(["trial_id", "page"])
    return hits.groupBy("trial_id", "page").agg(F.min("ts").alias("ts"))


# --- running visit rate --------------------------------------------------------------------

#: Golden pages that one word of a trial's bit map stands for.
WORD_BITS = 63


def golden_bits(stops: DataFrame) -> DataFrame:
    """(trial_id, page, word, bit): each distinct golden page of a trial has one bit in one word of the trial's map.

    Pages are numbered by the hash of their address, so a trial that holds a large share of all pages is numbered by many tasks.
    """
    pages = stops.where("stop_type = 'page' AND page_url <> ''").select(F.col("trail_id").alias("trial_id"), visit_url(F.col("page_url")).alias("page")).distinct()
    by_hash = F.xxhash64("page")
    placed = numbered(pages, ["trial_id"], [by_hash, F.col("page")], F.shiftright(by_hash, 54), "number", "pages")
    word, bit = F.floor(F.col("number") / WORD_BITS).cast("int"), F.expr(f"shiftleft(1L, CAST(number % {WORD_BITS} AS INT))")
    return placed.select("trial_id", "page", word.alias("word"), bit.alias("bit"))


def visit_words(log: DataFrame, bits: DataFrame) -> DataFrame:
    """Visited golden pages as words of a bit map: (trial_id, word, visited); works on streams (update mode) and tables alike.

    A repeated visit sets a bit that is set, so nothing is counted twice, however late it comes, and there is no watermark to wait
    for. The state has one number per word of a trial: it is bounded by the golden pages, not by the length of the log.
    """
    seen = log.where("url <> ''").select("trial_id", visit_url(F.col("url")).alias("page"))
    return seen.join(bits, ["trial_id", "page"]).groupBy("trial_id", "word").agg(F.bit_or("bit").alias("visited"))


def visit_rates(words: DataFrame, bits: DataFrame) -> DataFrame:
    """(trial_id, pages, hits, pages_visited) of every trial with golden pages, from words of any number of batches."""
    pages = bits.groupBy("trial_id").agg(F.count(F.lit(1)).alias("pages"))
    last = words.groupBy("trial_id", "word").agg(F.bit_or("visited").alias("visited"))
    hits = last.groupBy("trial_id").agg(F.sum(F.bit_count("visited")).alias("hits"))
    both = pages.join(hits, "trial_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("bigint")))
    return both.select("trial_id", "pages", "hits", share(F.col("hits"), F.col("pages")).alias("pages_visited"))


def keep_visits(log: DataFrame, bits: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived: the words that a micro-batch changed go to ``target``/batch=n, replaced as a whole if the batch is repeated."""

    def store(words: DataFrame, batch: int) -> None:
        words.write.mode("overwrite").parquet(f"{target}/batch={batch}")

    started = visit_words(log, bits).writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint)
    return _finish(started)


# --- late rows -----------------------------------------------------------------------------


def late_rows(progress: list[dict]) -> int:
    """Rows dropped as late, summed over the progress reports of a query."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in progress for op in p.get("stateOperators", []))


class Arrivals(StreamingQueryListener):
    """What each micro-batch of the named query observed: rows, late ones, and the latest event time."""

    def __init__(self, name: str) -> None:
        self.name, self.batches = name, {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None and seen["n"]:
            self.batches[event.progress.batchId] = (seen["n"], seen["latest"])

    def onQueryTerminated(self, event) -> None:
        pass


def split_late(log: DataFrame, target: str, checkpoint: str, lateness: str = LATENESS, name: str = "arrivals") -> StreamingQuery:
    """Process what has arrived and keep the late rows instead of dropping them.

    A row is late if its time is before the mark: the latest time of all earlier micro-batches less ``lateness``. Rows go to ``target``/rows,
    split by (batch, late), and the mark after each batch to ``target``/marks: both are replaced as a whole if a batch is
    repeated, and the mark that a batch is split by is always that of the batch before, so a repeated batch splits the same way.
    Rows without a time are never late. ``Arrivals(name)`` reports each batch.
    """
    spark = log.sparkSession

    def store(rows: DataFrame, batch: int) -> None:
        mark = None
        if batch:
            mark = spark.read.schema("mark timestamp").parquet(f"{target}/marks/batch={batch - 1}").first()["mark"]
        late = F.coalesce(F.col("ts") < F.lit(mark).cast("timestamp"), F.lit(False))
        split = f"{target}/rows/batch={batch}"
        rows.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(split)
        back = spark.read.schema(rows.schema).option("recursiveFileLookup", "true").parquet(split)
        latest = F.max(F.col("ts")) - F.expr(f"INTERVAL {lateness}")
        back.agg(F.greatest(latest, F.lit(mark).cast("timestamp")).alias("mark")).write.mode("overwrite").parquet(f"{target}/marks/batch={batch}")

    watched = log.observe(name, F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest"))
    return _finish(watched.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint))


def read_split(spark: SparkSession, target: str, schema) -> DataFrame:
    """Rows kept by :func:`split_late`, with ``batch`` and ``late``."""
    fields = StructType([*schema.fields, StructField("batch", LongType()), StructField("late", BooleanType())])
    return spark.read.schema(fields).parquet(f"{target}/rows")


def _finish(writer) -> StreamingQuery:
    started = writer.trigger(availableNow=True).start()
    started.awaitTermination()
    return started


def run_once(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything available and stop; the sink is a Parquet folder."""
    return _finish(stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode(mode))
