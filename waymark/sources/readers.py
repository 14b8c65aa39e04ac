"""Readers: trail corpora, export tasks, page tables, seed lists, tool logs, trial folders."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.skew import kept_here
from waymark.session import written
from waymark.sources.file_tree import PACKED

TOOL_LOG_SCHEMA = "trial_id BIGINT, seq BIGINT, tool STRING, args MAP<STRING,STRING>, success BOOLEAN, result_preview STRING, result_len BIGINT, ts DOUBLE, url STRING"


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Whole files below a folder with their path relative to it; hidden names are left out."""
    base = re.escape(path.rstrip("/"))
    df = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    rel = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), f"^.*?{base}/+", "")
    return df.select(F.col("value").alias("text"), rel.alias("rel"))


def _packed_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """As :func:`_files`, for the files that :func:`waymark.sources.writers.pack_files` put below the folder; none where nothing is packed."""
    schema = "rel_path string, content string"
    try:
        df = spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{PACKED}")
    except AnalysisException:
        df = spark.createDataFrame([], schema)
    name = re.escape(pattern).replace(r"\*", "[^/]*").replace(r"\{", "(").replace(r"\}", ")").replace(",", "|")
    return df.where(F.rlike("rel_path", F.lit(f"(^|/){name}$"))).select(F.coalesce("content", F.lit("")).alias("text"), F.col("rel_path").alias("rel"))


def _v(path: str, kind: str) -> Column:
    return F.try_variant_get("doc", path, kind)


def read_documents(spark: SparkSession, path: str, max_samples: int | None = None) -> DataFrame:
    """Trail documents of a corpus: one JSON file each, in level folders or flat.

    With level folders only files one level down count. Kept are documents with stops and a
    riddle, in path order: (sample_id, level, doc).
    """
    files = _files(spark, path, "*.json").withColumn("parts", F.split("rel", "/")).where(F.size("parts") <= 2)
    nested = F.broadcast(files.agg(F.max(F.size("parts")).alias("depth")))
    d = files.join(nested).where(F.size("parts") == F.col("depth")).withColumn("doc", F.try_parse_json("text"))
    d = d.where(_v("$.stops", "variant").isNotNull() & (_v("$.riddle", "string") != ""))
    stem = F.regexp_replace(F.element_at("parts", -1), r"\.json$", "")
    folder = F.when(F.col("depth") == 2, F.col("parts")[0])
    level = F.coalesce(folder, _v("$.difficulty.level", "string"))
    out = d.select(F.concat_ws("/", level, stem).alias("sample_id"), level.alias("level"), "rel", "doc")
    return out.drop("rel") if max_samples is None else out.orderBy("rel").limit(max_samples).drop("rel")


def read_document_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trail documents stored one per line, as :func:`waymark.sources.writers.write_trails` does."""
    # parsed once: the condition would else be moved below, with a parsing of its own
    d = spark.read.text(path).select(kept_here(F.try_parse_json("value")).alias("doc"))
    d = d.where(_v("$.stops", "variant").isNotNull())
    level = _v("$.difficulty.level", "string")
    return d.select(F.concat_ws("/", level, _v("$.trail_id", "string")).alias("sample_id"), level.alias("level"), "doc")


def trails(documents: DataFrame) -> DataFrame:
    """Trail rows with their defaults."""
    return documents.select(
        "sample_id", F.coalesce(_v("$.trail_id", "string"), F.lit("")).alias("trail_id"), F.coalesce(_v("$.difficulty.level", "string"), F.lit("easy")).alias("level"),
        F.coalesce(_v("$.passcode", "bigint"), F.lit(-1)).alias("passcode"), F.coalesce(_v("$.seed_url", "string"), F.lit("")).alias("seed_url"),
        F.coalesce(_v("$.seed_title", "string"), F.lit("")).alias("seed_title"), F.coalesce(_v("$.riddle", "string"), F.lit("")).alias("riddle"),
        F.coalesce(_v("$.generated_at", "string"), F.lit("")).alias("generated_at"), F.to_json(_v("$.metadata", "variant")).alias("metadata"),
    )


def _stop_rows(documents: DataFrame) -> DataFrame:
    rows = documents.select(_v("$.trail_id", "string").alias("trail_id"), F.posexplode(_v("$.stops", "array<variant>")).alias("pos", "doc"))
    return rows.withColumn("stop_index", F.col("pos").cast("bigint"))


def stops(documents: DataFrame) -> DataFrame:
    """One row per stop with its defaults and the kind, text and number of its value."""
    raw = _v("$.extracted_value", "variant")
    shape = F.schema_of_variant(raw)
    kind = (
        F.when(raw.isNull() | (shape == "VOID"), "null").when(shape == "STRING", "string").when(shape == "BIGINT", "int")
        .when(F.rlike(shape, F.lit("^(DECIMAL|DOUBLE|FLOAT)")), "float").when(shape == "BOOLEAN", "bool").otherwise("json")
    )
    text = _v("$.extracted_value", "string")
    number = F.when(kind.isin("int", "float"), _v("$.extracted_value", "double"))
    shown = F.when((kind == "float") & ~F.rlike(text, F.lit(r"[.eE]")), F.concat(text, F.lit(".0"))).when(kind == "json", F.to_json(raw)).otherwise(text)

    def text_of(path: str, default: str | None = None) -> Column:
        c = _v(path, "string")
        return c if default is None else F.coalesce(c, F.lit(default))

    return _stop_rows(documents).select(
        "trail_id", "stop_index", F.coalesce(_v("$.index", "bigint"), F.lit(0)).alias("stored_index"), text_of("$.stop_type", "page").alias("stop_type"), text_of("$.page_url").alias("page_url"),
        text_of("$.extraction_target", "").alias("extraction_target"), text_of("$.extraction_section").alias("extraction_section"), kind.alias("value_kind"),
        F.when(kind != "null", shown).alias("value_str"), number.alias("value_num"), text_of("$.extracted_value_type", "text").alias("value_type"),
        text_of("$.bridge.bridge_type", "link_follow").alias("bridge_type"), text_of("$.bridge.target_url").alias("target_url"), text_of("$.bridge.search_query").alias("search_query"),
        text_of("$.bridge.expected_result_url").alias("expected_result_url"), text_of("$.bridge.expression").alias("expression"),
        text_of("$.bridge.expression_code").alias("expression_code"), _v("$.bridge.referenced_stops", "array<bigint>").alias("referenced_stops"),
        text_of("$.reasoning", "").alias("reasoning"), text_of("$.reason_transform").alias("reason_transform"), text_of("$.reason_code").alias("reason_code"),
        _v("$.reason_source_stop", "bigint").alias("reason_source_stop"),
    )


def chain(documents: DataFrame) -> DataFrame:
    """One row per tool-chain step; argument values as texts."""
    s = _stop_rows(documents).select("trail_id", "stop_index", F.posexplode(_v("$.bridge.tool_chain", "array<variant>")).alias("step", "doc"))
    args = F.transform_values(_v("$.arguments", "map<string,variant>"), lambda _k, v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))
    return s.select("trail_id", "stop_index", "step", F.coalesce(_v("$.tool_name", "string"), F.lit("")).alias("tool_name"), args.alias("args"), _v("$.output_key", "string").alias("output_key"), _v("$.expected_output", "string").alias("expected_output"))


def deps(documents: DataFrame) -> DataFrame:
    """One row per dependency; entries that are no integers have a null ``dep``."""
    s = _stop_rows(documents).select("trail_id", "stop_index", F.explode(_v("$.depends_on", "array<variant>")).alias("doc"))
    return s.select("trail_id", "stop_index", F.when(F.schema_of_variant("doc") == "BIGINT", _v("$", "bigint")).alias("dep"))


def read_tasks(spark: SparkSession, path: str, level: str | None = None, limit: int | None = None) -> DataFrame:
    """Puzzles to export: id from level folder and file name, riddle-less ones dropped."""
    d = read_documents(spark, path)
    if level is not None:
        d = d.where(F.col("level") == level)
    t = trails(d).withColumn("task_id", F.replace("sample_id", F.lit("/"), F.lit("-")))
    return t if limit is None else t.orderBy("task_id").limit(limit)


def read_page_cache(spark: SparkSession, pages_path: str, index_path: str) -> DataFrame:
    """Cached pages through their index (url, file); missing and broken files drop out."""
    index = spark.read.schema("url STRING, file STRING").json(index_path)
    files = _files(spark, pages_path, "*.json").select(F.element_at(F.split("rel", "/"), -1).alias("file"), F.try_parse_json("text").alias("doc")).where("doc IS NOT NULL")
    return index.join(files, "file").select("url", _v("$.title", "string").alias("title"), _v("$.raw_markdown", "string").alias("markdown"), _v("$.pageviews", "bigint").alias("pageviews"))


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seed URLs, one per line; blanks and ``#`` comments dropped; an empty list is an error."""
    seeds = spark.read.text(path).select(F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("url")).where("url <> '' AND NOT startswith(url, '#')")
    if seeds.isEmpty():
        raise ValueError(f"no seed URLs in {path}")
    return seeds


def read_tool_log(spark: SparkSession, path: str) -> DataFrame:
    """Tool-call log lines; blank and malformed ones are skipped."""
    return spark.read.schema(TOOL_LOG_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def _trial_part(files: DataFrame, tail: str) -> DataFrame:
    f = files.where(F.endswith("rel", F.lit(tail)))
    return f.select(F.split("rel", "/")[0].alias("trial"), "text", F.try_parse_json("text").alias("doc"))


def read_trials(spark: SparkSession, job_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(results, rewards, steps, reward_texts) of a job folder, for :func:`waymark.operators.reports.trial_rows`. Its files lie there as they are or packed."""
    # the folders are listed and the files opened once for all parts
    names = "{result,reward,trajectory}.{json,txt}"
    files = written(_files(spark, job_dir, names), "files").unionByName(_packed_files(spark, job_dir, names))
    r = _trial_part(files, "/result.json").where("doc IS NOT NULL")
    exc = _v("$.exception_info", "variant")
    results = r.select(
        "trial", F.when(F.schema_of_variant(exc) == "STRING", _v("$.exception_info", "string")).when(F.schema_of_variant(exc) != "VOID", F.to_json(exc)).alias("exception_info"),
        _v("$.agent_result.n_input_tokens", "bigint").alias("n_input_tokens"), _v("$.agent_result.n_output_tokens", "bigint").alias("n_output_tokens"),
        _v("$.agent_execution.started_at", "string").alias("started_at"), _v("$.agent_execution.finished_at", "string").alias("finished_at"),
    )
    w = _trial_part(files, "/verifier/reward.json")
    kinds = {
        "status": "string", "status_reason": "string", "answered": "double", "agent_answer": "string", "expected_answer": "string", "total_tool_calls": "bigint",
        "valid_tool_calls": "bigint", "right_tool_calls": "bigint", "golden_chain_length": "bigint", "pages_visited": "double", "tools_used": "double",
        "intermediate_correct": "bigint", "intermediate_total": "bigint", "intermediate_rate": "double", "ground_truth_steps": "bigint",
    }
    rewards = w.select("trial", *[_v(f"$.{n}", t).alias(n) for n, t in kinds.items()])
    t = _trial_part(files, "/agent/trajectory.json")
    steps = t.select("trial", F.explode(_v("$.steps", "array<variant>")).alias("doc")).select("trial", _v("$.source", "string").alias("source"))
    texts = _trial_part(files, "/verifier/reward.txt").select("trial", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))
    return results, rewards, steps, texts


def read_job_config(spark: SparkSession, job_dir: str) -> DataFrame:
    """Name and model of the first agent of a job, else ``unknown``."""
    try:  # the one file, so that the folders of the trials aren't listed again
        text = spark.read.option("wholetext", True).text(f"{job_dir.rstrip('/')}/config.json")
    except AnalysisException:
        text = spark.createDataFrame([], "value string")
    c = text.select(F.try_parse_json("value").alias("doc"))
    return c.select(*[F.coalesce(_v(f"$.agents[0].{n}", "string"), F.lit("unknown")).alias(a) for n, a in (("name", "agent"), ("model_name", "model"))])
