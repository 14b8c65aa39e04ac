"""Writers: trail documents, page tables, task files, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark import fixed
from waymark.functions.skew import kept_here, shuffled
from waymark.sources.file_tree import PACKED, write_tree

K = ["trail_id", "stop_index"]


def _of(df: DataFrame, name: str, kind: str = "string") -> Column:
    """A column of ``df``, null where it has none of that name."""
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)


def _with_list(text: Column, depth: int, name: str, rows: Column) -> Column:
    """JSON text of an object with one more field, a list of JSON texts, at the end of the object that ``depth`` braces close."""
    listed = F.concat(F.lit(f',"{name}":['), F.array_join(F.coalesce(rows, F.array().cast("array<string>")), ","), F.lit("]" + "}" * depth))
    return F.concat(text.substr(F.lit(1), F.length(text) - depth), listed)


def trail_documents(trails: DataFrame, stops: DataFrame, chain: DataFrame, deps: DataFrame) -> DataFrame:
    """(level, value): one JSON document per trail with every stored field. A trail is one document, so its stops share a row by definition.

    Fields that a table has no column for are null. A value keeps its JSON kind; one that JSON can't write as a number (NaN) is written as text.
    Steps and stops are made to text once and put into the text of their stop and document, without being parsed again.
    """
    full = {"ignoreNullFields": "false"}
    call = F.struct("tool_name", F.col("args").alias("arguments"), _of(chain, "output_key").alias("output_key"), _of(chain, "expected_output").alias("expected_output"))
    steps = chain.select(*K, "step", F.to_json(call, full).alias("j")).groupBy(*K).agg(F.array_sort(F.collect_list(F.struct("step", "j"))).alias("steps"))
    edges = deps.groupBy(*K).agg(F.array_sort(F.collect_list("dep")).alias("depends_on"))
    s = stops.join(shuffled(steps), K, "left").join(shuffled(edges), K, "left")
    text = F.col("value_str").cast("variant")
    value = F.when(F.col("value_kind") == "null", F.parse_json(F.lit("null"))).when(F.col("value_kind") == "string", text).otherwise(F.coalesce(F.try_parse_json("value_str"), text))
    bridge = F.struct(
        *[_of(s, n).alias(n) for n in ("bridge_type", "target_url", "search_query", "expected_result_url", "expression", "expression_code")],
        _of(s, "referenced_stops", "array<bigint>").alias("referenced_stops"),
    )
    stop = F.struct(
        F.col("stored_index").alias("index"), *[_of(s, n).alias(n) for n in ("stop_type", "page_url", "extraction_target", "extraction_section")],
        value.alias("extracted_value"), F.col("value_type").alias("extracted_value_type"), *[_of(s, n).alias(n) for n in ("reasoning", "reason_transform", "reason_code")],
        _of(s, "reason_source_stop", "bigint").alias("reason_source_stop"), F.coalesce("depends_on", F.array().cast("array<bigint>")).alias("depends_on"), bridge.alias("bridge"),
    )
    # the bridge is the last field of a stop, its chain the last one of the bridge
    rows = s.select("trail_id", "stop_index", "steps", kept_here(F.to_json(stop, full)).alias("j"))
    rows = rows.select("trail_id", "stop_index", _with_list(F.col("j"), 2, "tool_chain", F.col("steps.j")).alias("j"))
    packed = rows.groupBy("trail_id").agg(F.array_sort(F.collect_list(F.struct("stop_index", "j"))).alias("stops"))
    t = trails.join(shuffled(packed), "trail_id", "left")
    document = F.struct(
        F.col("trail_id").cast("string").alias("trail_id"), *[_of(t, n).alias(n) for n in ("seed_url", "seed_title", "riddle", "generated_at")], F.col("passcode"),
        F.try_parse_json(_of(t, "metadata")).alias("metadata"), F.struct("level").alias("difficulty"),
    )
    t = t.select("level", "stops", kept_here(F.to_json(document, full)).alias("j"))
    return t.select("level", _with_list(F.col("j"), 1, "stops", F.col("stops.j")).alias("value"))


def write_files(files: DataFrame, path: str) -> None:
    """Write each row (rel_path, content) as a file of its own below ``path``; files appear once all tasks are through (see :mod:`waymark.sources.file_tree`)."""
    write_tree(files, path)


def pack_files(files: DataFrame, path: str) -> None:
    """Keep rows (rel_path, content) packed below ``path``, many files in one. A small file of its own takes a block of the disk, and so does each
    of its folders; readers of trial folders read both forms, so a path should be in one of them only."""
    files.select("rel_path", "content").write.mode("append").option("compression", "zstd").parquet(f"{path.rstrip('/')}/{PACKED}")


def write_trails(documents: DataFrame, path: str) -> None:
    """Trail documents as packed JSON lines (field names make most of a document), one folder per level."""
    documents.write.mode("overwrite").partitionBy("level").option("compression", "gzip").text(path)


def page_keys(pages: DataFrame) -> DataFrame:
    """Key index of a page table."""
    return pages.select(F.substring(F.sha2("url", 256), 1, 16).alias("key"), "url")


def write_pages(page_info: DataFrame, path: str) -> None:
    """Page rows as Parquet with their key; raw text stays a column of its own, so pruning can drop it."""
    page_info.withColumn("key", F.substring(F.sha2("url", 256), 1, 16)).write.mode("overwrite").parquet(path)


def task_files(tasks: DataFrame, templates: DataFrame, existing: DataFrame, overwrite: bool = False) -> DataFrame:
    """File rows of accepted puzzles: ``templates(rel_path, content)`` filled per task.

    ``templates`` is the set of files of one task. Placeholders in braces take the values of the task.
    """
    ok = task_verdicts(tasks, existing, overwrite).where("reason IS NULL").select("task_id")
    t = tasks.join(ok, "task_id", "left_semi")
    timeout = F.when(F.col("level").isin(fixed.LEVELS), F.lit(f"{fixed.TRIAL_SECONDS}.0")).otherwise("900.0")
    values = {"seed_url": F.col("seed_url"), "riddle": F.col("riddle"), "difficulty": F.col("level"), "agent_timeout": timeout, "passcode": F.col("passcode").cast("string")}
    content = F.col("content")
    for name, value in values.items():
        content = F.replace(content, F.lit("{" + name + "}"), value)
    # the files of one task travel as an array of their own, not as a table that each executor holds
    files = templates.agg(F.collect_list(F.struct("rel_path", "content")).alias("files"))
    return t.join(F.broadcast(files)).select("*", F.inline("files")).select("task_id", "rel_path", content.alias("content"))


def task_verdicts(tasks: DataFrame, existing: DataFrame, overwrite: bool = False) -> DataFrame:
    """Reason a puzzle is skipped (null: exported): no riddle, passcode out of range, already there."""
    there = existing.select("task_id").distinct().withColumn("there", F.lit(True))
    bad = F.coalesce(~F.col("passcode").between(0, 9), F.lit(True))
    reason = (
        F.when(F.coalesce("riddle", F.lit("")) == "", "no riddle").when(bad, "invalid passcode")
        .when(F.col("there").isNotNull() & F.lit(not overwrite), "already exists")
    )
    return tasks.join(there, "task_id", "left").select("task_id", "level", reason.alias("reason"))


def next_sample_number(files: DataFrame) -> DataFrame:
    """Number for the next sample per level: ``files(level, name)``; last name plus one, else the file count."""
    last = F.regexp_extract(F.max("name"), r"_(\d+)\.json$", 1).try_cast("int")
    return files.groupBy("level").agg(F.coalesce(last + 1, F.count(F.lit(1)).cast("int")).alias("next_number"))


def write_evaluation(summary: DataFrame, results: DataFrame, path: str) -> None:
    """Evaluation output: a one-row summary next to the results table."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    results.write.mode("overwrite").json(f"{path}/results")


def write_report(report_long: DataFrame, path: str, fmt: str = "csv") -> None:
    """Metric report; one small file, as its rows are a fixed list of metrics."""
    report_long.orderBy("position").drop("position").coalesce(1).write.mode("overwrite").option("header", True).format(fmt).save(path)
