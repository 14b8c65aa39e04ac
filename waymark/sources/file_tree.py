"""A sink of files: each row (rel_path, content) becomes a file of its own, and a job's files appear all or not at all.

A task writes to a folder of its own below ``_staged`` and hands its name to the driver as the commit message; the driver writes the names of the
tasks that count to a manifest. What a failed, repeated or lost attempt wrote is in no manifest, so it never appears. Publishing moves
the files of the manifest to their places, many tasks at a time; it goes over a file that is moved already, so it can be repeated too.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

STAGED, MANIFESTS = "_staged", "_manifest"

#: Folder of a tree for files that are kept packed, many in one Parquet file.
PACKED = "_packed"


@dataclass
class Attempt(WriterCommitMessage):
    """What one task wrote: the name of its folder, files and bytes."""

    name: str
    files: int
    size: int


def _text(store: fs.FileSystem, path: str) -> str:
    with store.open_input_stream(path) as f:
        return f.read().decode()


def _put(store: fs.FileSystem, path: str, content: str) -> None:
    """Write a small file in one step: aside first, then moved to its place."""
    store.create_dir(path.rpartition("/")[0], recursive=True)
    aside = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(aside) as f:
        f.write(content.encode())
    _move(store, aside, path)


def _move(store: fs.FileSystem, source: str, target: str) -> None:
    if store.get_file_info(target).type == fs.FileType.File:
        store.delete_file(target)
    store.move(source, target)


class FileTreeWriter(DataSourceArrowWriter):
    def __init__(self, path: str, job: str) -> None:
        self.path, self.job = path, job

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        store, base = fs.FileSystem.from_uri(self.path)
        out = Attempt(uuid.uuid4().hex, 0, 0)
        root, made = f"{base}/{STAGED}/{self.job}/{out.name}", set()
        store.create_dir(root, recursive=True)
        for batch in iterator:
            for rel_path, content in zip(batch.column("rel_path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                target, data = f"{root}/{rel_path}", (content or "").encode()
                folder = target.rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(target) as f:
                    f.write(data)
                out.files, out.size = out.files + 1, out.size + len(data)
        return out

    def commit(self, messages: list[Attempt | None]) -> None:
        store, base = fs.FileSystem.from_uri(self.path)
        rows = [{"attempt": m.name, "files": m.files, "size": m.size} for m in messages if m is not None]
        _put(store, f"{base}/{MANIFESTS}/{self.job}.json", json.dumps(rows))

    def abort(self, messages: list[Attempt | None]) -> None:
        store, base = fs.FileSystem.from_uri(self.path)
        discard(store, f"{base}/{STAGED}/{self.job}")


class FileTree(DataSource):
    """Options: ``path`` (a URI or an absolute path) and ``job``, a name that the manifest gets."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return "rel_path string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> FileTreeWriter:
        return FileTreeWriter(self.options["path"], self.options["job"])


def discard(store: fs.FileSystem, folder: str) -> None:
    if store.get_file_info(folder).type == fs.FileType.Directory:
        store.delete_dir(folder)


def manifest(path: str, job: str) -> list[dict]:
    """Attempts that count, one per task of the job."""
    store, base = fs.FileSystem.from_uri(path)
    return json.loads(_text(store, f"{base}/{MANIFESTS}/{job}.json"))


def publish(spark: SparkSession, path: str, job: str) -> None:
    """Move the files of a committed job to their places, a task per attempt, and mark the job as done; safe to repeat."""
    attempts = [(m["attempt"],) for m in manifest(path, job) if m["files"]]

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        for batch in batches:
            for attempt in batch.column("attempt").to_pylist():
                root = f"{base}/{STAGED}/{job}/{attempt}"
                made = set()
                for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True)):
                    if info.type != fs.FileType.File:
                        continue
                    target = base + info.path[len(root) :]
                    folder = target.rpartition("/")[0]
                    if folder not in made:
                        store.create_dir(folder, recursive=True)
                        made.add(folder)
                    _move(store, info.path, target)
            yield batch

    if attempts:
        rows = spark.createDataFrame(attempts, "attempt string").repartition(len(attempts))
        rows.mapInArrow(move, "attempt string").write.format("noop").mode("overwrite").save()
    store, base = fs.FileSystem.from_uri(path)
    discard(store, f"{base}/{STAGED}/{job}")
    _put(store, f"{base}/{MANIFESTS}/{job}.done", "")


def write_tree(files: DataFrame, path: str) -> str:
    """Write and publish; the name of the job. Of rows with one path any one is kept."""
    spark, job = files.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(FileTree)
    files.select("rel_path", "content").write.format("file_tree").option("path", path).option("job", job).mode("append").save()
    publish(spark, path, job)
    return job
