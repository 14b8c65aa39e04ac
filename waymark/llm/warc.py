"""WARC archives as a Spark data source.

Writing: each task writes files of bounded size below the path and reports their names; only a commit lists them in a manifest, so what lost
or repeated tasks left behind is never read. Reading: one partition per listed file. Filters on the record type and on other headers are
pushed into the reader, which parses headers first and skips the block of a record that isn't wanted; with the option
``payload`` set to false no block is decoded. Paths are opened through Arrow's file systems, so they may lie in any store that these reach.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from waymark.llm.common import BROADCAST_ROWS, heavy_keys, located, salted_join, staged

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Columns next to the header that each is read from.
HEADERS = {
    "warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
}
#: Columns of a frame to write: of these, and page_id and refers_to_page as headers of our own.
OWN = {"page_id": "X-Page-ID", "refers_to_page": "X-Refers-To-Page-ID"}
COLUMNS = HEADERS | OWN
FILE_BYTES = 64 * 1024 * 1024
BATCH_BYTES = 8 * 1024 * 1024


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def record(row: dict) -> bytes:
    """A record; the payload stands below HTTP headers, a revisit has the headers alone."""
    payload = row.get("payload") or b""
    length = len(payload) if row["payload_length"] is None else row["payload_length"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    if row["warc_type"] != "revisit":
        block += payload
    lines = [f"{header}: {one_line(row[column])}" for column, header in COLUMNS.items() if row.get(column) is not None]
    if row["warc_type"] == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
    head = "WARC/1.1\r\n" + "\r\n".join([*lines, "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]) + "\r\n\r\n"
    return head.encode("utf-8", "replace") + block + b"\r\n\r\n"


def one_line(value: object) -> str:
    """Line ends inside a header become percent codes."""
    return str(value).replace("\r", "%0D").replace("\n", "%0A")


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path.rstrip("/"), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = opened(self.path)
        store.create_dir(base, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    files.append(f"part-{uuid.uuid4().hex}.warc")
                    out, size = store.open_output_stream(f"{base}/{files[-1]}"), 0
                data = record(row)
                out.write(data)
                size += len(data)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = opened(self.path)
        store.create_dir(base, recursive=True)
        before = manifests(store, base) if self.overwrite else []
        with store.open_output_stream(f"{base}/manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())
        for path in before:
            store.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        store, base = opened(self.path)
        for name in (f for m in messages if m for f in m.files):
            store.delete_file(f"{base}/{name}")


def manifests(store: fs.FileSystem, base: str) -> list[str]:
    found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return sorted(x.path for x in found if x.base_name.startswith("manifest-"))


@dataclass
class WarcFile(InputPartition):
    name: str


def headers_of(lines: Iterable[bytes]) -> dict[str, str]:
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, payload: bool) -> None:
        self.path, self.names, self.payload = path.rstrip("/"), schema.names, payload
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in COLUMNS and isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)):
                self.tests.append((COLUMNS[column].lower(), type(f).__name__, getattr(f, "value", None)))
            else:
                yield f

    def wanted(self, headers: dict[str, str]) -> bool:
        for header, kind, value in self.tests:
            have = headers.get(header)
            if have is None or kind == "EqualTo" and have != value or kind == "In" and have not in value or kind == "StringStartsWith" and not have.startswith(value):
                return False
        return True

    def partitions(self) -> Sequence[WarcFile]:
        """The files of all manifests; without any, every .warc or .warc.gz file of the folder."""
        store, base = opened(self.path)
        names = [n for m in manifests(store, base) for n in json.loads(store.open_input_stream(m).read())]
        if not names:
            found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
            names = [x.base_name for x in found if x.base_name.endswith((".warc", ".warc.gz"))] if not manifests(store, base) else []
        return [WarcFile(n) for n in names]

    def read(self, partition: WarcFile | None) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, WarcFile):
            return
        store, base = opened(self.path)
        path = f"{base}/{partition.name}"
        packed = path.endswith(".gz")
        source = store.open_input_stream(path, compression="gzip") if packed else store.open_input_file(path)
        rows, held = [], 0
        with source as data:
            lines = Buffered(data, seekable=not packed)
            while (head := lines.head()) is not None:
                headers = headers_of(head)
                length = int(headers.get("content-length", "0"))
                if not self.wanted(headers):
                    lines.skip(length + 4)
                    continue
                row: dict = {c: headers.get(h.lower()) for c, h in COLUMNS.items()} | {"headers": headers, "content_length": length}
                if self.payload:
                    block = lines.take(length)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    row["payload"] = payload
                    lines.skip(4)
                else:
                    before = lines.at
                    http = b"\r\n".join(lines.head() or [])
                    lines.skip(length + 4 - (lines.at - before))
                said = headers_of(http.split(b"\r\n")[1:]).get("content-length")
                row["payload_length"] = int(said) if said is not None else None
                rows.append(row)
                held += length
                if held >= BATCH_BYTES or len(rows) >= 2000:
                    yield self.batch(rows)
                    rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"headers": pa.map_(pa.string(), pa.string()), "content_length": pa.int64(), "payload_length": pa.int64(), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([list(r[n].items()) if n == "headers" else r[n] for r in rows], kinds.get(n, pa.string())) for n in self.names], self.names)


class Buffered:
    """Reads a stream in large steps: header blocks, blocks of known length, and skips that seek where the stream can."""

    STEP = 1 << 18

    def __init__(self, source: pa.NativeFile, seekable: bool) -> None:
        self.source, self.seekable, self.data, self.pos, self.at = source, seekable, b"", 0, 0

    def more(self, least: int) -> bool:
        """Hold ``least`` bytes, if there are so many."""
        while len(self.data) - self.pos < least:
            step = self.source.read(max(self.STEP, least - (len(self.data) - self.pos)))
            if not step:
                return False
            self.data, self.pos = self.data[self.pos :] + step, 0
        return True

    def take(self, n: int) -> bytes:
        if not self.more(n):
            raise ValueError("a WARC record is cut short")
        out = self.data[self.pos : self.pos + n]
        self.pos += n
        self.at += n
        return out

    def skip(self, n: int) -> None:
        self.at += n
        have = len(self.data) - self.pos
        if n <= have:
            self.pos += n
            return
        self.data, self.pos, n = b"", 0, n - have
        if self.seekable:
            self.source.seek(self.source.tell() + n)
        else:
            while n > 0 and (step := self.source.read(min(n, self.STEP))):
                n -= len(step)

    def head(self) -> list[bytes] | None:
        """Lines up to an empty one; None at the end."""
        need = 1
        while (end := self.data.find(b"\r\n\r\n", self.pos)) < 0:
            need = len(self.data) - self.pos + 1
            if not self.more(need):
                return None
        lines = self.data[self.pos : end].split(b"\r\n")
        self.at += end + 4 - self.pos
        self.pos = end + 4
        return lines


class Warc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        text = ", ".join(f"{c} string" for c in COLUMNS)
        return f"{text}, headers map<string,string>, content_length long, payload_length long" + (", payload binary" if self.with_payload else "")

    @property
    def with_payload(self) -> bool:
        return str(self.options.get("payload", "true")).lower() != "false"

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema, self.with_payload)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format ``warc`` known to the session, and let its reader take filters."""
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def write_warc(records: DataFrame, path: str) -> None:
    """``records``: columns of COLUMNS (missing ones are left out), payload_length, payload."""
    register(records.sparkSession)
    records.write.format("warc").mode("append").save(path)


def page_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 100, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """A record per row, to be written by :func:`write_warc`.

    Of rows with equal payloads of ``least`` bytes or more, the one with the smallest key (null last; then by place in the files) is a response and
    the others revisit it; all other rows are responses. A null html is an empty payload, a null url has no header. Texts are taken whole,
    other columns aren't read. Digests travel, pre-aggregated; a digest that many rows have is dealt over tasks.
    """
    rows = located(pages.select(F.col(key).alias("key"), F.col(url).alias("target_uri"), F.encode(F.coalesce(html, F.lit("")), "UTF-8").alias("payload")))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "payload_length": F.octet_length("payload").cast("long"), "record_id": F.concat(F.lit("<urn:md5:"), F.md5(F.concat_ws("#", "locator.file", F.col("locator.row").cast("string"))), F.lit(">"))})
    order = F.struct(F.col("key").isNull().alias("none"), "key", "record_id")
    groups = rows.where(F.col("payload_length") >= least).groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = staged(groups.select("digest", "n", F.col("first.key").alias("first_key"), F.col("first.record_id").alias("first_id")), "payloads")
    n_groups, total = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n_groups <= BROADCAST_ROWS:
        found = rows.join(F.broadcast(groups.drop("n")), "digest", "left")
    else:
        found = salted_join(rows, groups.drop("n"), "digest", heavy_keys(groups, "digest", "n", total), F.col("record_id"))
    again = F.col("first_id").isNotNull() & (F.col("first_id") != F.col("record_id")) & (F.col("payload_length") >= least)
    return found.select(
        F.when(again, "revisit").otherwise("response").alias("warc_type"), "record_id", "target_uri", F.lit(date).alias("warc_date"), F.when(again, F.col("first_id")).alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"), F.col("key").cast("string").alias("page_id"), F.when(again, F.col("first_key")).cast("string").alias("refers_to_page"),
        "payload_length", F.when(~again, F.col("payload")).alias("payload"),
    )
