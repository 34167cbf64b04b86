"""Archive volumes: one file for a whole volume, read by several tasks.

A volume begins with a header of 24 bytes. Behind it come records, each a signed length and one
bzip2 stream, as an intermediate chunk has them; in older volumes the messages follow as they are.
Records have no sync marks, so a task that takes a range of a file steps over the lengths before
its range, a few bytes each, and reads what begins inside it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..runtime import prepare
from . import chunks

SCHEMA = "site string, volume_seq long, chunk_no int, kind string, path string, offset long, content binary, error string"
BUFFER = 1 << 20
TASK_BYTES = 64 << 20  # a task reads no more than about that many


class Span(NamedTuple):
    """A part of a file: what begins at start or behind it, and before end."""

    name: str
    start: int
    end: int
    size: int


@dataclass
class Spans(InputPartition):
    """What one task reads."""

    spans: list[Span]


def _open(address: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(address)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.split, self.tasks = options["path"], int(options.get("split_bytes", 4 << 20)), int(options.get("tasks", 64))

    def partitions(self) -> list[Spans]:
        """Files cut into ranges, which are dealt to the tasks. Only names and sizes are read here.

        The number of tasks follows the bytes and not the files, as a task costs more than a small file does;
        ranges of a file go to different tasks.
        """
        from pyarrow import fs

        store, base = _open(self.folder)
        files = [x for x in store.get_file_info(fs.FileSelector(base, recursive=True)) if x.is_file and not x.base_name.startswith((".", "_"))]
        spans = [Span(x.path[len(base) :], a, min(a + self.split, x.size), x.size) for x in sorted(files, key=lambda x: x.path) for a in range(0, max(x.size, 1), self.split)]
        tasks = max(1, min(len(spans), max(self.tasks, sum(x.size for x in files) // TASK_BYTES)))
        return [Spans(spans[i::tasks]) for i in range(tasks)]

    def read(self, part: Spans) -> Iterator[pa.RecordBatch]:
        store, base = _open(self.folder)
        held, size = [], 0
        for span in part.spans:
            for row in self._rows(store, f"{base}{span.name}", span):
                held.append(row)
                size += len(row[6] or b"")
                if size >= BUFFER or len(held) >= 1000:
                    yield _batch(held)
                    held, size = [], 0
        if held:
            yield _batch(held)

    def _rows(self, store, path: str, part: Span) -> Iterator[tuple]:
        with store.open_input_file(path) as f:
            head = f.read_at(min(part.size, 32), 0)
            if len(head) < chunks.VOLUME_HEADER or head[:4] not in (b"AR2V", b"ARCH"):
                if part.start == 0:
                    yield None, None, 0, None, path, 0, None, "TooShort" if len(head) < chunks.VOLUME_HEADER else "UnrecognizedFormat"
                return
            key = head[20:24].decode("latin-1"), int.from_bytes(head[12:16], "big") * 86_400_000 + int.from_bytes(head[16:20], "big")
            yield from self._records(f, path, part, key) if head[28:31] == b"BZh" else self._messages(f, path, part, key)

    def _records(self, f, path: str, part: Span, key: tuple) -> Iterator[tuple]:
        at, number = chunks.VOLUME_HEADER, 0
        while at + 4 <= part.size and at < part.end:
            size = abs(int.from_bytes(f.read_at(4, at), "big", signed=True))
            if at >= part.start:
                content = f.read_at(min(4 + size, part.size - at), at)
                yield *key, number, "R", path, at, size.to_bytes(4, "big") + content[4:], None if len(content) == 4 + size else "TooShort"
            at, number = at + 4 + size, number + 1

    def _messages(self, f, path: str, part: Span, key: tuple) -> Iterator[tuple]:
        """The whole messages that begin in the range, as one record; headers before it are read through a buffer."""
        at, begins, ends = chunks.VOLUME_HEADER, None, part.size
        low, held = 0, b""
        while at + chunks.BODY <= part.size:
            if at >= part.start and begins is None:
                begins = at
            if at >= part.end:
                ends = at
                break
            if at + chunks.BODY > low + len(held) or at < low:
                low, held = at, f.read_at(min(BUFFER, part.size - at), at)
            at += chunks.message_bytes(held[at - low : at - low + chunks.BODY])
        if begins is not None and begins < part.end:
            yield *key, begins, "P", path, begins, f.read_at(ends - begins, begins), None


class ArchiveVolumes(DataSource):
    """spark.read.format("radar_archive").load(folder): a row per record, by the bytes where it begins."""

    @classmethod
    def name(cls) -> str:
        return "radar_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def read_archives(spark: SparkSession, folder: str, split_bytes: int = 4 << 20) -> DataFrame:
    """Records of all archive volumes below a folder (an address of a file system that pyarrow knows).

    site and volume_seq (the header's milliseconds since its day 0) tell the volume, chunk_no numbers its
    records, or holds the offset of a stretch of plain messages. kind: R (bzip2) or P (plain). What is no volume has one error row,
    a record that is cut off an error beside what there is of it.
    """
    prepare(spark)
    spark.dataSource.register(ArchiveVolumes)
    return spark.read.format("radar_archive").option("split_bytes", split_bytes).option("tasks", max(64, 4 * spark.sparkContext.defaultParallelism)).load(folder)


def unwrap(content: bytes | None, kind: str, limit: int) -> bytes:
    if content is None or kind not in ("R", "P"):
        raise chunks.ChunkError("UnrecognizedFormat")
    if kind == "R":
        return chunks.decompress(content, "I", limit)
    if len(content) > limit:
        raise chunks.ChunkError("DecompressedTooLarge")
    return content


def decode_archives(records: DataFrame, limit: int = chunks.LIMIT, products: tuple[str, ...] = chunks.PRODUCTS) -> DataFrame:
    """chunks.decode() for records of archives; those that carry an error keep it."""
    return chunks.decode(records, limit, products, unwrap)
