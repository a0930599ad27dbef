"""The two binary layouts, little-endian: log files and sorted segment files, as DataFrame sources and sinks.

Log record: u32 key length, key, u32 value length, value, i64 expiry, u8 deleted.
Segment record: u32 key length, u32 value length, i64 expiry, u8 deleted, key, value.
Neither has a checksum or a footer, so a record can be read only after all before it; a file is the unit of a task.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Entry = tuple[str, bytes, int, bool]
#: Numbers between those of a file's parts and the next file's.
PARTS = 10_000


class TornRecord(ValueError):
    """A file ends inside a record; ``rows`` are those before it."""

    def __init__(self, rows: int):
        super().__init__(f"the file ends inside record {rows}")
        self.rows = rows


def log_record(key: bytes, value: bytes, expiry: int, deleted: bool) -> bytes:
    return b"".join((struct.pack("<I", len(key)), key, struct.pack("<I", len(value)), value, struct.pack("<qB", expiry, deleted)))


def segment_record(key: bytes, value: bytes, expiry: int, deleted: bool) -> bytes:
    return struct.pack("<IIqB", len(key), len(value), expiry, deleted) + key + value


def read_log(data: bytes) -> Iterator[tuple[int, Entry]]:
    """Each record with its offset; raises TornRecord after the last whole one if bytes are left."""
    at = n = 0
    while at < len(data):
        try:
            (k,) = struct.unpack_from("<I", data, at)
            (v,) = struct.unpack_from("<I", data, at + 4 + k)
            expiry, deleted = struct.unpack_from("<qB", data, at + 8 + k + v)
            entry = data[at + 4 : at + 4 + k].decode(), data[at + 8 + k : at + 8 + k + v], expiry, bool(deleted)
        except (struct.error, UnicodeDecodeError):
            raise TornRecord(n) from None
        yield at, entry
        at, n = at + 17 + k + v, n + 1


def read_segment(data: bytes) -> Iterator[tuple[int, Entry]]:
    at = n = 0
    while at < len(data):
        try:
            k, v, expiry, deleted = struct.unpack_from("<IIqB", data, at)
        except struct.error:
            raise TornRecord(n) from None
        body = data[at + 17 : at + 17 + k + v]
        if len(body) < k + v:
            raise TornRecord(n)
        yield at, (body[:k].decode(), body[k:], expiry, bool(deleted))
        at, n = at + 17 + k + v, n + 1


def _encoded(rows: DataFrame, record: Callable[..., bytes], file_bytes: int) -> DataFrame:
    """(file, content): the rows as they are ordered in each group of ``file``, a row a file of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, part, parts, size = None, 0, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"file": pa.array([name], pa.int64()), "part": pa.array([part], pa.int32()), "content": pa.array([b"".join(parts)], pa.binary())})

        for batch in batches:
            for file, key, value, expiry, deleted in zip(*(batch.column(c).to_pylist() for c in ("file", "key", "value", "expiry_ns", "is_deleted")), strict=True):
                if parts and (file != name or size >= file_bytes):
                    yield out()
                    part, parts, size = (part + 1 if file == name else 0), [], 0
                name = file
                parts.append(record(key.encode(), value, expiry, deleted))
                size += len(parts[-1])
        if parts:
            yield out()

    own = rows.withColumn("value", F.col("value").cast("binary"))
    return own.select("file", "key", "value", "expiry_ns", "is_deleted").mapInArrow(run, "file long, part int, content binary")


def encode_log(log: DataFrame, file: Column, file_bytes: int = 64 << 20) -> DataFrame:
    """Log files' contents: rows in order of seq, in files named by a number that rises with seq."""
    rows = log.withColumn("file", file)
    return _encoded(rows.repartition("file").sortWithinPartitions("file", "seq"), log_record, file_bytes)


def encode_segments(rows: DataFrame, file_bytes: int = 64 << 20) -> DataFrame:
    """Segment files' contents from (segment, key, ...): sorted by key, one row a segment or, of
    larger ones, a part of it."""
    rows = rows.withColumnRenamed("segment", "file")
    return _encoded(rows.repartition("file").sortWithinPartitions("file", "key"), segment_record, file_bytes)


def decode(files: DataFrame, reader: Callable[[bytes], Iterator[tuple[int, Entry]]], lenient: bool = False) -> DataFrame:
    """(file, part, offset, key, value, expiry_ns, is_deleted, torn) from (file, part, content).

    A torn file raises; ``lenient`` keeps the rows before and marks the last of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "part", "offset", "key", "value", "expiry_ns", "is_deleted", "torn"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.bool_(), pa.bool_()]

        def out(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for batch in batches:
            for file, part, content in zip(*(batch.column(c) for c in ("file", "part", "content")), strict=True):
                rows: list[list] = []
                try:
                    for at, (key, value, expiry, deleted) in reader(content.as_py()):
                        if len(rows) >= 10_000:
                            yield out(rows[:-1])
                            rows = rows[-1:]
                        rows.append([file.as_py(), part.as_py(), at, key, value, expiry, deleted, False])
                except TornRecord:
                    if not lenient:
                        raise
                    if rows:
                        rows[-1][-1] = True
                if rows:
                    yield out(rows)

    schema = "file long, part int, offset long, key string, value binary, expiry_ns long, is_deleted boolean, torn boolean"
    return files.select("file", "part", "content").mapInArrow(run, schema)


def write_files(contents: DataFrame, folder: str, name: str) -> list[str]:
    """Writes (file, part, content) as files ``name.format(number)``, parts of a file numbered on, and gives their names.

    A task writes under a name of its own and then moves the file, so a repeated attempt leaves the same files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
        store.create_dir(top, recursive=True)
        for batch in batches:
            names = [name.format(f * PARTS + p) for f, p in zip(batch.column("file").to_pylist(), batch.column("part").to_pylist(), strict=True)]
            for to, content in zip(names, batch.column("content"), strict=True):
                with store.open_output_stream(own := f"{top}/_{uuid.uuid4().hex}") as out:
                    out.write(content.as_py())
                store.move(own, f"{top}/{to}")
            yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string())})

    return sorted(r["name"] for r in contents.mapInArrow(run, "name string").collect())


def read_log_files(spark: SparkSession, folder: str, lenient: bool = False) -> DataFrame:
    """Rows of the log files in a folder; ``file`` is the number in a file's name, 0 if it has none."""
    return decode(_files(spark, folder), read_log, lenient)


def read_segment_files(spark: SparkSession, folder: str) -> DataFrame:
    return decode(_files(spark, folder), read_segment)


def file_number(path: Column) -> Column:
    """The number after the underscore or dot of a file's name, 0 if there is none."""
    return F.coalesce(F.regexp_extract(path, r"[_.](\d+)(?:\.sst)?$", 1).try_cast("bigint"), F.lit(0).cast("long"))


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select(file_number(F.col("path")).alias("file"), F.lit(0).alias("part"), "content")
