"""The record file of cached vectors: a header, then a record of key and vector for each entry.

Fixed values, little-endian: 8 bytes of magic, a version and a dimension of 4
bytes each, the provider's name in 112 bytes padded by zeros; then for each record
64 bytes of key and the vector as 32-bit floats.

A log is one file, or a folder of them that tasks wrote side by side.  It is read in ranges of
whole records, one for each task, so its size is bounded by no machine; the driver reads headers.
A torn last record is left out.  A folder names its files in CURRENT, which is replaced at once when all
are written, so readers see the old log or the new one.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..runtime import ship
from .stores import store

MAGIC = b"VECLOG01"
VERSION = 1
NAME_BYTES, KEY_BYTES = 112, 64
HEADER_BYTES = len(MAGIC) + 8 + NAME_BYTES
#: Bytes of records in a partition, and read at once.
SPLIT_BYTES, STEP_BYTES = 64 << 20, 4 << 20
SCHEMA = "content_hash string, embedding array<float>, seq long"


def header(provider: str, dimension: int) -> bytes:
    return MAGIC + struct.pack("<II", VERSION, dimension) + provider.encode()[:NAME_BYTES].ljust(NAME_BYTES, b"\0")


def records(keys: list[str], vectors: np.ndarray) -> bytes:
    """Records of keys and the rows of a matrix."""
    raw = np.zeros((len(keys), KEY_BYTES + 4 * vectors.shape[1]), np.uint8)
    raw[:, :KEY_BYTES] = np.frombuffer(b"".join(k.encode()[:KEY_BYTES].ljust(KEY_BYTES, b"\0") for k in keys), np.uint8).reshape(len(keys), KEY_BYTES)
    raw[:, KEY_BYTES:] = np.ascontiguousarray(vectors, "<f4").view(np.uint8).reshape(len(keys), -1)
    return raw.tobytes()


def write_log(path: str, provider: str, entries: list[tuple[str, list[float]]]) -> None:
    """Replace a file by a few entries, at once; save_log writes the rows of a DataFrame."""
    dimension = len(entries[0][1]) if entries else 0
    fs, at = store(path)
    with fs.open_output_stream(f"{at}.new") as f:
        f.write(header(provider, dimension))
        if entries:
            f.write(records([k for k, _ in entries], np.array([v for _, v in entries], np.float32)))
    fs.move(f"{at}.new", at)


@dataclass
class _File:
    path: str
    width: int
    n: int


def _files(path: str, provider: str, dimension: int | None) -> list[_File] | None:
    """The files of a log in order, by their headers; None if one isn't of this provider and dimension."""
    fs, at = store(path)
    kind = fs.get_file_info(at).type
    if kind == pa.fs.FileType.NotFound:
        return None
    names = [at]
    if kind == pa.fs.FileType.Directory:
        if fs.get_file_info(f"{at}/CURRENT").type == pa.fs.FileType.NotFound:
            return None
        with fs.open_input_stream(f"{at}/CURRENT") as f:
            names = [f"{at}/{x}" for x in json.loads(f.read())]
    out = []
    for name in names:
        with fs.open_input_file(name) as f:
            raw = f.read(HEADER_BYTES)
            size = f.size()
        if len(raw) < HEADER_BYTES or raw[: len(MAGIC)] != MAGIC:
            return None
        version, width = struct.unpack_from("<II", raw, len(MAGIC))
        owner = raw[len(MAGIC) + 8 :].rstrip(b"\0").decode(errors="replace")
        if version != VERSION or owner != provider or dimension is not None and width != dimension:
            return None
        out.append(_File(name, width, (size - HEADER_BYTES) // (KEY_BYTES + 4 * width)))
    return out


class _Range(InputPartition):
    def __init__(self, file: _File, first: int, n: int, seq: int):
        self.file, self.first, self.n, self.seq = file, first, n, seq


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[_Range]:
        dimension = self.options.get("dimension")
        out, seq = [], 0
        for file in _files(self.options["path"], self.options["provider"], int(dimension) if dimension else None) or []:
            step = max(1, int(self.options.get("split_bytes", SPLIT_BYTES)) // (KEY_BYTES + 4 * file.width))
            out += [_Range(file, k, min(step, file.n - k), seq + k) for k in range(0, file.n, step)]
            seq += file.n
        return out or [_Range(_File("", 0, 0), 0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        file, size = partition.file, KEY_BYTES + 4 * partition.file.width
        if not partition.n:
            return
        fs, at = store(self.options["path"])[0], file.path
        step = max(1, STEP_BYTES // size)
        with fs.open_input_file(at) as f:
            for k in range(0, partition.n, step):
                n = min(step, partition.n - k)
                f.seek(HEADER_BYTES + (partition.first + k) * size)
                raw = np.frombuffer(f.read(n * size), np.uint8).reshape(n, size)
                keys = [x.decode(errors="replace") for x in np.ascontiguousarray(raw[:, :KEY_BYTES]).view(f"S{KEY_BYTES}").ravel().tolist()]
                values = np.ascontiguousarray(raw[:, KEY_BYTES:]).view("<f4").ravel()
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * file.width), pa.array(values, pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), vectors, pa.array(np.arange(n) + partition.seq + k, pa.int64())], ["content_hash", "embedding", "seq"])


@dataclass
class _Written(WriterCommitMessage):
    part: int
    name: str | None
    width: int


class _Writer(DataSourceArrowWriter):
    """Each task writes a file of its rows; the job names them all at once."""

    def __init__(self, options: dict):
        self.options, self.run = options, uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, at = store(self.options["path"])
        fs.create_dir(at, recursive=True)
        name, width, out = f"log-{self.run}-{context.partitionId():06}-{context.taskAttemptId()}", 0, None
        try:
            for b in iterator:
                if not b.num_rows:
                    continue
                vectors = b.column("embedding")
                widths = set(pa.compute.list_value_length(vectors).to_pylist())
                if len(widths | {width or next(iter(widths))}) > 1 or None in widths or None in b.column("content_hash").to_pylist():
                    raise ValueError("a log's vectors have one width and a key each")
                width = widths.pop()
                if out is None:
                    out = fs.open_output_stream(f"{at}/{name}")
                    out.write(header(self.options["provider"], width))
                out.write(records(b.column("content_hash").to_pylist(), np.asarray(vectors.flatten(), np.float32).reshape(len(vectors), width)))
        finally:
            if out is not None:
                out.close()
        return _Written(context.partitionId(), name if out is not None else None, width)

    def commit(self, messages: list) -> None:
        fs, at = store(self.options["path"])
        written = sorted((m for m in messages if m is not None and m.name), key=lambda m: m.part)
        if len({m.width for m in written}) > 1:
            self.abort(messages)
            raise ValueError("a log's vectors have one width")
        names = [m.name for m in written]
        if not names:
            names = [f"log-{self.run}-empty"]
            with fs.open_output_stream(f"{at}/{names[0]}") as f:
                f.write(header(self.options["provider"], 0))
        with fs.open_output_stream(f"{at}/CURRENT.new") as f:
            f.write(json.dumps(names).encode())
        fs.move(f"{at}/CURRENT.new", f"{at}/CURRENT")
        for f in fs.get_file_info(pa.fs.FileSelector(at)):  # what the log was before, and files of failed tasks
            if f.base_name.startswith("log-") and f.base_name not in names:
                fs.delete_file(f.path)

    def abort(self, messages: list) -> None:
        fs, at = store(self.options["path"])
        for m in messages:
            if m is not None and m.name:
                fs.delete_file(f"{at}/{m.name}")


class VectorLog(DataSource):
    """format("vector_log") with options path, provider and dimension; split_bytes is what one task reads."""

    @classmethod
    def name(cls) -> str:
        return "vector_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def read_log(spark: SparkSession, path: str, provider: str, dimension: int | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame | None:
    """(content_hash, embedding, seq) of whole records, a torn last one left out; None if the log isn't of this provider and dimension."""
    if _files(path, provider, dimension) is None:
        return None
    ship(spark)
    spark.dataSource.register(VectorLog)
    options = {"path": path, "provider": provider, "split_bytes": str(split_bytes)} | ({} if dimension is None else {"dimension": str(dimension)})
    return spark.read.format("vector_log").options(**options).load()


def save_log(rows: DataFrame, path: str, provider: str) -> None:
    """Replace the log in a folder by the rows (content_hash, embedding), a file for each task; vectors have one width."""
    spark = rows.sparkSession
    ship(spark)
    spark.dataSource.register(VectorLog)
    rows.select("content_hash", "embedding").write.format("vector_log").options(path=path, provider=provider).mode("overwrite").save()
