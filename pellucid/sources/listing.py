"""Listing folders where tasks run, in batches and as a stream.

A folder is expanded by a task, never by the driver: a frontier of folders is dealt to tasks, each
goes down until it has listed enough of them, and what it hasn't seen yet is the
next frontier.  Hidden names and packages are left out at their folder, links aren't
followed.  Local and other stores are read through pyarrow's file systems.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.graph import cut
from ..runtime import ship
from ..schema import EXTENSIONS

#: Folders that a task lists before it passes on what's left, and folders dealt to one task.
LISTED, DEALT = 512, 64
#: Files whose facts one task reads.
FILES_A_TASK = 256
#: Parts of a tree that a streamed listing is read in, about.
PARTS = 64
#: Folders with these extensions are single things to a user.
PACKAGES = ("app", "bundle", "photoslibrary", "framework")
FILE = "url string, byte_size long, modified_ms long"


def hidden(name: str) -> bool:
    return name.startswith(".")


def package(name: str) -> bool:
    return "." in name and name.rpartition(".")[2].lower() in PACKAGES


def wanted(name: str) -> bool:
    return not hidden(name) and "." in name and name.rpartition(".")[2].lower() in EXTENSIONS


def children(url: str) -> tuple[list[str], list[tuple[str, int, int]]]:
    """The folders to look into, and (url, bytes, milliseconds) of the image files, right below a folder; both empty if it's gone."""
    folders, files = [], []
    if url.startswith("file:"):
        path = "/" + url[5:].lstrip("/")
        try:
            entries = list(os.scandir(path))
        except OSError:
            return folders, files
        for e in entries:
            try:
                if e.is_dir(follow_symlinks=False):
                    if not hidden(e.name) and not package(e.name):
                        folders.append(f"{url}/{e.name}")
                elif e.is_file(follow_symlinks=False) and wanted(e.name):
                    s = e.stat(follow_symlinks=False)
                    files.append((f"{url}/{e.name}", s.st_size, s.st_mtime_ns // 1_000_000))
            except OSError:
                continue  # went meanwhile
        return folders, files
    fs, path = pa.fs.FileSystem.from_uri(quote(url, safe=":/"))
    for f in fs.get_file_info(pa.fs.FileSelector(path, allow_not_found=True)):
        if f.type == pa.fs.FileType.Directory and not hidden(f.base_name) and not package(f.base_name):
            folders.append(f"{url}/{f.base_name}")
        elif f.type == pa.fs.FileType.File and wanted(f.base_name):
            files.append((f"{url}/{f.base_name}", f.size, (f.mtime_ns or 0) // 1_000_000))
    return folders, files


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of files, and of the folders (byte_size null) that are still to be listed."""
    listed = 0
    for b in batches:
        left = b.column(0).to_pylist()
        out: list[tuple] = []
        while left:
            if listed >= LISTED:
                out += [(folder, None, None) for folder in left]
                break
            listed += 1
            folders, files = children(left.pop())
            left += folders
            out += files
            if len(out) >= 10_000:
                yield _rows(out)
                out = []
        yield _rows(out)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("url", pa.string()), ("byte_size", pa.int64()), ("modified_ms", pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], [n for n, _ in kinds])


def base_url(spark: SparkSession, root: str) -> str:
    """The folder's name in its store; NotADirectoryError if it's none."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
        raise NotADirectoryError(root)
    return fs.getFileStatus(path).getPath().toString().rstrip("/")


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(url, byte_size, modified_ms) of all files with an image's extension below root; hidden ones and packages' content left out.

    The driver knows how many folders are left, and the tree is never in one place.
    """
    ship(spark)
    frontier = spark.createDataFrame([(base_url(spark, root),)], "url string")
    found, n = None, 1
    while n:
        level = cut(frontier.repartition(-(-n // DEALT), "url").mapInArrow(_expanded, FILE))
        files = level.where("byte_size is not null")
        found = files if found is None else found.unionByName(files)
        frontier = level.where("byte_size is null").select("url")
        n = frontier.count()
    return found.repartition(max(1, -(-found.count() // FILES_A_TASK)), F.col("url"))


class _Folders(InputPartition):
    def __init__(self, at: int, whole: list[str], alone: list[str]):
        self.at, self.whole, self.alone = at, whole, alone


class _Listing(DataSourceStreamReader):
    """A snapshot of a tree for every trigger; the offset is when it was begun."""

    def __init__(self, root: str):
        self.root = root

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        return {"at": time.time_ns() // 1_000_000}

    def partitions(self, start: dict, end: dict) -> list[_Folders]:
        """Some dozens of subtrees; the folders above them are listed alone."""
        whole, alone = [self.root], []
        while whole and len(whole) < PARTS and len(alone) < PARTS:
            folder = whole.pop(0)
            alone.append(folder)
            whole += children(folder)[0]
        return [_Folders(end["at"], [], alone), *(_Folders(end["at"], [f], []) for f in whole)]

    def read(self, partition: _Folders) -> Iterator[pa.RecordBatch]:
        out, left = [], list(partition.whole)
        for folder in partition.alone:
            out += children(folder)[1]
        while left:
            folders, files = children(left.pop())
            left += folders
            out += files
            if len(out) >= 10_000:
                yield _rows(out)
                out = []
        yield _rows(out)


class FolderListing(DataSource):
    """readStream.format("folder_listing").option("path", url): each micro-batch is a whole listing."""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return FILE

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Listing(self.options["path"])


def listings(spark: SparkSession, root: str) -> DataFrame:
    """A stream of (url, byte_size, modified_ms): each micro-batch holds all image files below root as of its trigger."""
    ship(spark)
    spark.dataSource.register(FolderListing)
    return spark.readStream.format("folder_listing").option("path", base_url(spark, root)).load()
