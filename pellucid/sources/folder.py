"""Records of the image files of a folder.

Discovery is in listing.py: empty files and names that Spark's file sources skip are
found too.  Content is read in tasks, in chunks: its SHA-256, its first and last bytes, the box walk
and the header's size.  Pixels come from Spark's image source.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.completeness import HEAD, TAIL, box_walk, completeness, format_name
from ..functions.fingerprint import COLUMNS, ROWS, difference_hash
from ..functions.layout import attributes, relative_to
from ..functions.ordering import natural_key
from ..runtime import ship
from ..schema import RECORD
from .headers import header_size
from .listing import base_url, discover

CHUNK = 1 << 20
#: Formats that the JVM can decode; of others the pixels stay unknown and no problem is claimed.
DECODABLE = ("JPEG", "PNG", "GIF", "BMP", "TIFF")


FACTS = "url string, byte_size long, modified_ms long, content_hash string, head binary, tail binary, boxes string, width int, height int"


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            row = r | {"content_hash": None, "head": None, "tail": None, "boxes": None, "width": None, "height": None}
            try:
                url = r["url"] if "://" in r["url"] else r["url"].replace("file:", "file://", 1)
                fs, path = pa.fs.FileSystem.from_uri(url.replace(" ", "%20"))
                with fs.open_input_file(unquote(path)) as f:
                    digest = hashlib.sha256()
                    while piece := f.read(CHUNK):
                        digest.update(piece)

                    def read(at, n, f=f):
                        f.seek(at)
                        return f.read(n)

                    size = r["byte_size"]
                    head = read(0, HEAD)
                    row |= {"content_hash": digest.hexdigest(), "head": head, "tail": read(max(0, size - TAIL), TAIL)}
                    if head[4:8] == b"ftyp":
                        row["boxes"] = box_walk(read, size)
                    row |= dict(zip(("width", "height"), header_size(head, read, size) or (None, None), strict=True))
            except OSError:
                pass  # stays without content: unreadable
            out.append(row)
        schema = pa.schema(
            [("url", pa.string()), ("byte_size", pa.int64()), ("modified_ms", pa.int64()), ("content_hash", pa.string()), ("head", pa.binary()), ("tail", pa.binary()), ("boxes", pa.string()), ("width", pa.int32()), ("height", pa.int32())]
        )
        yield pa.RecordBatch.from_pylist(out, schema)


def area_means(pixels: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Means of pixels (height x width x channels) over a grid of equal areas; edges count in part."""

    def weights(n: int, cells: int) -> np.ndarray:
        edge = np.linspace(0, n, cells + 1)
        low, high = np.arange(n), np.arange(1, n + 1)
        return np.clip(np.minimum(high, edge[1:, None]) - np.maximum(low, edge[:-1, None]), 0, None) * cells / n

    h, w, _ = pixels.shape
    return np.einsum("rh,hwc,kw->rkc", weights(h, rows), pixels.astype(np.float64), weights(w, columns), optimize=True)


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        urls, gray, color = [], [], []
        for r in batch.to_pylist():
            rgb = rgb_of(r)
            urls.append(r["url"])
            if rgb is None:
                gray.append(None)
                color.append(None)
                continue
            luma = rgb @ np.array([[0.299], [0.587], [0.114]])
            gray.append(np.round(area_means(luma, ROWS, COLUMNS)).astype(int).ravel().tolist())
            color.append(np.round(area_means(rgb, 4, 4)).astype(int).ravel().tolist())
        yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array(gray, pa.list_(pa.int32())), pa.array(color, pa.list_(pa.int16()))], ["url", "gray", "color_signature"])


def images(spark: SparkSession, root: str) -> DataFrame:
    """(url, height, width, channels, data) of the files that the JVM can decode; height -1 where it fails."""
    image = spark.read.format("image").option("recursiveFileLookup", "true").load(root)
    return image.select(F.regexp_replace("image.origin", "^file:/+", "file:/").alias("url"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def rgb_of(row: dict) -> np.ndarray | None:
    """height x width x 3 bytes of a row of images(); None where decoding failed."""
    h, w, n = row["height"], row["width"], row["channels"]
    if h <= 0 or w <= 0:
        return None
    x = np.frombuffer(row["data"], np.uint8).reshape(h, w, n)
    return np.repeat(x, 3, 2) if n == 1 else x[:, :, 2::-1]


def decoded(spark: SparkSession, root: str) -> DataFrame:
    """(url, gray, color_signature) of the files that the JVM can decode; null samples where it fails."""
    return images(spark, root).mapInArrow(_samples, "url string, gray array<int>, color_signature array<smallint>")


def classified(facts: DataFrame, pixels: DataFrame, root: str) -> DataFrame:
    """Records from what was read of files and of their pixels."""
    name = F.element_at(F.split("url", "/"), -1)
    kind = format_name(F.col("head"), F.element_at(F.split(name, r"\."), -1))
    whole = completeness(F.col("head"), F.col("tail"), F.col("byte_size"), F.col("boxes"))
    rows = facts.join(pixels, "url", "left").withColumns({"format": kind, "whole": whole})
    problem = (
        F.when(F.col("byte_size") == 0, "empty")
        .when(F.col("head").isNull(), "unreadable")
        .when(F.col("whole") == "truncated", "truncated")
        .when(F.col("format").isNull(), "unreadable")
        .when(F.col("format").isin(*DECODABLE) & F.col("gray").isNull(), "decode_failed")
    )
    base = root.rstrip("/") + "/"
    path = relative_to(F.col("url"), base)
    fine = problem.isNull()
    size = F.when(F.col("width").isNotNull() & ~F.coalesce(problem.isin("empty", "unreadable"), F.lit(False)), F.struct("width", "height"))
    return rows.select(
        "url",
        path.alias("relative_path"),
        "byte_size",
        F.timestamp_millis("modified_ms").alias("modified_at"),
        F.when(~F.coalesce(problem == "empty", F.lit(False)), F.col("format")).alias("format"),
        size.alias("pixel_size"),
        "content_hash",
        F.when(fine & F.col("gray").isNotNull(), difference_hash(F.col("gray"))).alias("perceptual_hash"),
        F.when(fine, F.col("color_signature")).alias("color_signature"),
        problem.alias("problem"),
        attributes(path).label.alias("label"),
        attributes(path).split.alias("split"),
    )


def read_facts(found: DataFrame, read=None) -> DataFrame:
    """FACTS of the files of discover(); read counts the files of each batch, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _facts(batches):
            if read is not None:
                read.add(out.num_rows)
            yield out

    return found.mapInArrow(run, FACTS)


def in_path_order(records: DataFrame) -> DataFrame:
    return records.orderBy(natural_key(F.col("relative_path")), "relative_path").select(*RECORD.names)


def scan_folder(spark: SparkSession, root: str) -> DataFrame:
    """The records of a folder in natural path order; NotADirectoryError if it's none."""
    ship(spark)
    facts = read_facts(discover(spark, root))
    return in_path_order(classified(facts, decoded(spark, root), base_url(spark, root)))
