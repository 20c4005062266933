"""The fixed relation of file facts, and the relations of findings."""

from __future__ import annotations

from pyspark.sql import types as T

#: One row for each file.  perceptual_hash holds 64 unsigned bits as a signed integer.
RECORD = T.StructType(
    [
        T.StructField("url", T.StringType(), False),
        T.StructField("relative_path", T.StringType(), False),
        T.StructField("byte_size", T.LongType(), False),
        T.StructField("modified_at", T.TimestampType()),
        T.StructField("format", T.StringType()),
        T.StructField("pixel_size", T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])),
        T.StructField("content_hash", T.StringType()),
        T.StructField("perceptual_hash", T.LongType()),
        T.StructField("color_signature", T.ArrayType(T.ShortType())),
        T.StructField("problem", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("split", T.StringType()),
    ]
)

EMBEDDING = T.StructType([T.StructField("path", T.StringType(), False), T.StructField("embedding", T.ArrayType(T.FloatType()), False)])

#: The domain of problem, and what reports say of each.
PROBLEMS = {
    "unreadable": "Unreadable, not recognized as an image",
    "truncated": "Truncated, pixel data is incomplete",
    "decode_failed": "Corrupt: the header parsed but decoding failed",
    "empty": "Empty, the file contains no data",
}

#: Values of split in order.
SPLITS = ("train", "validation", "test")

#: File name extensions that are images.
EXTENSIONS = ("jpg", "jpeg", "jpe", "png", "gif", "tif", "tiff", "bmp", "heic", "heif", "webp", "avif")
