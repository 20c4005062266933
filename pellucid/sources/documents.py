"""Records that stand for a table of documents, each as if it were a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fingerprint import COLOR_SAMPLES, COLUMNS, ROWS, difference_hash
from ..functions.layout import attributes

ROOT = "file:///data"


def _signed(docs: DataFrame) -> DataFrame:
    """docs with signature: 96 characters that stand for a picture; texts of about the same length share them but for a few, others have their own; equal texts have equal ones.

    What is used more than once is a column of its own, or it would be worked out anew at each place, within lambdas by interpretation.
    """
    kind, whole = F.col("kind"), F.col("whole")
    docs = docs.withColumn("kind", F.length("text") % 8)
    key = F.when(kind < 3, F.concat(F.lit("L"), F.floor(F.length("text") / 8).cast("string"))).otherwise(F.md5(F.col("text").cast("binary")))
    docs = docs.withColumn("key", key)
    docs = docs.withColumn("whole", F.concat(*(F.md5(F.concat("key", F.lit(x)).cast("binary")) for x in ("", "1", "2"))))
    few = F.concat(F.substring(whole, 1, 10), F.lit("z"), F.substring(whole, 12, 85))
    more = F.concat(F.substring(whole, 1, 19), F.lit("zazaza"), F.substring(whole, 26, 71))
    return docs.withColumn("signature", F.when(kind == 1, few).when(kind == 2, more).otherwise(whole)).drop("kind", "key", "whole")


def _code_points(text, first: int, n: int):
    """Those of n characters, the first of them counted from 1; text has that many."""
    return F.transform(F.split(F.substring(text, first, n), "", n), F.ascii)


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record relation of documents.parquet, with doc_id.

    Folders, copy names, sizes, times and problems follow from doc_id and the
    text's length, content from the text.  Fingerprints stand for pictures: those
    of texts with about the same length lie a few bits apart, so that collections of
    any size have near duplicates; every 29th has another colour, every 23rd none.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "n_chars")
    i = F.col("doc_id")
    folder = F.when(i % 50 == 0, "").when(i % 10 == 7, "val/").when(i % 10 >= 8, "test/").otherwise("train/")
    mark = F.when(i % 7 == 0, " copy").when(i % 11 == 0, " (1)").otherwise("")
    path = F.concat(folder, "lang", F.lit("/doc"), i.cast("string"), mark, F.lit(".txt"))
    problem = F.when(F.length("text") == 0, "empty").when(i % 97 == 0, "unreadable").when(i % 89 == 0, "decode_failed").when(F.col("n_chars") < 20, "truncated")
    fine = problem.isNull() & (F.length("text") > 0)
    rows = _signed(docs.withColumns({"relative_path": path, "problem": problem}))
    color = F.when(i % 29 == 0, F.transform(F.sequence(F.lit(1), F.lit(COLOR_SAMPLES)), lambda _: F.lit(255))).otherwise(_code_points(F.col("signature"), 25, COLOR_SAMPLES))
    size = F.struct((F.col("n_chars") % 640 + 1).cast("int").alias("width"), (F.col("n_chars") % 480 + 1).cast("int").alias("height"))
    return rows.select(
        "doc_id",
        F.concat(F.lit(ROOT + "/"), "relative_path").alias("url"),
        "relative_path",
        F.octet_length("text").cast("long").alias("byte_size"),
        F.when(i % 19 != 0, F.timestamp_seconds(F.lit(1_700_000_000) + i * 3600 % 1_000_000)).alias("modified_at"),
        F.when(i % 13 != 0, F.when(i % 3 == 0, "PNG").otherwise("JPEG")).alias("format"),
        F.when(i % 17 != 0, size).alias("pixel_size"),
        F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"),
        F.when(fine, difference_hash(_code_points(F.col("signature"), 1, ROWS * COLUMNS))).alias("perceptual_hash"),
        F.when(fine & (i % 23 != 0), F.transform(color, lambda x: F.shiftright(F.least(x, F.lit(255)), 1).cast("smallint"))).alias("color_signature"),
        "problem",
        attributes(F.col("relative_path")).label.alias("label"),
        attributes(F.col("relative_path")).split.alias("split"),
    )
