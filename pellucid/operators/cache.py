"""A durable cache of vectors by content: Parquet partitioned by provider, the latest of equal keys wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import cut
from .ranking import nth_largest, ranked_within

CAP = 100_000
COMPACT_FACTOR = 2


def latest(rows: DataFrame) -> DataFrame:
    """The newest row for each (provider, content_hash), by seq; a partial result for each task, so that a key's rows needn't meet."""
    newest = F.max_by(F.struct(*rows.columns), "seq").alias("own")
    return rows.groupBy("provider", "content_hash").agg(newest).select("own.*")


def compacted(rows: DataFrame, cap: int = CAP) -> DataFrame:
    """The newest row of each key, and of those the newest cap of each provider; of one seq those of the least hashes.

    The cap-th newest seq of a provider is found by counting, so that its rows are neither sorted nor gathered.
    """
    rows = cut(latest(rows))
    bounds = nth_largest(rows, "provider", "seq", cap)
    placed = rows.join(F.broadcast(bounds), "provider", "left")  # a row for each provider over its cap
    kept = placed.where(F.col("least").isNull() | (F.col("seq") > F.col("least"))).select(*rows.columns)
    even = placed.where(F.col("seq") == F.col("least"))
    if even.groupBy("provider").agg(F.max("above").alias("above"), F.count(F.lit(1)).alias("n")).where(F.col("above") + F.col("n") > cap).isEmpty():
        return kept.unionByName(even.select(*rows.columns))
    ranks = ranked_within(even, "provider", [F.asc("content_hash")], "_rank", "_size")
    return kept.unionByName(ranks.where(F.col("above") + F.col("_rank") <= cap).select(*rows.columns))


def needs_compaction(rows: DataFrame, cap: int = CAP) -> DataFrame:
    """(provider, n_records, n_entries, compact)."""
    counts = rows.groupBy("provider").agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct("content_hash").alias("n_entries"))
    return counts.withColumn("compact", (F.col("n_records") > COMPACT_FACTOR * F.col("n_entries")) | (F.col("n_entries") > cap))


def hits(records: DataFrame, rows: DataFrame, provider: str) -> DataFrame:
    """(url, embedding) of records whose content has a vector; a null hash never hits."""
    own = latest(rows.where(F.col("provider") == provider)).select("content_hash", "embedding")
    return records.select("url", "content_hash").join(own, "content_hash").select("url", "embedding")


def pending(records: DataFrame, rows: DataFrame, provider: str) -> DataFrame:
    """Records without a cached vector."""
    return records.join(rows.where(F.col("provider") == provider).select("content_hash"), "content_hash", "left_anti")


class EmbeddingStore:
    """The cache in a folder."""

    def __init__(self, spark: SparkSession, path: str, cap: int = CAP):
        self.spark, self.path, self.cap = spark, path, cap

    def _exists(self) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs.exists(p) and len(fs.listStatus(p)) > 0

    def rows(self) -> DataFrame:
        schema = "content_hash string, embedding array<float>, seq long, provider string"
        if not self._exists():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def append(self, batch: DataFrame, provider: str) -> None:
        """Add (content_hash, embedding); another width than the stored one starts the provider's cache anew."""
        old = self.rows().where(F.col("provider") == provider)
        width, stored = (x.select(F.size("embedding")).first() for x in (batch, old))
        mode = "append"
        if width and stored and width[0] != stored[0]:
            mode = "overwrite"
        top = old.agg(F.max("seq")).first()[0] if mode == "append" else None
        rows = batch.where("content_hash is not null").select("content_hash", "embedding", (F.lit(0 if top is None else top + 1) + F.monotonically_increasing_id()).alias("seq"), F.lit(provider).alias("provider"))
        writer = rows.write.mode(mode).partitionBy("provider")
        (writer.option("partitionOverwriteMode", "dynamic") if mode == "overwrite" else writer).parquet(self.path)

    def compact(self) -> None:
        """Rewrites the folder's providers with their newest rows; a temporary copy keeps readers whole."""
        cut(compacted(self.rows(), self.cap)).write.mode("overwrite").partitionBy("provider").option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def load(self, provider: str) -> DataFrame:
        return latest(self.rows().where(F.col("provider") == provider))

    def count(self, provider: str) -> int:
        return self.load(provider).count()

    def file_size(self, provider: str) -> int:
        """Bytes of a provider's files; 0 if it has none."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/provider={provider}")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def remove_all(self, provider: str) -> None:
        """Drop a provider's partition."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/provider={provider}")
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
