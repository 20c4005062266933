"""Connected components of an edge relation."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship

#: Up to so many edges are joined up in one task; rounds of joins cost more than that.
ONE_TASK = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a private one only in local mode, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "checkpoints"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; its files go with it if spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all edges of a partition."""
    root: dict = {}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(root.setdefault(x, x)), find(root.setdefault(y, y))
            if a != b:
                root[max(a, b)] = min(a, b)
    if root:
        nodes = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], ["node", "label"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the least node of its component.

    At most one_task edges (counted) are joined up by one task.  Beyond that:
    Alternating large and small stars: each round hangs the neighbours of a node
    from the least of them, until nothing changes; rounds grow with the
    logarithm of the longest chain.  Edges only ever shrink in number.
    """
    stars = cut(edges.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x <> y").distinct())
    if one_task and stars.count() <= one_task:
        ship(stars.sparkSession)
        kind = stars.schema["x"].dataType
        return stars.coalesce(1).mapInArrow(_joined, T.StructType([T.StructField("node", kind), T.StructField("label", kind)]))
    while True:
        # done when every node hangs from one other, and that from none
        twice = stars.groupBy("x").count().where("count > 1")
        if twice.isEmpty() and stars.select("y").distinct().join(stars.select(F.col("x").alias("y")), "y", "left_semi").isEmpty():
            break
        both = stars.unionByName(stars.select(F.col("y").alias("x"), F.col("x").alias("y")))
        # kept apart, so that the join shuffles both sides and the rows of a hub can be split among tasks
        least = cut(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("m", "x").alias("m")))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(least.withColumnRenamed("m", "y"))
        stars = cut(small.where("x <> y").distinct())
    return stars.select(F.col("x").alias("node"), F.col("y").alias("label")).unionByName(stars.select(F.col("y").alias("node"), F.col("y").alias("label")).distinct())
