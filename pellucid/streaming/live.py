"""Findings kept up to date by what changed: added, removed and replaced files.

Exact groups are worked out anew for the contents that changed only.  Look-alikes are a graph of
distinct fingerprints.  New fingerprints alone are joined with all others; their edges merge
components by joining up labels.  A fingerprint that nothing has any more takes its edges away,
and only the components that lost one are joined up again.  Members are ranked anew in the
groups that changed.  What stays is not shuffled but for anti joins by the changed keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import findings
from ..operators.graph import components, cut
from ..operators.similarity import BITS, COLOR, pairs


def _print_key() -> Column:
    color = F.coalesce(F.array_join(F.transform("color", lambda x: x.cast("string")), ","), F.lit("none"))
    return F.md5(F.concat_ws(":", F.col("bits").cast("string"), color).cast("binary"))


@dataclass
class LookAlikes:
    """rows (id, key); prints (key, bits, color, label), label the least key of a component; edges (a, b) of keys."""

    rows: DataFrame
    prints: DataFrame
    edges: DataFrame
    threshold: int = BITS
    color: int = COLOR

    @staticmethod
    def empty(spark, threshold: int = BITS, color: int = COLOR) -> LookAlikes:
        make = lambda schema: spark.createDataFrame([], schema)
        return LookAlikes(make("id string, key string"), make("key string, bits long, color array<smallint>, label string"), make("a string, b string"), threshold, color)

    def changed(self, added: DataFrame, removed: DataFrame) -> tuple[LookAlikes, DataFrame]:
        """The graph without the ids of removed and with the rows (id, bits, color) of added, and (label): what groups, old and new, are other than before."""
        added = cut(added.where("bits is not null").withColumn("key", _print_key()))
        lost = cut(self.rows.join(removed.select("id").unionByName(added.select("id")).distinct(), "id", "left_semi"))
        if lost.isEmpty() and added.isEmpty():
            return self, lost.select(F.col("key").alias("label"))
        rows = cut(self.rows.join(lost.select("id"), "id", "left_anti").unionByName(added.select("id", "key")))
        gone = cut(lost.select("key").distinct().join(rows.select("key"), "key", "left_anti"))
        fresh = cut(added.groupBy("key").agg(F.first("bits").alias("bits"), F.first("color").alias("color")).join(self.prints.select("key"), "key", "left_anti"))
        old = self.prints.join(gone, "key", "left_anti")

        # components that lost a fingerprint are joined up again
        broken = cut(self.prints.join(gone, "key", "left_semi").select("label").distinct())
        left, edges, whole = old.where("false").select("key"), self.edges, old.select("key", "bits", "color", "label")
        if not broken.isEmpty():
            left = cut(old.join(broken, "label", "left_semi").select("key"))
            edges = edges.join(gone.select(F.col("key").alias("a")), "a", "left_anti").join(gone.select(F.col("key").alias("b")), "b", "left_anti").select("a", "b")
            again = components(edges.join(left.select(F.col("key").alias("a")), "a", "left_semi")).select(F.col("node").alias("key"), F.col("label").alias("now"))
            mended = old.join(left, "key", "left_semi").join(again, "key", "left").select("key", "bits", "color", F.coalesce("now", "key").alias("label"))
            whole = old.join(broken, "label", "left_anti").select("key", "bits", "color", "label").unionByName(mended)
        prints = cut(whole.unionByName(fresh.select("key", "bits", "color", F.col("key").alias("label"))))

        # only new fingerprints are compared with others
        side = lambda df: df.select(F.col("key").alias("id"), "bits", "color")
        known = prints.join(fresh.select("key"), "key", "left_anti")
        met = cut(pairs(side(fresh), side(known), self.threshold, self.color).select("a", "b").unionByName(pairs(side(fresh), side(fresh), self.threshold, self.color, ordered=True).select("a", "b")))
        of = prints.select("key", "label")
        joints = met.join(of.select(F.col("key").alias("a"), F.col("label").alias("x")), "a").join(of.select(F.col("key").alias("b"), F.col("label").alias("y")), "b")
        merged = cut(components(joints.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("now")))
        prints = cut(prints.join(merged, "label", "left").select("key", "bits", "color", F.coalesce("now", "label").alias("label")))

        touched = lost.select("key").join(self.prints, "key").select("label").unionByName(added.select("key").join(prints, "key").select("label"))
        touched = touched.unionByName(broken).unionByName(left.join(prints, "key").select("label")).unionByName(merged.select("label")).unionByName(merged.select(F.col("now").alias("label")))
        return LookAlikes(rows, prints, cut(edges.unionByName(met)), self.threshold, self.color), cut(touched.distinct())

    def found(self, labels: DataFrame | None = None) -> DataFrame:
        """(id, label) of rows in components of two rows or more, of some labels or of all."""
        prints = self.prints.select("key", "label")
        if labels is not None:
            prints = prints.join(labels, "label", "left_semi")
        rows = self.rows.join(prints, "key").select("id", "label")
        return rows.join(rows.groupBy("label").count().where("count > 1").select("label"), "label", "left_semi").select("id", "label")


class LiveFindings:
    """The findings of a collection that changes; leakage is looked for if wanted."""

    def __init__(self, records: DataFrame, threshold: int = BITS, color: int = COLOR, leakage: bool = True):
        spark = records.sparkSession
        none = records.where("false")
        self.records, self.ones, self.exact_members = none, none, findings.exact_members(none)
        self._near, self._leaks = LookAlikes.empty(spark, threshold, color), LookAlikes.empty(spark, threshold, color)
        self.near_members, self.leakage_members, self.leakage = None, None, leakage
        self.apply(records, spark.createDataFrame([], "url string"))

    def apply(self, added: DataFrame, removed: DataFrame) -> None:
        """Take out the files of removed (url) and put in the records of added; a record of a known url replaces the old one."""
        columns = self.records.columns
        added = cut(added.select(*columns))
        gone = cut(removed.select("url").unionByName(added.select("url")).distinct())
        key = F.coalesce("content_hash", "url")
        old = self.records.join(gone, "url", "left_semi")
        self.records = cut(self.records.join(gone, "url", "left_anti").select(*columns).unionByName(added))

        # contents with another set of files
        contents = cut(old.select(key.alias("content")).unionByName(added.select(key.alias("content"))).distinct())
        some = cut(self.records.withColumn("content", key).join(contents, "content", "left_semi").select(*columns))
        stay = lambda df: df.withColumn("content", key).join(contents, "content", "left_anti").drop("content")
        self.exact_members = cut(stay(self.exact_members).unionByName(findings.exact_members(some)))
        before = self.ones.withColumn("content", key).join(contents, "content", "left_semi")
        new = cut(findings.representatives(findings.usable(some)).select(*columns))
        self.ones = cut(stay(self.ones).select(*columns).unionByName(new))
        self._near, touched = self._near.changed(findings.fingerprints(new), before.select(F.col("url").alias("id")))
        self.near_members = self._renewed(self.near_members, touched, findings.near_members(self.ones, self._near.found(touched)))

        if not self.leakage:
            return
        # all files of a split, not one of each content
        split = findings.divided(added)
        self._leaks, touched = self._leaks.changed(findings.fingerprints(split), gone.select(F.col("url").alias("id")))
        divided = findings.divided(self.records)
        self.leakage_members = self._renewed(self.leakage_members, touched, findings.leakage_members(divided, self._leaks.found(touched)))

    @staticmethod
    def _renewed(members: DataFrame | None, touched: DataFrame, now: DataFrame) -> DataFrame:
        if members is None:
            return cut(now)
        return cut(members.join(touched.withColumnRenamed("label", "component"), "component", "left_anti").unionByName(now))

    @property
    def exact_groups(self) -> DataFrame:
        return findings.numbered(findings.group_summary(self.exact_members), "exact", F.col("reclaimable_bytes").desc())

    @property
    def near_groups(self) -> DataFrame:
        return findings.near_summary(self.near_members)

    @property
    def leakage_groups(self) -> DataFrame:
        return findings.leakage_summary(self.leakage_members)
