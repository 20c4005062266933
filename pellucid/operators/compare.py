"""What an incoming collection has that a library has too."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import matches_text, natural_key
from .findings import usable
from .graph import cut
from .similarity import BITS, COLOR, pairs

KINDS = ("unreadable", "exact", "near", "new")


def roots_overlap(a: str, b: str) -> bool:
    """Is one folder the other, or inside it, by components?"""
    x, y = os.path.realpath(a), os.path.realpath(b)
    return os.path.commonpath([x, y]) in (x, y)


def matches(library: DataFrame, candidates: DataFrame, threshold: int = BITS, color: int = COLOR, plan: str = "auto") -> DataFrame:
    """(candidate, kind, match): equal content first; look-alikes only for candidates without it.  Both must have fingerprint and colour."""
    side = lambda df: df.select("url", "content_hash", "perceptual_hash", "color_signature")
    library = cut(side(usable(library)))  # both are read several times
    some = cut(side(usable(candidates)).where("content_hash is not null"))
    exact = some.select("content_hash", F.col("url").alias("candidate")).join(library.select("content_hash", F.col("url").alias("match")), "content_hash")
    exact = cut(exact.select("candidate", F.lit("exact").alias("kind"), "match"))
    left = some.join(exact.select(F.col("candidate").alias("url")).distinct(), "url", "left_anti")
    side = lambda df: df.select(F.col("url").alias("id"), F.col("perceptual_hash").alias("bits"), F.col("color_signature").alias("color")).where("color is not null")
    near = pairs(side(left), side(library), threshold, color, strict=True, plan=plan).select(F.col("a").alias("candidate"), F.lit("near").alias("kind"), F.col("b").alias("match"))
    return exact.unionByName(near)


def compare(library: DataFrame, candidates: DataFrame, threshold: int = BITS, color: int = COLOR, plan: str = "auto") -> DataFrame:
    """One row for each candidate: (candidate, kind, matches), matches in the library's order."""
    names = library.select(F.col("url").alias("match"), natural_key(F.col("relative_path")).alias("k"), F.col("relative_path").alias("p"))
    found = matches(library, candidates, threshold, color, plan).join(names, "match")
    lists = found.groupBy("candidate", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "p", "match"))), lambda x: x["match"]).alias("matches"))
    rows = candidates.select(F.col("url").alias("candidate"), (F.col("problem").isNotNull() | F.col("content_hash").isNull()).alias("bad")).join(lists, "candidate", "left")
    kind = F.when(F.col("bad"), F.lit("unreadable")).otherwise(F.coalesce("kind", F.lit("new")))
    return rows.select("candidate", kind.alias("kind"), F.coalesce("matches", F.array().cast("array<string>")).alias("matches"))


def filtered(compared: DataFrame, kind: str | None = None, text: str = "", path: str = "candidate") -> DataFrame:
    """The rows of one kind (None: all) whose path contains text, whatever case and accents; blank text keeps all."""
    rows = compared if kind is None else compared.where(F.col("kind") == kind)
    return rows.where(matches_text(F.col(path), text))


def targets(rows: DataFrame, selection: DataFrame | None = None, key: str = "url") -> DataFrame:
    """What an action is for: all rows if nothing is selected, else the selected ones that are there."""
    if selection is None or selection.isEmpty():
        return rows
    return rows.join(selection.select(key).distinct(), key, "left_semi")


def kind_counts(compared: DataFrame) -> DataFrame:
    """(kind, n) for all kinds, 0 where there's none."""
    every = compared.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string")
    return every.join(compared.groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))
