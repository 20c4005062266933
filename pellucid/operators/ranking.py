"""Places in a total order of all rows, and ranks within groups, without one task that sorts them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut


#: Rows that make a part of a sorted table; fewer rows make fewer parts, with the same places.
PART_ROWS = 50_000


def _in_ranges(df: DataFrame, order: list[Column], *more: Column, part_rows: int = PART_ROWS, keys: dict[str, Column] | None = None) -> tuple[DataFrame, int]:
    """(own, part, k, more) and the number of parts: df's columns in ranges of the given order, the k-th row of each part by place."""
    # sampling reads it before the sort does, and a sort would work keys out for both rows of each comparison
    rows = cut(df.withColumns(keys or {}))
    parts = max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // part_rows)))
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = (rows.repartitionByRange(parts, *order) if parts > 1 else rows.coalesce(1)).sortWithinPartitions(*order)
    rows = rows.select(F.struct(*df.columns).alias("own"), *more, F.spark_partition_id().alias("part"), within.alias("k"))
    return cut(rows) if parts > 1 else rows, parts


def ranked(df: DataFrame, order: list[Column], name: str = "place", part_rows: int = PART_ROWS, keys: dict[str, Column] | None = None) -> DataFrame:
    """df with its place (from 1) in the given order: ranges are sorted each by itself and start where the one before ends.

    order must be total for places to be the same in every run.  keys are columns that order names, worked out once.
    """
    rows, parts = _in_ranges(df, order, part_rows=part_rows, keys=keys)
    if parts == 1:
        return rows.select("own.*", (F.col("k") + 1).alias(name))
    starts, total = [], 0
    for part, n in sorted((r[0], r[1]) for r in rows.groupBy("part").count().collect()):  # a row for each partition
        starts.append((part, total))
        total += n
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "part int, start long"))
    return rows.join(offsets, "part").select("own.*", (F.col("start") + F.col("k") + 1).alias(name))


def ranked_within(df: DataFrame, group: str, order: list[Column], rank: str = "member_rank", size: str = "n_members", part_rows: int = PART_ROWS, keys: dict[str, Column] | None = None) -> DataFrame:
    """df with each row's rank (from 1) in its group by the given order, and the group's size; keys as in ranked.

    Rows are dealt to ranges of (group, order), so a large group lies in several parts.  Its
    rows are ranked within each part; the counts of a group in the parts before
    come from a table of (group, part), which holds a group as often as it has parts.  Groups that go across
    parts are two for each part at most; only these are sent to all tasks.
    """
    rows, parts = _in_ranges(df, [F.col(group).asc(), *order], F.col(group).alias("of"), part_rows=part_rows, keys=keys)
    here = Window.partitionBy("part", "of")
    placed = rows.withColumns({"r": F.row_number().over(here.orderBy("k")), "n": F.count(F.lit(1)).over(here)})
    if parts == 1:
        return placed.select("own.*", F.col("r").alias(rank), F.col("n").alias(size))
    shares = rows.groupBy("of", "part").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("of")  # as many rows as the group has parts
    across = shares.select(
        "of", "part", F.count(F.lit(1)).over(own).alias("parts"), F.sum("n").over(own).alias("total"), (F.sum("n").over(own.orderBy("part")) - F.col("n")).alias("before")
    ).where("parts > 1")
    placed = placed.join(F.broadcast(across.select("of", "part", "before", "total")), ["of", "part"], "left")
    return placed.select("own.*", (F.col("r") + F.coalesce("before", F.lit(0))).cast("int").alias(rank), F.coalesce("total", "n").alias(size))


#: Bits of a value that one round of a selection decides.
DIGIT = 12


def nth_largest(df: DataFrame, group: str, value: str, n: int, digit: int = DIGIT) -> DataFrame:
    """(group, least, above): the n-th largest value of each group that has more than n rows, and how many rows are greater.

    value is a long.  Its bits are decided from the top, some at a time, by counts of the rows that
    agree so far: rows are only ever counted, at most 2 ** digit counts for each group and task.
    """
    flip = F.lit(-(1 << 63)).cast("long")  # order of bits as of numbers
    high_bits = lambda x, k: F.shiftrightunsigned(x, k) if k < 64 else F.lit(0).cast("long")
    u = F.col(value).bitwiseXOR(flip)
    ranges = cut(df.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), F.min(value).alias("low"), F.max(value).alias("high")).where(F.col("rows") > n))
    differ = ranges.agg(F.max(F.length(F.ltrim(F.bin(F.col("low").bitwiseXOR(F.col("high"))), F.lit("0"))))).first()[0]
    left = int(differ or 0)
    state = ranges.select(group, high_bits(F.col("low").bitwiseXOR(flip), left).alias("prefix"), F.lit(0).cast("long").alias("above"))
    while left:
        width = min(digit, left)
        inside = df.select(group, high_bits(u, left).alias("prefix"), high_bits(u, left - width).alias("next")).join(state, [group, "prefix"])
        counts = inside.groupBy(group, "above", "next").agg(F.count(F.lit(1)).alias("n"))
        # those that share a prefix differ in some low bits only, which are in order as they are
        down = Window.partitionBy(group).orderBy(F.desc(F.col("next").bitwiseAND(F.lit((1 << width) - 1))))  # at most 2 ** width rows
        upto = counts.withColumn("upto", F.col("above") + F.sum("n").over(down))
        state = cut(upto.where((F.col("upto") >= n) & (F.col("upto") - F.col("n") < n)).select(group, F.col("next").alias("prefix"), (F.col("upto") - F.col("n")).alias("above")))
        left -= width
    return state.select(group, F.col("prefix").bitwiseXOR(flip).alias("least"), "above")
