"""The greatest Hamming distance within groups of 64-bit hashes, exact, without comparing all pairs.

Small groups are compared pair by pair.  In a larger one

1. distances to four pivots (the bitwise majority, the hash farthest from it, the one farthest from
   that, and the one farthest from both) give a first lower bound;
2. two hashes are far apart where one is near the other's complement, so an equi-join of bands
   with bands of complements raises the bound, and proves it where few pairs could be
   better: hashes more than 64 - t bits apart agree with a complement in one of t // 2 + 1
   bands but for a bit;
3. what is still open is concentrated: hashes fall into cells of like distances to all
   pivots, and by the triangle inequality no pair of two cells is farther apart than the least
   sum of their distances to a pivot, nor than the bits in which they can differ.  Only
   cells that could beat the bound are compared, in blocks of bounded size.

The state of every group is a row of a small table; hashes are dealt by band or block, never by group alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fingerprint import hamming
from .graph import cut

#: Groups of so many hashes are compared pair by pair: at most half as many rows for each hash.
SMALL = 64
#: Bits from a complement up to which bands are joined for every open group, and where more is left to cells.
FIRST, MOST = 7, 12
#: Widths of the rings around a pivot that make cells, in bits, and hashes in a block of a cell.
RING, BLOCK = 4, 512
PIVOTS = 4


def _bit(k: int) -> int:
    return 1 << k if k < 63 else -(1 << 63)


def _majority(rows: DataFrame) -> DataFrame:
    """(label, pivot): the bits that most hashes of a group have."""
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.shiftrightunsigned("bits", k).bitwiseAND(F.lit(1).cast("long"))).alias(f"c{k}") for k in range(64)))
    bits = F.lit(0).cast("long")
    for k in range(64):
        bits = bits.bitwiseOR(F.when(2 * F.col(f"c{k}") > F.col("n"), F.lit(_bit(k)).cast("long")).otherwise(F.lit(0).cast("long")))
    return counts.select("label", bits.alias("pivot"))


def _measured(rows: DataFrame) -> DataFrame:
    """rows (label, bits) with r0..r3, the distances to the pivots of the group."""
    pivot = _majority(rows)
    for k in range(PIVOTS):
        rows = cut(rows.join(pivot, "label").withColumn(f"r{k}", hamming(F.col("bits"), F.col("pivot"))).drop("pivot"))
        # the next pivot is farthest from the last one; the last of all from both that are hashes
        by = F.least("r1", "r2") if k == 2 else F.col(f"r{k}")
        pivot = rows.groupBy("label").agg(F.max_by("bits", F.struct(by, "bits")).alias("pivot"))
    return rows


def _bands(t: int) -> list[tuple[int, int]]:
    """(shift, width) of t // 2 + 1 bands: two hashes at most t bits apart differ in one bit at most in one of them."""
    n = t // 2 + 1
    width = [64 // n + (k < 64 % n) for k in range(n)]
    return [(sum(width[:k]), w) for k, w in enumerate(width)]


def _banded(bits: Column, t: int, flips: bool) -> Column:
    out = []
    for k, (shift, width) in enumerate(_bands(t)):
        v = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1).cast("long"))
        out.append(F.struct(F.lit(k).alias("k"), v.alias("v")))
        if flips:
            out += [F.struct(F.lit(k).alias("k"), v.bitwiseXOR(F.lit(_bit(j)).cast("long")).alias("v")) for j in range(width)]
    return F.array(*out)


def opposite_pairs(rows: DataFrame, t: int) -> DataFrame:
    """(label, a, b) with every pair of a group's hashes at least 64 - t bits apart, and others that share a band."""
    left = rows.select("label", F.col("bits").alias("a"), F.inline(_banded(F.col("bits"), t, False)))
    right = rows.select("label", F.col("bits").alias("b"), F.inline(_banded(F.bitwise_not("bits"), t, True)))
    return left.join(right, ["label", "k", "v"]).select("label", "a", "b")


def cell_pairs(rows: DataFrame, bounds: DataFrame, block: int = BLOCK) -> DataFrame:
    """(label, a, b): pairs of hashes in cells that could be farther apart than the group's bound (label, low)."""
    rings = [F.floor(F.col(f"r{k}") / RING).cast("int") for k in range(PIVOTS)]
    own = rows.join(bounds.select("label"), "label", "left_semi").withColumn("cell", F.array(*rings))
    own = own.withColumn("chunk", F.pmod(F.xxhash64("bits"), F.lit(1 << 20)))
    counted = own.groupBy("label", "cell").agg(
        F.ceil(F.count(F.lit(1)) / block).cast("long").alias("chunks"), F.bit_or("bits").alias("some"), F.bit_and("bits").alias("all"), F.array(*(F.max(f"r{k}") for k in range(PIVOTS))).alias("far")
    )
    a, b = counted.alias("a"), counted.alias("b")
    sums = F.array_min(F.zip_with("a.far", "b.far", lambda x, y: x + y))
    either = F.col("a.some").bitwiseAND(F.bitwise_not("b.all")).bitwiseOR(F.col("b.some").bitwiseAND(F.bitwise_not("a.all")))
    most = F.least(sums, F.bit_count(either))
    chosen = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.cell") <= F.col("b.cell"))).join(bounds.alias("g"), F.col("a.label") == F.col("g.label")).where(most > F.col("g.low"))
    chosen = chosen.select(F.col("a.label").alias("label"), F.col("a.cell").alias("x"), F.col("b.cell").alias("y"), F.explode(F.sequence(F.lit(0), F.col("a.chunks") - 1)).alias("i"), F.col("b.chunks").alias("m"))
    chosen = chosen.select("label", "x", "y", "i", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("j"))
    blocks = own.join(counted.select("label", "cell", "chunks"), ["label", "cell"]).groupBy("label", "cell", (F.col("chunk") % F.col("chunks")).alias("chunk")).agg(F.collect_list("bits").alias("held"))
    first = blocks.select("label", F.col("cell").alias("x"), F.col("chunk").alias("i"), F.col("held").alias("p"))
    second = blocks.select("label", F.col("cell").alias("y"), F.col("chunk").alias("j"), F.col("held").alias("q"))
    met = chosen.join(first, ["label", "x", "i"]).join(second, ["label", "y", "j"])
    return met.select("label", "q", F.explode("p").alias("a")).select("label", "a", F.explode("q").alias("b"))


def _farthest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("label").agg(F.max(hamming(F.col("a"), F.col("b"))).alias("found"))


def _raised(bounds: DataFrame, pairs: DataFrame) -> DataFrame:
    """bounds (label, low) with what pairs show."""
    return cut(bounds.join(_farthest(pairs), "label", "left").select("label", F.greatest("low", F.coalesce("found", F.lit(0))).alias("low")))


def large_spreads(rows: DataFrame) -> DataFrame:
    """(label, spread) of groups of distinct hashes (label, bits), by pivots, complements and cells."""
    rows = _measured(rows)
    bounds = cut(rows.groupBy("label").agg(F.greatest(*(F.max(f"r{k}") for k in range(1, PIVOTS))).alias("low")))
    need = 64 - (F.col("low") + 1)  # how far from a complement a better pair can be
    for t in range(1, MOST, 2):
        some = bounds.where((need > t - 2) & (need <= t) | F.lit(t == FIRST) & (need > t))
        if not some.isEmpty():
            bounds = _raised(bounds, opposite_pairs(rows.join(some.select("label"), "label", "left_semi"), t))
    left = bounds.where(need > t)
    if not left.isEmpty():
        bounds = _raised(bounds, cell_pairs(rows, left))
    return bounds.select("label", F.col("low").alias("spread"))


def spreads(members: DataFrame, small: int = SMALL) -> DataFrame:
    """(label, spread): the greatest distance between two of a group's hashes, from (label, bits); equal hashes count once."""
    rows = cut(members.where("bits is not null").select("label", "bits").distinct())
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    large = cut(sizes.where(F.col("n") > small).select("label"))
    every = members.select("label").distinct()
    few = rows
    if not large.isEmpty():
        few = rows.join(large, "label", "left_anti")
    a, b = few.alias("l"), few.alias("r")
    pairs = a.join(b, (F.col("l.label") == F.col("r.label")) & (F.col("l.bits") < F.col("r.bits"))).select(F.col("l.label").alias("label"), F.col("l.bits").alias("a"), F.col("r.bits").alias("b"))
    found = _farthest(pairs).withColumnRenamed("found", "spread")
    if few is not rows:
        found = found.unionByName(large_spreads(rows.join(large, "label", "left_semi")))
    return every.join(found, "label", "left").select("label", F.coalesce("spread", F.lit(0)).alias("spread"))
