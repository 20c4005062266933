"""Similarity joins of fingerprints: within a Hamming distance, and a colour distance.

64 bits are cut into threshold // 2 + 1 bands: two hashes within the threshold differ
by at most one bit in at least one of them; a pair is kept only in the first such band, so
none comes twice.  A band takes every n-th bit, for neighbours in a picture depend on each other.

While a side has at most BROADCAST_ROWS rows (checked, on both sides) of BROADCAST_BYTES
(summed), its bands, each as it is and with every bit flipped, are broadcast and the
other side stays where it is.  Beyond that only distinct hashes meet: those that agree in the
first bits of a band lie in blocks of about BLOCK hashes, a block meets those whose bits differ
from its own by at most one, and tasks compare the two as arrays.  So many bits are looked at as make
blocks of that size; until a band has no more (4 million hashes at the usual threshold), the comparisons for a
hash grow with their number only.  Ids and colours are joined to the hashes that are near.
Either way the pairs are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fingerprint import color_distance, hamming
from ..runtime import ship
from .graph import components, cut

BITS = 8
COLOR = 12
#: Rows and bytes of a side whose bands are broadcast; a row has 70 of them at the usual threshold.
BROADCAST_ROWS, BROADCAST_BYTES = 5_000, 2 << 20
#: Hashes that a block has on average, and at most about; comparisons that a task makes at a time; ids of one fingerprint that are expanded together.
BLOCK, MOST, CELLS, DEALT = 512, 2_048, 1 << 18, 4_096
#: Comparisons that are worth a task of their own.
TASK = 1 << 26


def bands(threshold: int) -> list[list[int]]:
    """The bits of threshold // 2 + 1 bands that cover 64."""
    n = threshold // 2 + 1
    return [list(range(k, 64, n)) for k in range(n)]


def _bit(k: int) -> int:
    return 1 << k if k < 63 else -(1 << 63)


def _mask(bits: list[int]) -> int:
    return sum(_bit(k) for k in bits)


def _close(a: str, b: str, threshold: int) -> Column:
    return hamming(F.col(f"{a}.bits"), F.col(f"{b}.bits")) <= threshold


def _colors(a: str, b: str, limit: int, strict: bool) -> Column:
    """strict: a missing colour never matches; else it never objects."""
    near = color_distance(F.col(f"{a}.color"), F.col(f"{b}.color")) <= limit
    missing = F.col(f"{a}.color").isNull() | F.col(f"{b}.color").isNull()
    return F.coalesce(near, F.lit(False)) & ~missing if strict else missing | F.coalesce(near, F.lit(False))


def _few(side: DataFrame) -> int | None:
    """The side's bytes if it may be broadcast, else None; no more than BROADCAST_ROWS rows are looked at."""
    n, size = side.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col("id").cast("string")) + 2 * F.greatest(F.size("color"), F.lit(0)) + 16)).first()
    return (size or 0) if n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else None


def _compared(masks: list[int], threshold: int):
    """Rows (k, same, p, q, ps, qs) of two blocks: their hashes within the threshold for which k is the first band that is near."""
    first = [np.uint64(m & (1 << 64) - 1) for m in masks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            band, same = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            (p, pa_), (q, qa) = ((c.flatten().to_numpy().view(np.uint64), c.offsets.to_numpy()) for c in (batch.column(2), batch.column(3)))
            pa_, qa = pa_ - pa_[0], qa - qa[0]
            ps, qs = batch.column(4).flatten().to_numpy(), batch.column(5).flatten().to_numpy()
            found = []
            for r, k in enumerate(band):
                x, y = p[pa_[r] : pa_[r + 1]], q[qa[r] : qa[r + 1]]
                step = max(1, CELLS // len(y))
                for s in range(0, len(x), step):
                    i, j = np.divmod(np.flatnonzero(np.bitwise_count(x[s : s + step, None] ^ y[None, :]) <= threshold), len(y))
                    i += s
                    d = x[i] ^ y[j]
                    keep = np.bitwise_count(d & first[k]) <= 1
                    for m in first[:k]:
                        keep &= np.bitwise_count(d & m) > 1
                    if same[r]:
                        keep &= i < j
                    found.append((i[keep] + pa_[r], j[keep] + qa[r]))
            i, j = (np.concatenate([f[side] for f in found]) if found else np.zeros(0, np.int64) for side in (0, 1))
            there, back = (ps[i] & 1 > 0) & (qs[j] & 2 > 0), (ps[i] & 2 > 0) & (qs[j] & 1 > 0)
            a, b = np.concatenate([p[i[there]], q[j[back]]]), np.concatenate([q[j[there]], p[i[back]]])
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["x", "y"])

    return run


def close(left: DataFrame, right: DataFrame, threshold: int = BITS, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """(x, y): each two hashes of the two sides (bits) that are at most threshold bits apart, once, equal ones too."""
    ship(left.sparkSession)
    if left is right:
        hashes = cut(left.select("bits").distinct().withColumn("sides", F.lit(3).cast("byte")))
    else:
        both = left.select("bits", F.lit(1).alias("sides")).unionByName(right.select("bits", F.lit(2).alias("sides")))
        hashes = cut(both.groupBy("bits").agg(F.bit_or("sides").cast("byte").alias("sides")))
    n = hashes.count()
    used = max(0, (n // block).bit_length() - 1)
    cuts = [b[:used] for b in bands(threshold)]
    masks = [_mask(b) for b in cuts]
    keys = F.array(*(F.struct(F.lit(k).alias("k"), F.col("bits").bitwiseAND(F.lit(m).cast("long")).alias("v")) for k, m in enumerate(masks)))
    keyed = hashes.select("bits", "sides", F.inline(keys))
    # a row for each place that hashes have in a band
    counted = cut(keyed.groupBy("k", "v").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts")))
    dealt = keyed.join(counted, ["k", "v"]).withColumn("i", F.pmod(F.xxhash64("bits"), F.col("parts")).cast("int"))
    blocks = cut(dealt.groupBy("k", "v", "i").agg(F.collect_list(F.struct("bits", "sides")).alias("held")).select("k", "v", "i", "held.bits", "held.sides"))
    flips = F.array(*(F.array(F.lit(0).cast("long"), *(F.lit(_bit(j)).cast("long") for j in b)) for b in cuts))
    meet = counted.select("k", "v", "parts", F.explode(F.get(flips, F.col("k"))).alias("flip")).withColumn("w", F.col("v").bitwiseXOR(F.col("flip"))).where("v <= w")
    meet = meet.join(counted.select("k", F.col("v").alias("w"), F.col("parts").alias("others")), ["k", "w"])
    meet = meet.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).where("v < w or i <= j").select("k", "v", "i", "w", "j")
    met = meet.join(blocks.select("k", "v", "i", F.col("bits").alias("p"), F.col("sides").alias("ps")), ["k", "v", "i"])
    # dealt by the work, which is not seen from the few bytes of the blocks: by those they'd be put together into one task
    tasks = min(int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * len(masks) * (n >> used) * (used + 2) // 2 // TASK))
    met = met.repartition(max(1, tasks), "k", "w", "j")
    met = met.join(blocks.select("k", F.col("v").alias("w"), F.col("i").alias("j"), F.col("bits").alias("q"), F.col("sides").alias("qs")), ["k", "w", "j"])
    met = met.select("k", ((F.col("v") == F.col("w")) & (F.col("i") == F.col("j"))).alias("same"), "p", "q", "ps", "qs")
    equal = hashes.where("sides = 3").select(F.col("bits").alias("x"), F.col("bits").alias("y"))
    return met.mapInArrow(_compared(masks, threshold), "x long, y long").unionByName(equal)


def _dealt(side: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of a side with the parts that their ids are dealt to, and the ids, each in one part."""
    kinds = cut(side.groupBy("bits", "color").agg(F.ceil(F.count(F.lit(1)) / DEALT).cast("int").alias("parts")))
    many = F.broadcast(kinds.where("parts > 1"))  # a row for DEALT ids at least
    held = side.alias("s").join(many.alias("m"), (F.col("s.bits") == F.col("m.bits")) & F.col("s.color").eqNullSafe(F.col("m.color")), "left")
    return kinds, held.select("s.id", "s.bits", "s.color", F.coalesce(F.pmod(F.xxhash64("s.id"), F.col("m.parts")).cast("int"), F.lit(0)).alias("part"))


def _expanded(left: DataFrame, right: DataFrame, threshold: int, color: int, strict: bool, ordered: bool) -> DataFrame:
    """pairs() of two sides of any size: hashes that are near, then their fingerprints of like colour, then ids."""
    near = close(left, right, threshold)
    (lk, l), (rk, r) = (kinds := _dealt(left)), kinds if left is right else _dealt(right)
    kinds = near.join(lk.alias("l"), F.col("x") == F.col("l.bits")).join(rk.alias("r"), F.col("y") == F.col("r.bits")).where(_colors("l", "r", color, strict))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kinds = kinds.select("x", "y", F.col("l.color").alias("lc"), F.col("r.color").alias("rc"), F.col("l.parts").alias("lp"), F.col("r.parts").alias("rp"))
    kinds = kinds.withColumn("i", every("lp")).withColumn("j", every("rp")).alias("k")
    some = kinds.join(l.alias("l"), (F.col("k.x") == F.col("l.bits")) & F.col("k.lc").eqNullSafe(F.col("l.color")) & (F.col("k.i") == F.col("l.part"))).select(F.col("l.id").alias("a"), "x", "y", "rc", "j").alias("k")
    same = (F.col("k.y") == F.col("r.bits")) & F.col("k.rc").eqNullSafe(F.col("r.color")) & (F.col("k.j") == F.col("r.part"))
    if ordered:
        same = same & (F.col("k.a") < F.col("r.id"))
    return some.join(r.alias("r"), same).select("a", F.col("r.id").alias("b"), hamming(F.col("x"), F.col("y")).alias("bits_apart"))


def pairs(left: DataFrame, right: DataFrame, threshold: int = BITS, color: int = COLOR, strict: bool = False, ordered: bool = False, plan: str = "auto") -> DataFrame:
    """(a, b, bits_apart): ids of rows (id, bits, color) of the two sides that are alike; ordered: only a < b.

    plan: auto, broadcast or bands.
    """
    same = left is right
    left = left.where("bits is not null")
    right = left if same else right.where("bits is not null")
    small = None
    if plan != "bands":
        sizes = [x for x in ((_few(df), name) for df, name in ((right, "right"), (left, "left"))) if x[0] is not None]
        if sizes:
            small = min(sizes)[1]
        elif plan == "broadcast":
            raise ValueError("neither side is small enough to be broadcast")
    if small is None:
        return _expanded(left, right, threshold, color, strict, ordered)
    alike = _close("l", "r", threshold) & _colors("l", "r", color, strict)
    if ordered:
        alike = (F.col("l.id") < F.col("r.id")) & alike
    apart = hamming(F.col("l.bits"), F.col("r.bits")).alias("bits_apart")
    masks, cuts = [_mask(b) for b in bands(threshold)], bands(threshold)

    def keyed(df: DataFrame, flips: bool) -> DataFrame:
        every = []
        for k, b in enumerate(cuts):
            v = F.col("bits").bitwiseAND(F.lit(masks[k]).cast("long"))
            every.append(F.struct(F.lit(k).alias("k"), v.alias("v")))
            if flips:
                every += [F.struct(F.lit(k).alias("k"), v.bitwiseXOR(F.lit(_bit(j)).cast("long")).alias("v")) for j in b]
        return df.select("id", "bits", "color", F.inline(F.array(*every)))

    x = F.col("l.bits").bitwiseXOR(F.col("r.bits"))
    first = F.lit(len(cuts))
    for k in range(len(cuts) - 1, -1, -1):
        first = F.when(F.bit_count(x.bitwiseAND(F.lit(masks[k]).cast("long"))) <= 1, F.lit(k)).otherwise(first)
    meet = (F.col("l.k") == F.col("r.k")) & (F.col("l.v") == F.col("r.v")) & (F.col("l.k") == first)
    l, r = keyed(left, small != "right"), keyed(right, small == "right")
    if small == "right":
        r = F.broadcast(r)
    else:
        l = F.broadcast(l)
    return l.alias("l").join(r.alias("r"), meet & alike).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), apart)


def clusters(rows: DataFrame, threshold: int = BITS, color: int = COLOR, plan: str = "auto") -> DataFrame:
    """(id, label) of rows (id, bits, color) in components of two or more.

    The first row of each fingerprint stands for it: only these are joined and joined up, and
    what is found goes to all rows of a fingerprint, so that copies make neither pairs nor edges.
    """
    rows = rows.where("bits is not null")
    alike = cut(rows.groupBy("bits", "color").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    ones = alike.select("id", "bits", "color")
    near = pairs(ones, ones, threshold, color, ordered=True, plan=plan)
    joined = components(near.select("a", "b")).withColumnRenamed("node", "id")
    # the least of the first rows is the least of all rows
    found = alike.join(joined, "id", "left").where("n > 1 or label is not null").withColumn("label", F.coalesce("label", "id"))
    same = (F.col("r.bits") == F.col("d.bits")) & F.col("r.color").eqNullSafe(F.col("d.color"))
    return rows.alias("r").join(found.alias("d"), same).select("r.id", "d.label")

