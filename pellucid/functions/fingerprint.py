"""Structural and colour fingerprints, and their distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROWS, COLUMNS = 8, 9
COLOR_SAMPLES = 48


def difference_hash(samples: Column) -> Column:
    """64 bits from 72 gray samples, rows of nine: bit row * 8 + column is set where a sample is greater than the next.

    One small expression over a bound array, so that plans which mention it often stay small.
    """

    def of(s: Column) -> Column:
        def add(bits: Column, k: Column) -> Column:
            at = F.shiftright(k, 3) * COLUMNS + k % (COLUMNS - 1)
            return bits.bitwiseOR(F.when(F.get(s, at) > F.get(s, at + 1), F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")))

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROWS * (COLUMNS - 1) - 1)), F.lit(0).cast("long"), add)

    return F.element_at(F.transform(F.array(samples), of), 1)


def hex_bits(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def color_distance(a: Column, b: Column) -> Column:
    """Mean absolute difference, as whole number; 255 if lengths differ or there are no samples."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.floor(total / F.greatest(F.size(a), F.lit(1))).cast("int")).otherwise(F.lit(255))
