"""Scalar building blocks of the sketches as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillsum.config import LogBucketConfig, SpreadConfig


def column_of(h: Column, length: int) -> Column:
    return h % F.lit(length).cast("long")


def signed_column_of(h: Column, length: int) -> Column:
    return F.shiftright(h, 1) % F.lit(length).cast("long")


def sign_of(h: Column) -> Column:
    return F.lit(1).cast("long") - F.lit(2).cast("long") * (h % F.lit(2).cast("long"))


def leading_zeros32(h: Column) -> Column:
    """Leading zero bits of a value in [0, 2^32); 32 for zero."""
    return F.when(h == 0, F.lit(32)).otherwise(F.lit(32) - F.length(F.bin(h)))


def sample_depth(h: Column, levels: int) -> Column:
    return F.least(F.lit(levels - 1), leading_zeros32(h))


def rank_of(h: Column, c: SpreadConfig = SpreadConfig()) -> Column:
    return F.least(F.lit(c.max_rank), leading_zeros32(h) + 1)


def log_bucket(x: Column, c: LogBucketConfig = LogBucketConfig()) -> Column:
    """Null for x <= 0, which has no logarithm."""
    b = F.floor(F.log(x.cast("double")) / F.log(F.lit(c.gamma)))
    return F.when(x > 0, F.least(F.lit(c.buckets - 1).cast("long"), b)).cast("int")


def bucket_value(bucket: Column, c: LogBucketConfig = LogBucketConfig()) -> Column:
    return F.floor(F.lit(2.0) * F.pow(F.lit(c.gamma), (bucket + 1).cast("double")) / F.lit(1.0 + c.gamma)).cast("long")


def source_of(packed: Column) -> Column:
    """The high 32 bits, unsigned."""
    return F.shiftrightunsigned(packed, 32)


def pack_pair(src: Column, dst: Column) -> Column:
    return F.shiftleft(src.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)), 32).bitwiseOR(dst.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def median(values: list[Column]) -> Column:
    """Median of k columns; for even k the floor of the mean of the middle two."""
    if len(values) == 1:
        return values[0]
    if len(values) == 3:
        a, b, c = values
        return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))
    s, k = F.array_sort(F.array(*values)), len(values)
    if k % 2:
        return s[k // 2]
    return F.floor((s[k // 2 - 1] + s[k // 2]) / F.lit(2)).cast("long")


def cardinality(inverse_sum: Column, c: SpreadConfig = SpreadConfig()) -> Column:
    """The register estimate truncated to an integer; inverse_sum counts 1 for every untouched register."""
    m = float(c.registers)
    return F.floor(F.lit(0.7213 * m / (m + 1.079) * m) / inverse_sum * F.lit(m)).cast("long")


def cardinality_corrected(inverse_sum: Column, empty: Column, c: SpreadConfig = SpreadConfig()) -> Column:
    """As cardinality, with linear counting where the estimate is small and registers are empty."""
    m = float(c.registers)
    raw = F.lit(0.7213 * m / (m + 1.079) * m) / inverse_sum * F.lit(m)
    linear = F.lit(m) * F.log(F.lit(m) / F.greatest(empty, F.lit(1)))
    return F.floor(F.when((raw <= 2.5 * m) & (empty > 0), linear).otherwise(raw)).cast("long")
