"""The 32-bit keyed hash of all sketches, as a chain of projections.

Every intermediate value is its own column: Catalyst keeps a projection that is read more than
once, so each step is computed once per row and stays in whole-stage code generation.  Products
are split in 16-bit halves because BIGINT multiplication raises on overflow in ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Multipliers of the hash, and the seed constants by seed index.
MULTIPLIERS = (2654435761, 246822519, 3266489917, 668265263, 374761393)
SEED_PRIMES = {
    0: 181, 1: 5197, 2: 1151, 3: 137, 4: 5569, 5: 7699, 6: 2887, 7: 8753, 8: 9323, 9: 8963,
    10: 6053, 11: 8893, 12: 9377, 13: 6577, 14: 733, 15: 3527, 16: 3881, 17: 6857,
    101: 523, 102: 3253, 103: 8663, 104: 7489, 105: 1697, 106: 577, 199: 5591,
}

MASK = 0xFFFFFFFF


def mul32(a: Column, b: int) -> Column:
    """a * b mod 2^32 for 0 <= a < 2^32."""
    low = a * F.lit(b & 0xFFFF).cast("long")
    high = F.shiftleft((a * F.lit(b >> 16).cast("long")).bitwiseAND(F.lit(0xFFFF).cast("long")), 16)
    return (low + high).bitwiseAND(F.lit(MASK))


def low_word(key: Column) -> Column:
    return key.bitwiseAND(F.lit(MASK))


def high_word(key: Column) -> Column:
    return F.shiftrightunsigned(key, 32)


def with_hash32(df: DataFrame, key: str, seeds: list[int], width: int = 8, prefix: str = "h") -> DataFrame:
    """Adds `{prefix}{seed}` (BIGINT in [0, 2^32)) for every seed. width: 8 or 4 bytes of the key are hashed."""
    keep = df.columns
    m, r = (lambda i: f"__m{i}"), (lambda s: f"__r{s}")
    words = [low_word(F.col(key))] + ([high_word(F.col(key))] if width == 8 else [])
    df = df.select(*keep, *[mul32(w, MULTIPLIERS[2]).alias(m(i)) for i, w in enumerate(words)])
    ms = [m(i) for i in range(len(words))]

    def step(df: DataFrame, f) -> DataFrame:
        return df.select(*keep, *ms, *[f(s).alias(r(s)) for s in seeds])

    for i in range(len(words)):
        before = (lambda s: F.lit(width + SEED_PRIMES[s] + MULTIPLIERS[4]).cast("long")) if i == 0 else (lambda s: F.col(r(s)))
        df = step(df, lambda s: (before(s) + F.col(m(i))).bitwiseAND(F.lit(MASK)))
        df = step(df, lambda s: F.shiftleft(F.col(r(s)).bitwiseAND(F.lit(0x7FFF)), 17).bitwiseOR(F.shiftright(F.col(r(s)), 15)))
        df = step(df, lambda s: mul32(F.col(r(s)), MULTIPLIERS[3]))
    for shift, by in ((15, MULTIPLIERS[1]), (13, MULTIPLIERS[2])):
        df = step(df, lambda s: F.col(r(s)).bitwiseXOR(F.shiftright(F.col(r(s)), shift)))
        df = step(df, lambda s: mul32(F.col(r(s)), by))
    return df.select(*keep, *[F.col(r(s)).bitwiseXOR(F.shiftright(F.col(r(s)), 16)).alias(f"{prefix}{s}") for s in seeds])
