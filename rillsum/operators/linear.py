"""Linear counter sketches: count-min, count-sketch and the layered sketch.

A sketch is the relation (level, row_id, pos, v).  Build hashes the rows where they are scanned and is one
partial and one final hash aggregate over cells, so what is shuffled is at most cells x map tasks whatever
the rows, the distinct keys and however hot a key is; merge is a union and the same aggregate.  Point estimates look counters
up in the packed form (cell position -> array over rows), whose size the config bounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillsum.config import BROADCAST_CELLS, CountMinConfig, CountSketchConfig, KeeperConfig, UnivConfig
from rillsum.functions.hashing import with_hash32
from rillsum.functions.scalars import column_of, median, sample_depth, sign_of, signed_column_of


def keyed(df: DataFrame, key: str) -> DataFrame:
    """(key, cnt): one row per distinct non-null key, so every key is hashed once."""
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("key")).agg(F.count(F.lit(1)).alias("cnt"))


def each(df: DataFrame, key: str) -> DataFrame:
    """(key, cnt): every row with a non-null key, counted once."""
    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.lit(1).cast("long").alias("cnt"))


def count_of(df: DataFrame, key: str) -> DataFrame:
    """(n): rows with a key, one row per task shuffled."""
    return df.where(F.col(key).isNotNull()).agg(F.count(F.lit(1)).alias("n"))


def _seeds(levels: int, rows: int) -> list[int]:
    return [level * rows + row for level in range(levels) for row in range(rows)]


def hashed(keys: DataFrame, levels: int, rows: int, length: int, signed: bool, level_seed: int | None = None) -> DataFrame:
    """Adds depth (deepest level of the key), p{level}_{row} and, if signed, s{level}_{row}."""
    seeds = _seeds(levels, rows)
    base = keys.columns
    h = with_hash32(keys, "key", seeds + ([level_seed] if level_seed is not None else []))
    place = signed_column_of if signed else column_of
    cols: list[Column] = [(sample_depth(F.col(f"h{level_seed}"), levels) if level_seed is not None else F.lit(0)).alias("depth")]
    for s in seeds:
        cols.append(place(F.col(f"h{s}"), length).alias(f"p{s // rows}_{s % rows}"))
        if signed:
            cols.append(sign_of(F.col(f"h{s}")).alias(f"s{s // rows}_{s % rows}"))
    return h.select(*base, *cols)


def counters(hashed_keys: DataFrame, levels: int, rows: int, signed: bool) -> DataFrame:
    """(level, row_id, pos, v) of hashed (key, cnt)."""
    cells = F.array(*[
        F.struct(F.lit(level).alias("level"), F.lit(row).alias("row_id"), F.col(f"p{level}_{row}").alias("pos"),
                 ((F.col(f"s{level}_{row}") * F.col("cnt")) if signed else F.col("cnt")).alias("v"))
        for level in range(levels) for row in range(rows)
    ])
    cells = cells if levels == 1 else F.slice(cells, F.lit(1), (F.col("depth") + 1) * rows)
    return hashed_keys.select(F.explode(cells).alias("c")).groupBy("c.level", "c.row_id", "c.pos").agg(F.sum("c.v").alias("v"))


def merge(*sketches: DataFrame) -> DataFrame:
    """The sketch of the union of the inputs."""
    keys = [c for c in sketches[0].columns if c != "v"]
    return reduce(DataFrame.unionByName, sketches).groupBy(*keys).agg(F.sum("v").alias("v"))


def packed(sketch: DataFrame, rows: int, length: int) -> DataFrame:
    """(cell, vs): cell = level * length + pos, vs[row] the counter; one plan serves all lookups."""
    v = [F.sum(F.when(F.col("row_id") == r, F.col("v")).otherwise(F.lit(0))) for r in range(rows)]
    return sketch.groupBy((F.col("level") * length + F.col("pos")).alias("cell")).agg(F.array(*v).alias("vs"))


def looked_up(hashed_keys: DataFrame, sketch: DataFrame, level: int | None, rows: int, length: int, levels: int, signed: bool, least: DataFrame | None = None) -> DataFrame:
    """Adds est: the minimum (unsigned) or median (signed) over rows of a key's counters.

    With level None the keys are read at every level up to their depth, and level is added.  least: a one-row
    relation (least); keys whose first counter does not exceed it leave before the other rows are read.
    """
    side = packed(sketch, rows, length)
    side = F.broadcast(side) if levels * length <= BROADCAST_CELLS else side.hint("shuffle_hash")
    if level is None:
        per = F.array(*[
            F.struct(F.lit(lv).alias("level"), *[F.col(f"p{lv}_{r}").alias(f"p{r}") for r in range(rows)],
                     *([F.col(f"s{lv}_{r}").alias(f"s{r}") for r in range(rows)] if signed else []))
            for lv in range(levels)
        ])
        at = hashed_keys.select("key", "cnt", F.explode(F.slice(per, F.lit(1), F.col("depth") + 1)).alias("x")).select("key", "cnt", "x.*")
    else:
        at = hashed_keys.select(
            "key", "cnt", F.lit(level).alias("level"), *[F.col(f"p{level}_{r}").alias(f"p{r}") for r in range(rows)],
            *([F.col(f"s{level}_{r}").alias(f"s{r}") for r in range(rows)] if signed else []),
        )
    for r in range(rows):
        t = side.select(F.col("cell").alias(f"c{r}"), F.col("vs").alias(f"vs{r}"))
        at = at.join(t, F.col("level") * length + F.col(f"p{r}") == F.col(f"c{r}"), "left")
        if r == 0 and least is not None:
            at = at.crossJoin(F.broadcast(least)).where(F.col("vs0")[0] > F.col("least")).drop("least")
    v = [F.coalesce(F.col(f"vs{r}")[r], F.lit(0).cast("long")) for r in range(rows)]
    v = [F.col(f"s{r}") * x for r, x in enumerate(v)] if signed else v
    est = median(v) if signed else (F.least(*v) if rows > 1 else v[0])
    return at.select("key", "cnt", "level", est.alias("est"))


def over_threshold(est: DataFrame, total: DataFrame, alpha: float) -> DataFrame:
    """Rows with est > floor(alpha * n); total is a one-row relation (n)."""
    return est.crossJoin(F.broadcast(total)).where(F.col("est") > F.floor(F.col("n") * F.lit(alpha)))


class CountMin:
    """Frequency estimates that never fall short of the truth."""

    def __init__(self, config: CountMinConfig = CountMinConfig()):
        self.c = config

    def _hashed(self, keys: DataFrame) -> DataFrame:
        return hashed(keys, 1, self.c.rows, self.c.length, False)

    def build(self, df: DataFrame, key: str) -> DataFrame:
        return counters(self._hashed(each(df, key)), 1, self.c.rows, False)

    def estimate(self, sketch: DataFrame, keys: DataFrame) -> DataFrame:
        """(key, cnt, est) for keys (key, cnt)."""
        return looked_up(self._hashed(keys), sketch, 0, self.c.rows, self.c.length, 1, False).drop("level")

    def point_estimates(self, df: DataFrame, key: str) -> DataFrame:
        return self.estimate(self.build(df, key), keyed(df, key))

    def heavy_hitters(self, df: DataFrame, key: str) -> DataFrame:
        """Keys with est > alpha * n; n is what one row of the sketch holds, and alpha / 2 * n the pre-filter."""
        sketch = self.build(df, key)
        n = sketch.where("row_id = 0").agg(F.sum("v").alias("n"))
        least = n.select(F.floor(F.col("n") * F.lit(self.c.alpha / 2)).alias("least"))
        est = looked_up(self._hashed(keyed(df, key)), sketch, 0, self.c.rows, self.c.length, 1, False, least)
        return over_threshold(est, n, self.c.alpha).select("key", "est")


class CountSketch:
    """Signed counters: estimates centred on the truth."""

    def __init__(self, config: CountSketchConfig = CountSketchConfig()):
        self.c = config

    def _hashed(self, keys: DataFrame) -> DataFrame:
        return hashed(keys, 1, self.c.rows, self.c.length, True)

    def build(self, df: DataFrame, key: str) -> DataFrame:
        return counters(self._hashed(each(df, key)), 1, self.c.rows, True)

    def estimate(self, sketch: DataFrame, keys: DataFrame) -> DataFrame:
        return looked_up(self._hashed(keys), sketch, 0, self.c.rows, self.c.length, 1, True).drop("level")

    def point_estimates(self, df: DataFrame, key: str) -> DataFrame:
        return self.estimate(self.build(df, key), keyed(df, key))

    def heavy_hitters(self, df: DataFrame, key: str) -> DataFrame:
        return over_threshold(self.point_estimates(df, key).where("est > 0"), count_of(df, key), self.c.alpha).select("key", "est")


class Univ:
    """Count-sketches over nested samples of the key space: level l keeps a key with probability 2^-l."""

    def __init__(self, config: UnivConfig = UnivConfig()):
        self.c = config

    def _hashed(self, keys: DataFrame) -> DataFrame:
        c = self.c
        return hashed(keys, c.levels, c.rows, c.length, True, c.level_seed)

    def levels(self, df: DataFrame, key: str) -> DataFrame:
        """(level, n_keys, n_rows): distinct keys and rows that each level holds."""
        h = with_hash32(keyed(df, key), "key", [self.c.level_seed])
        depth = sample_depth(F.col(f"h{self.c.level_seed}"), self.c.levels)
        at = h.select("cnt", F.explode(F.sequence(F.lit(0), depth)).alias("level"))
        return at.groupBy("level").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("cnt").alias("n_rows"))

    def build(self, df: DataFrame, key: str) -> DataFrame:
        return counters(self._hashed(each(df, key)), self.c.levels, self.c.rows, True)

    def estimate(self, sketch: DataFrame, keys: DataFrame) -> DataFrame:
        """(key, cnt, level, est) at every level that holds the key, by that level's own seeds."""
        c = self.c
        return looked_up(self._hashed(keys), sketch, None, c.rows, c.length, c.levels, True)

    def level_heavy_hitters(self, df: DataFrame, key: str) -> DataFrame:
        est = self.estimate(self.build(df, key), keyed(df, key)).where("est > 0")
        return over_threshold(est, count_of(df, key), self.c.alpha).select("level", "key", "est")

    def heavy_hitters(self, df: DataFrame, key: str) -> DataFrame:
        """One row per key: the estimate of the lowest level that reports it."""
        per = self.level_heavy_hitters(df, key).groupBy("key").agg(F.min(F.struct("level", "est")).alias("x"))
        return per.select("key", F.col("x.level").alias("level"), F.col("x.est").alias("est"))


def keeper(est: DataFrame, c: KeeperConfig = KeeperConfig(), levels: int = 0) -> DataFrame:
    """The bounded keeper: per hash bucket the `slots` largest estimates, ties to the smaller key.

    With levels, est has a level and every level a keeper of its own, hashed by seed + level.  Row numbers
    under a limit get a per-task window group limit, so a bucket is cut before the shuffle.
    """
    from pyspark.sql import Window as W

    seeds, own = [c.seed + level for level in range(max(1, levels))], ["level"] if levels else []
    h = with_hash32(est.select(*own, "key", "est"), "key", seeds)
    place = F.element_at(F.array(*[F.col(f"h{x}") for x in seeds]), F.col("level") + 1) if levels else F.col(f"h{c.seed}")
    b = h.select(*own, "key", "est", (place % c.buckets).alias("bucket"))
    rank = F.row_number().over(W.partitionBy(*own, "bucket").orderBy(F.desc("est"), "key"))
    return b.withColumn("slot", rank).where(F.col("slot") <= c.slots).select(*own, "bucket", "slot", "key", "est")
