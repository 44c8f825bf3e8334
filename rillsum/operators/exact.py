"""Exact answers and the accuracy report that compares a sketch with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frequency(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("key")).agg(F.count(F.lit(1)).alias("cnt"))


def heavy_hitters(df: DataFrame, key: str, alpha: float) -> DataFrame:
    f = frequency(df, key)
    n = f.agg(F.sum("cnt").alias("n"))
    return f.crossJoin(F.broadcast(n)).where(F.col("cnt") > F.floor(F.col("n") * F.lit(alpha))).select("key", "cnt")


def spread(df: DataFrame, src: str, dst: str) -> DataFrame:
    d = df.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    return d.groupBy(F.col(src).cast("long").alias("src")).agg(F.count_distinct(dst).alias("spread"))


def quantiles(df: DataFrame, value: str, qs: tuple[float, ...]) -> DataFrame:
    """(quantile_index, value): the least value whose cumulative count exceeds q * n.

    Values are counted first; the running sum is taken over the totals of 256 ranges, then within the ranges.
    The ranges are cut at approximate quantiles of the distinct values, so a heavy tail fills no range.
    """
    from pyspark.sql import Window as W

    f = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("cnt"))
    cuts = f.agg(F.percentile_approx("v", [i / 256 for i in range(1, 256)], 10_000).alias("cuts"))
    part = f.crossJoin(F.broadcast(cuts)).select("v", "cnt", F.size(F.filter("cuts", lambda x: x < F.col("v"))).alias("r"))
    tot = part.groupBy("r").agg(F.sum("cnt").alias("t"))
    off = tot.select("r", (F.sum("t").over(W.orderBy("r")) - F.col("t")).alias("before"), F.sum("t").over(W.partitionBy()).alias("n"))
    cum = part.join(F.broadcast(off), "r").select("v", "n", (F.col("before") + F.sum("cnt").over(W.partitionBy("r").orderBy("v"))).alias("cum"))
    q = F.explode(F.array(*[F.struct(F.lit(i).alias("quantile_index"), F.lit(float(x)).alias("q")) for i, x in enumerate(qs)])).alias("x")
    hit = cum.select("*", q).where(F.col("cum") > F.col("x.q") * F.col("n"))
    return hit.groupBy(F.col("x.quantile_index").alias("quantile_index")).agg(F.min("v").alias("value"))


def accuracy(est: DataFrame, alpha: float, near: int = 10_000) -> DataFrame:
    """One row over (key, cnt, est): recall cr, precision pr, mean absolute and relative error over keys heavy
    in both, and n_near, the estimates at or under the threshold by less than `near`."""
    n = est.agg(F.sum("cnt").alias("n"))
    e = est.crossJoin(F.broadcast(n.select(F.floor(F.col("n") * F.lit(alpha)).alias("t"))))
    is_est, is_true = F.col("est") > F.col("t"), F.col("cnt") > F.col("t")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    err = F.abs(F.col("est") - F.col("cnt"))
    a = e.agg(
        one(is_true).alias("n_true"), one(is_est).alias("n_est"), one(is_est & is_true).alias("n_both"),
        F.sum(F.when(is_est & is_true, err).otherwise(0)).cast("long").alias("abs_error"),
        F.floor(F.sum(F.when(is_est & is_true, F.floor(err * 1_000_000 / F.col("cnt"))).otherwise(0))).cast("long").alias("rel_error_ppm"),
        one(~is_est & (F.col("t") - F.col("est") < near)).alias("n_near"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.floor(F.col(a) * 1_000_000 / F.col(b))).cast("long")
    return a.select("*", ratio("n_both", "n_true").alias("cr_ppm"), ratio("n_both", "n_est").alias("pr_ppm"))


def metrics(acc: DataFrame) -> DataFrame:
    """(cr, pr, aae, are): the accuracy row as ratios; null where nothing is heavy."""
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b).cast("double"))
    return acc.select(
        ratio("n_both", "n_true").alias("cr"), ratio("n_both", "n_est").alias("pr"), ratio("abs_error", "n_both").alias("aae"),
        (ratio("rel_error_ppm", "n_both") / F.lit(1e6)).alias("are"),
    )


def write_metrics(acc: DataFrame, path: str) -> None:
    """Appends the metrics as one JSON line a call, through Spark's committer."""
    metrics(acc).withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").json(path)
