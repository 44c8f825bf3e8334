"""Relative-error quantiles over a log-bucket histogram of at most `buckets` rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillsum.config import LogBucketConfig
from rillsum.functions.scalars import bucket_value, log_bucket


class LogBuckets:
    def __init__(self, config: LogBucketConfig = LogBucketConfig()):
        self.c = config

    def build(self, df: DataFrame, value: str) -> DataFrame:
        """(bucket, cnt); null and non-positive values have no bucket and are left out."""
        b = df.select(log_bucket(F.col(value), self.c).alias("bucket")).where("bucket IS NOT NULL")
        return b.groupBy("bucket").agg(F.count(F.lit(1)).alias("cnt"))

    @staticmethod
    def merge(*sketches: DataFrame) -> DataFrame:
        return reduce(DataFrame.unionByName, sketches).groupBy("bucket").agg(F.sum("cnt").alias("cnt"))

    def quantiles(self, sketch: DataFrame, qs: tuple[float, ...] | None = None) -> DataFrame:
        """(quantile_index, bucket, value): per q the least bucket whose cumulative count exceeds q * n.

        The running sum sees at most `buckets` rows, whatever the input; empty input gives no rows.
        """
        qs = qs or self.c.quantiles
        w = Window.orderBy("bucket")
        cum = sketch.select("bucket", F.sum("cnt").over(w).alias("cum"), F.sum("cnt").over(Window.partitionBy()).alias("n"))
        q = F.explode(F.array(*[F.struct(F.lit(i).alias("quantile_index"), F.lit(float(x)).alias("q")) for i, x in enumerate(qs)])).alias("x")
        hit = cum.select("*", q).where(F.col("cum") > F.col("x.q") * F.col("n")).groupBy(F.col("x.quantile_index").alias("quantile_index")).agg(F.min("bucket").alias("bucket"))
        return hit.select("quantile_index", "bucket", bucket_value(F.col("bucket"), self.c).alias("value"))
