"""The registered queries over the reference's operators.

Keys: K = floor(events.value) (skewed), part keys (uniform); pairs: (supplier, part) of lineitem.
`_small` variants use 64 columns, where counters collide and a wrong estimator shows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillsum.config import CountMinConfig, CountSketchConfig, LogBucketConfig, SpreadConfig, UnivConfig
from rillsum.functions.hashing import with_hash32
from rillsum.functions.scalars import cardinality, median, pack_pair, source_of
from rillsum.operators import exact, linear
from rillsum.operators.linear import CountMin, CountSketch, Univ, keeper, keyed
from rillsum.operators.quantiles import LogBuckets
from rillsum.operators.spread import Spread
from rillsum.sources import keys as K
from rillsum.streaming.snapshots import SketchStream, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
ALPHA = 2e-3
SMALL, WIDE = 64, 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def skewed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.floor("value").cast("long").alias("key"), "event_id")


def prices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.floor("l_extendedprice").cast("long").alias("v"), "l_orderkey")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))


def cm(length: int) -> CountMin:
    return CountMin(CountMinConfig(length=length, alpha=ALPHA))


def cs(length: int) -> CountSketch:
    return CountSketch(CountSketchConfig(length=length, alpha=ALPHA))


def um(length: int) -> Univ:
    return Univ(UnivConfig(length=length, alpha=ALPHA))


def halves(df: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(by) % 2 == 0), df.where(F.col(by) % 2 != 0)


def merged(op, df: DataFrame, by: str) -> DataFrame:
    a, b = halves(df, by)
    return linear.merge(op.build(a, "key"), op.build(b, "key"))


def hash32_probe(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"))
    k = with_hash32(k, "key", [0, 1, 2, 101, 199])
    return with_hash32(k, "key", [0, 1, 2], width=4, prefix="src")


def dd_merge(spark: SparkSession, d: str) -> DataFrame:
    a, b = halves(prices(spark, d), "l_orderkey")
    dd = LogBuckets()
    return dd.quantiles(dd.merge(dd.build(a, "v"), dd.build(b, "v")))


def ss_merge(spark: SparkSession, d: str) -> DataFrame:
    a, b = halves(pairs(spark, d), "dst")
    s = Spread()
    regs = s.merge_registers(s.registers(a, "src", "dst"), s.registers(b, "src", "dst"))
    return s.estimate(regs, s.merge_candidates(s.candidates(a, "src", "dst"), s.candidates(b, "src", "dst")))


def ss_topk(spark: SparkSession, d: str) -> DataFrame:
    return Spread().spreads(pairs(spark, d), "src", "dst").orderBy(F.desc("est"), "src").limit(10)


def median3(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem")
    cols = [F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber").cast("long"), F.col("l_orderkey")]
    return e.groupBy(median(cols[:3]).alias("m3"), median(cols).alias("m4")).agg(F.count(F.lit(1)).alias("n"))


def streamed(spark: SparkSession, df: DataFrame, part: str, n: int, build: Callable, merge: Callable, min_rows: int = 0) -> SketchStream:
    """A stream over n files, file i with the rows where part = i, one file a batch in that order."""
    root = shared_dir(spark)
    for i in range(n):
        df.where(F.expr(part) == i).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    s = SketchStream(spark, build, merge, root)
    s.run(stream, min_rows=min_rows)
    return s


def key_stream(op, spark: SparkSession, d: str) -> SketchStream:
    return streamed(spark, skewed(spark, d), "event_id % 4", 4, lambda b: op.build(b, "key"), linear.merge)


def dd_stream(spark: SparkSession, d: str) -> DataFrame:
    dd = LogBuckets()
    s = streamed(spark, prices(spark, d), "l_orderkey % 3", 3, lambda b: dd.build(b, "v"), dd.merge)
    s.compact()
    return dd.quantiles(s.snapshot())


def ss_stream(spark: SparkSession, d: str) -> DataFrame:
    sp = Spread()
    cells = streamed(spark, pairs(spark, d), "dst % 3", 3, lambda b: sp.cells(b, "src", "dst"), sp.merge_cells).snapshot()
    return sp.estimate(sp.registers_of(cells), sp.candidates_of(cells))


def cm_gate(spark: SparkSession, d: str) -> DataFrame:
    """The publish gate over batches of six rows: more than ten must have come."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("key"))
    return streamed(spark, n, "key DIV 6", 5, lambda b: cm(SMALL).build(b, "key"), linear.merge, min_rows=10).log()


def um_point(spark: SparkSession, d: str, length: int) -> DataFrame:
    op, keys = um(length), skewed(spark, d)
    return op.estimate(op.build(keys, "key"), keyed(keys, "key"))


def packed_sources(spark: SparkSession, d: str) -> DataFrame:
    packed = pairs(spark, d).where("src IS NOT NULL AND dst IS NOT NULL").select(pack_pair(F.col("src"), F.col("dst")).alias("packed"))
    return packed.groupBy(source_of(F.col("packed")).alias("src")).agg(F.count(F.lit(1)).alias("n"))


def um_counters(length: int) -> Query:
    return lambda s, d: um(length).build(skewed(s, d), "key")


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        "exact_frequency": lambda s, d: exact.frequency(skewed(s, d), "key"),
        "exact_heavy_hitters": lambda s, d: exact.heavy_hitters(skewed(s, d), "key", ALPHA),
        "exact_quantiles": lambda s, d: exact.quantiles(prices(s, d), "v", LogBucketConfig().quantiles),
        "exact_spread": lambda s, d: exact.spread(pairs(s, d), "src", "dst"),
        "hash32_probe": hash32_probe,
        "median3": median3,
        "cm_counters": lambda s, d: cm(WIDE).build(skewed(s, d), "key").drop("level"),
        "cm_row_totals": lambda s, d: cm(WIDE).build(K.key_view(table(s, d, "lineitem"), "l_partkey"), "key").groupBy("row_id").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("cells")),
        "cm_partkey_small": lambda s, d: cm(SMALL).point_estimates(K.key_view(table(s, d, "lineitem"), "l_partkey"), "key"),
        "cm_merge": lambda s, d: merged(cm(SMALL), skewed(s, d), "event_id").drop("level"),
        "cm_keeper": lambda s, d: keeper(cm(SMALL).point_estimates(skewed(s, d), "key")),
        "cm_stream": lambda s, d: key_stream(cm(SMALL), s, d).snapshot().drop("level"),
        "cs_stream": lambda s, d: key_stream(cs(SMALL), s, d).snapshot().drop("level"),
        "um_stream": lambda s, d: key_stream(um(SMALL), s, d).snapshot(),
        "dd_stream": dd_stream,
        "ss_stream": ss_stream,
        "cm_snapshot": lambda s, d: key_stream(cm(SMALL), s, d).snapshot(1).drop("level"),
        "cm_staleness": lambda s, d: key_stream(cm(SMALL), s, d).staleness(),
        "cm_gate": cm_gate,
        "cs_counters": lambda s, d: cs(WIDE).build(skewed(s, d), "key").drop("level"),
        "cs_keeper": lambda s, d: keeper(cs(SMALL).point_estimates(skewed(s, d), "key").where("est > 0")),
        "um_keeper": lambda s, d: keeper(um_point(s, d, SMALL).where("est > 0"), levels=UnivConfig().levels),
        "um_accuracy": lambda s, d: exact.accuracy(um_point(s, d, WIDE).where("level = 0"), ALPHA),
        "um_accuracy_small": lambda s, d: exact.accuracy(um_point(s, d, SMALL).where("level = 0"), ALPHA),
        "cm_metrics": lambda s, d: exact.metrics(exact.accuracy(cm(SMALL).point_estimates(skewed(s, d), "key"), ALPHA)),
        "ss_candidates_gated": lambda s, d: Spread(SpreadConfig(min_rank=4)).candidates(pairs(s, d), "src", "dst"),
        "packed_sources": packed_sources,
        "cs_merge": lambda s, d: merged(cs(SMALL), skewed(s, d), "event_id").drop("level"),
        "um_levels": lambda s, d: um(WIDE).levels(table(s, d, "orders").select(F.col("o_orderkey").alias("key")), "key"),
        "um_counters": um_counters(WIDE),
        "um_counters_small": um_counters(SMALL),
        "um_merge": lambda s, d: merged(um(SMALL), skewed(s, d), "event_id"),
        "dd_histogram": lambda s, d: LogBuckets().build(prices(s, d), "v"),
        "dd_quantiles": lambda s, d: LogBuckets().quantiles(LogBuckets().build(prices(s, d), "v")),
        "dd_quantiles_zero": lambda s, d: LogBuckets().quantiles(LogBuckets().build(skewed(s, d), "key")),
        "dd_merge": dd_merge,
        "ss_registers": lambda s, d: Spread().registers(pairs(s, d), "src", "dst"),
        "ss_registers_gated": lambda s, d: Spread(SpreadConfig(min_rank=4)).registers(pairs(s, d), "src", "dst"),
        "ss_candidates": lambda s, d: Spread().candidates(pairs(s, d), "src", "dst"),
        "ss_candidates_small": lambda s, d: Spread(SpreadConfig(length=16)).candidates(pairs(s, d), "src", "dst"),
        "ss_spread": lambda s, d: Spread().spreads(pairs(s, d), "src", "dst"),
        "ss_spread_small": lambda s, d: Spread(SpreadConfig(length=16)).spreads(pairs(s, d), "src", "dst"),
        "ss_topk": ss_topk,
        "ss_merge": ss_merge,
        "zipf_keys": lambda s, d: K.zipf_keys_sql(s, 20_000, 1000).groupBy("key").agg(F.count(F.lit(1)).alias("cnt")),
        "pair_keys": lambda s, d: exact.spread(K.pair_keys(s, 64, 200), "src", "dst"),
        "snapshot_cardinality_empty": lambda s, d: s.range(1).select(cardinality(F.lit(63.0)).alias("card")),
    }
    for name, op in (("cm", cm), ("cs", cs)):
        for tag, length in (("", WIDE), ("_small", SMALL)):
            q[f"{name}_point_estimate{tag}"] = lambda s, d, op=op, n=length: op(n).point_estimates(skewed(s, d), "key")
            q[f"{name}_heavy_hitters{tag}"] = lambda s, d, op=op, n=length: op(n).heavy_hitters(skewed(s, d), "key")
            q[f"{name}_accuracy{tag}"] = lambda s, d, op=op, n=length: exact.accuracy(op(n).point_estimates(skewed(s, d), "key"), ALPHA)
    for tag, length in (("", WIDE), ("_small", SMALL)):
        q[f"um_level_heavy_hitters{tag}"] = lambda s, d, n=length: um(n).level_heavy_hitters(skewed(s, d), "key")
        q[f"um_heavy_hitters{tag}"] = lambda s, d, n=length: um(n).heavy_hitters(skewed(s, d), "key")
    return q


__all__ = ["queries", "keyed", "table"]
