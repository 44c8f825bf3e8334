"""Two-pass external shuffle and sharding, in DataFrame functions alone.

Pass 1 scatters records over memory-sized buckets by a seeded hash; pass 2 permutes each bucket with
the built-in seeded `shuffle`, which is a Fisher-Yates shuffle, and writes it.  The written order
(bucket, place) is the global order; shard s of n takes the places from ceil(s * N / n) up to the
next shard's, so row counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillsum.llm.common import scratch

LAW = "rows"


def shuffle_write(docs: DataFrame, path: str, seed: int = 17, bucket_bytes: int = 16 << 20) -> int:
    """Writes (bucket, place, rec) at path; rec holds all columns of docs, whatever their names.

    Null texts weigh 1 byte.  Repeated rows are records of their own: the hash takes in a row number
    besides doc_id, so a hot or null doc_id is scattered like any other.  An empty table writes no
    rows.  Returns the number of buckets.
    """
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)).first()[0] or 0
    n = max(1, -(-total // bucket_bytes))
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.monotonically_increasing_id())
    rows = docs.select(key.alias("key"), F.struct(*docs.columns).alias("rec")).select(F.pmod("key", F.lit(n)).alias("bucket"), F.struct("key", "rec").alias("row"))
    # by the key alone, since not every column type has an order
    by_key = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    grouped = rows.groupBy("bucket").agg(F.array_sort(F.collect_list("row"), by_key).alias("rows"))
    mixed = grouped.select("bucket", F.shuffle("rows", seed).alias("rows"))
    placed = mixed.select("bucket", F.posexplode("rows").alias("place", "row")).select("bucket", "place", F.col("row.rec").alias("rec"))
    placed.write.option("compression", "zstd").parquet(path)
    return n


def read_shards(spark: SparkSession, path: str, shards: int) -> DataFrame:
    """(rec, shard, slot) of what shuffle_write wrote; slots of a shard are gapless from 0."""
    t = spark.read.parquet(path)
    count = t.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    # a running sum over the buckets: one row per bucket_bytes of input
    at = count.select("bucket", (F.sum("n").over(W.orderBy("bucket")) - F.col("n")).alias("before"), F.sum("n").over(W.partitionBy()).alias("total"))
    pos = F.col("before") + F.col("place")
    out = t.join(at, "bucket").select("rec", pos.alias("pos"), "total")
    exact = F.expr(f"CAST((pos * {shards}) DIV total AS INT)")
    first = F.expr(f"(shard * total + {shards - 1}) DIV {shards}")
    return out.withColumn("shard", exact).select("rec", "shard", (F.col("pos") - first).alias("slot"))


def digest(spark: SparkSession, docs: DataFrame, shards: int = 8) -> DataFrame:
    path = scratch(spark, "shuffled")
    shuffle_write(docs, path)
    text = F.coalesce(F.col("rec.text"), F.lit(""))
    return read_shards(spark, path, shards).select(
        F.col("rec.doc_id").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
