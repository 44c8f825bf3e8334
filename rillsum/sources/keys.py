"""Key sources and sinks: key views of tables, fixed-width binary files, generators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def key_view(df: DataFrame, expr: Column | str, name: str = "key") -> DataFrame:
    """Any numeric expression as BIGINT keys (bit pattern of the unsigned key)."""
    e = F.expr(expr) if isinstance(expr, str) else expr
    return df.select(F.floor(e).cast("long").alias(name))


def read_u64(spark: SparkSession, path: str, chunk: int = 1 << 20) -> DataFrame:
    """(key BIGINT) of files of bare little-endian 8-byte keys; a trailing partial key is ignored.

    One row per file reaches Python as Arrow and leaves it in batches of `chunk` keys, for files under
    2 GB, the limit of a binary cell; read_u64_split reads larger ones.
    """
    import numpy as np
    import pyarrow as pa

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cell in b.column(0):
                buf = cell.as_buffer()
                keys = np.frombuffer(buf, "<i8", count=buf.size // 8)
                for i in range(0, len(keys), chunk):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + chunk])], ["key"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(decode, "key long")


def read_u64_split(spark: SparkSession, path: str, chunk: int = 1 << 16) -> DataFrame:
    """(key BIGINT) of files of any size: fixed-length records let Spark split a file, which a binary cell can't.

    The length of each file must be a multiple of 8 bytes.  Records reach Python by the partition and leave
    it as packed cells of `chunk` keys, so a row of the RDD is not a row of the result.
    """
    from itertools import islice

    def pack(records):
        while part := list(islice(records, chunk)):
            yield (bytearray(b"".join(part)),)

    cells = spark.createDataFrame(spark.sparkContext.binaryRecords(path, 8).mapPartitions(pack), "content binary")
    return unpacked(cells)


def write_u64(df: DataFrame, key: str, path: str) -> None:
    """Writes keys as packed cells (the bare 8-byte layout, one cell per Arrow batch) in Parquet files, through Spark's committer."""
    import numpy as np
    import pyarrow as pa

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = np.asarray(b.column(0).drop_null(), dtype="<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["content"])

    df.select(F.col(key).cast("long")).mapInArrow(encode, "content binary").write.mode("overwrite").parquet(path)


def unpacked(cells: DataFrame) -> DataFrame:
    """(key) of packed cells (content)."""
    import numpy as np
    import pyarrow as pa

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cell in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(cell.as_buffer(), "<i8"))], ["key"])

    return cells.select("content").mapInArrow(decode, "key long")


def read_packed_u64(spark: SparkSession, path: str) -> DataFrame:
    """Reads what write_u64 wrote."""
    return unpacked(spark.read.parquet(path))


def uniform(col: Column, salt: int) -> Column:
    """A hash-uniform double in [0, 1) from an integer column; the same in any engine.

    Two rounds of a multiplicative congruential step mod 2^31 - 1, which fits BIGINT arithmetic.
    """
    m = 2147483647
    x = (col.cast("long") + F.lit(salt)) % F.lit(m)
    x = (x * F.lit(48271) + F.lit(11)) % F.lit(m)
    x = (x * F.lit(69621) + (x / F.lit(65536)).cast("long")) % F.lit(m)
    x = (x * F.lit(16807) + (x / F.lit(32768)).cast("long")) % F.lit(m)
    return x.cast("double") / F.lit(float(m))


def zipf_keys(spark: SparkSession, n: int, universe: int, theta: float = 0.99, salt: int = 42, partitions: int | None = None) -> DataFrame:
    """(id, key): n draws of P(k) ~ k^-theta, 1 <= k <= universe, reproducible.

    The inverse of the cumulative mass is found by binary search in an array that is held once per
    executor (8 bytes x universe); each draw is independent, so generation needs no shuffle.
    """
    import numpy as np
    import pyarrow as pa

    cum = np.cumsum(np.arange(1, universe + 1, dtype="f8") ** -theta)
    cum = spark.sparkContext.broadcast(cum / cum[-1])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = np.searchsorted(cum.value, np.asarray(b.column(1)), side="right") + 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.minimum(k, universe).astype("i8"))], ["id", "key"])

    ids = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    return ids.select("id", uniform(F.col("id"), salt).alias("u")).mapInArrow(draw, "id long, key long")


def zipf_keys_sql(spark: SparkSession, n: int, universe: int, theta: float = 0.99, salt: int = 42) -> DataFrame:
    """As zipf_keys for a small universe (at most 65,536 keys), without Python: the cumulative mass as a literal array."""
    if universe > 1 << 16:
        raise ValueError("use zipf_keys beyond 65,536 keys")
    total = sum(k**-theta for k in range(1, universe + 1))
    cum, run = [], 0.0
    for k in range(1, universe + 1):
        run += k**-theta
        cum.append((k, (run - k**-theta) / total, run / total if k < universe else 2.0))
    steps = spark.createDataFrame(cum, "key long, lo double, hi double")
    u = spark.range(n).select("id", uniform(F.col("id"), salt).alias("u"))
    cell = lambda c: F.floor(c * 256)
    s = steps.select("*", F.explode(F.sequence(cell(F.col("lo")), F.least(cell(F.col("hi")), F.lit(255).cast("long")))).alias("cell"))
    return u.withColumn("cell", cell(F.col("u"))).join(F.broadcast(s), "cell").where("u >= lo AND u < hi").select("id", "key")


def pair_keys(spark: SparkSession, sources: int, fanout: int, salt: int = 7) -> DataFrame:
    """(src, dst): source s meets 1 + s * fanout / sources destinations, each twice."""
    s = spark.range(sources).select(F.col("id").alias("src"))
    n = (F.lit(1) + F.col("src") * fanout / F.lit(sources)).cast("long")
    d = s.select("src", F.explode(F.sequence(F.lit(0).cast("long"), n * 2 - 1)).alias("i"), n.alias("n"))
    return d.select("src", ((F.col("i") % F.col("n")) * 7919 + F.col("src") * salt).alias("dst"))
