"""Incremental sketches with queryable snapshots.

Each micro-batch is reduced to its own sketch (bounded rows) and written under its batch id, so a
retried batch overwrites itself; the sketch after batch b is the merge of all parts up to b.  A batch is
published once more than `min_rows` rows have come since the last published one; until then its part waits,
and no row is lost.  `compact` merges old parts, so a read need not merge the whole history.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the cluster's shared checkpoint folder; without the setting only a local session gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.conf.get("spark.master", "").split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="rillsum-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


LOG = "batch_id long, n_rows long, pending long, published boolean"


class SketchStream:
    def __init__(self, spark: SparkSession, build: Callable[[DataFrame], DataFrame], merge: Callable[..., DataFrame], root: str | None = None):
        self.spark, self.build, self.merge, self.root = spark, build, merge, root or shared_dir(spark)
        self.empty: DataFrame | None = None

    def _read(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.root}/{name}")
        except AnalysisException:  # nothing was written yet
            return None

    def run(self, stream: DataFrame, once: bool = True, min_rows: int = 0):
        """Starts the query; with once it drains what is available and returns."""
        self.empty = self.spark.createDataFrame([], stream.schema)

        def publish(batch: DataFrame, batch_id: int) -> None:
            batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
            n = batch.count()
            self.build(batch).write.mode("overwrite").parquet(f"{self.root}/parts/batch_id={batch_id}")
            batch.unpersist()
            log = self._read("log")
            waiting = 0
            if log is not None:  # one row a batch
                log = log.where(F.col("batch_id") < batch_id)
                last = log.where("published").agg(F.max("batch_id")).first()[0]
                waiting = log.where(F.col("batch_id") > F.lit(-1 if last is None else last)).agg(F.sum("n_rows")).first()[0] or 0
            row = [(n, waiting + n, waiting + n > min_rows)]
            self.spark.createDataFrame(row, "n_rows long, pending long, published boolean").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/log/batch_id={batch_id}")

        w = stream.writeStream.foreachBatch(publish).option("checkpointLocation", f"{self.root}/offsets").outputMode("update")
        q = (w.trigger(availableNow=True) if once else w).start()
        if once:
            q.awaitTermination()
        return q

    def log(self) -> DataFrame:
        """(batch_id, n_rows, pending, published): rows of each batch, and rows since the last published one."""
        log = self._read("log")
        if log is None:
            return self.spark.createDataFrame([], LOG)
        return log.select(F.col("batch_id").cast("long").alias("batch_id"), "n_rows", "pending", "published")

    def compact(self) -> None:
        """Merges the parts up to the newest published batch into one that later snapshots start from."""
        last = self.log().where("published").agg(F.max("batch_id")).first()[0]
        if last is not None:
            self.snapshot(last).write.mode("overwrite").parquet(f"{self.root}/base/batch_id={last}")

    def snapshot(self, batch_id: int | None = None) -> DataFrame:
        """The sketch as of the newest published batch, up to batch_id if given; before any, the sketch of no row."""
        known = self.log().where("published")
        known = known if batch_id is None else known.where(F.col("batch_id") <= batch_id)
        last = known.agg(F.max("batch_id")).first()[0]
        if last is None:
            if self.empty is None:
                raise ValueError("nothing was published, and the schema of the stream is not known yet")
            return self.build(self.empty)
        parts, base = self.spark.read.parquet(f"{self.root}/parts").where(F.col("batch_id") <= last), self._read("base")
        from_ = None if base is None else base.where(F.col("batch_id") <= last).agg(F.max("batch_id")).first()[0]
        if from_ is not None:
            parts = parts.where(F.col("batch_id") > from_).unionByName(base.where(F.col("batch_id") == from_))
        return self.merge(parts.drop("batch_id"))

    def staleness(self) -> DataFrame:
        """(batch_id, n_rows, n_total): rows of each batch and so far; the window sees one row a batch."""
        from pyspark.sql import Window as W

        return self.log().select("batch_id", "n_rows", F.sum("n_rows").over(W.orderBy("batch_id")).alias("n_total"))
