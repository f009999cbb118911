"""Current status per dataset from a change feed."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def latest_status(changes: DataFrame) -> DataFrame:
    """Status of the latest change per dataset; late rows lose by their event time."""
    g = changes.groupBy("dataset_id").agg(F.max(F.struct("changed_at", "change_id", "status")).alias("_m"))
    return g.select("dataset_id", F.col("_m.status").alias("status"), F.col("_m.changed_at").alias("changed_at"), F.col("_m.change_id").alias("change_id"))


#: Parts of the status table; a batch rewrites only the parts it has datasets of.
BUCKETS = 64


def _bucket() -> Column:
    return F.pmod(F.xxhash64("dataset_id"), F.lit(BUCKETS)).cast("int")


def status_stream(changes: DataFrame, table_path: str, checkpoint: str, trigger=None):
    """Keep a parquet table of the latest status per dataset.

    Each micro-batch is reduced to one row per dataset, merged with the stored rows of the same
    buckets and written as a version of those buckets; a version counts once it is complete, so a
    batch that is retried after a lost executor overwrites its own version and nothing else.
    Versions before the last two of a bucket are deleted.
    """
    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = latest_status(batch).withColumn("bucket", _bucket())
        touched = {r["bucket"] for r in new.select("bucket").distinct().collect()}  # BUCKETS numbers at most
        kept = versions(spark, table_path, before=epoch)
        old = [paths[-1] for b, paths in kept.items() if b in touched]
        state = latest_status(new.drop("bucket").unionByName(spark.read.parquet(*old))) if old else new.drop("bucket")
        state.withColumn("bucket", _bucket()).write.mode("overwrite").partitionBy("bucket").parquet(os.path.join(table_path, f"v{epoch:012d}"))
        for b, paths in kept.items():
            for path in paths[:-1] if b in touched else []:
                _fs(spark, path)[0].delete(_fs(spark, path)[1], True)

    w = changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (w.trigger(**trigger) if trigger else w).start()


def _fs(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path in its terms."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, table_path: str, before: int | None = None) -> dict[int, list[str]]:
    """Paths of each bucket's complete versions (older than ``before``), oldest first."""
    fs, root = _fs(spark, table_path)
    out: dict[int, list[str]] = {}
    for status in sorted(fs.listStatus(root), key=lambda s: s.getPath().getName()) if fs.exists(root) else []:
        path = status.getPath()
        if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")) or before is not None and path.getName() >= f"v{before:012d}":
            continue
        for part in fs.listStatus(path):
            name = part.getPath().getName()
            if name.startswith("bucket="):
                out.setdefault(int(name.removeprefix("bucket=")), []).append(part.getPath().toString())
    return out


def read_status(spark: SparkSession, table_path: str) -> DataFrame | None:
    """The current table: the newest version of every bucket."""
    newest = [paths[-1] for paths in versions(spark, table_path).values()]
    return spark.read.parquet(*newest) if newest else None
