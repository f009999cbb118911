"""Session helpers: lineage cuts on shared storage and checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a
    cluster a missing setting is an error, because a machine-local folder would
    be lost with its executor.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on the shared checkpoint folder and return it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fixed_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A table of fixed values.  Its size is bounded by the code, so it is safe to broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def written_table(df: DataFrame) -> DataFrame:
    """Write ``df`` once as parquet below the shared checkpoint folder and read it back.

    For an expensive table that several branches of a plan use: it is computed once, later
    reads prune columns, and no filter is pushed below the expensive expressions.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = os.path.join(spark.sparkContext.getCheckpointDir(), "tables", uuid.uuid4().hex)
    df.write.parquet(path)
    return spark.read.parquet(path)


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the Python workers, which need not have it on their path; once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    # the driver serves the file itself, so its own temporary folder will do
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "sylvan_core.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
