"""Dataset catalogue: versions, lineage, metrics and outputs as append-only tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def validate_features(raw: DataFrame, feature_id: str = "feature_id"):
    """Split raw features (geom_type, lng, lat) into valid rows and a quarantine with a reason."""
    types = ["Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon"]
    reason = (F.when(F.col("geom_type").isNull(), "geometry missing").when(~F.col("geom_type").isin(types), "geometry type not supported")
              .when(F.col("lng").isNull() | F.col("lat").isNull(), "no coordinates"))
    d = raw.withColumn("reason", reason)
    return d.filter(F.col("reason").isNull()).drop("reason"), d.filter(F.col("reason").isNotNull()).select("dataset_id", feature_id, "reason")


def ingest_dataset(raw: DataFrame, versions: DataFrame) -> DataFrame:
    """Next version per dataset with feature count, bbox, parent version and outcome.

    ``raw``: dataset_id, geom_type, lng, lat (always the first raw version); ``versions``:
    dataset_id, version_number.  A dataset whose features are all invalid, or that has any
    unsupported geometry, is recorded as failed and keeps its current version.
    """
    types = ["Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon"]
    bad = F.col("geom_type").isNull() | ~F.col("geom_type").isin(types)
    s = raw.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("features"), F.sum(F.when(bad, 1).otherwise(0)).cast("long").alias("invalid"), F.count("lng").alias("_xy"),
        F.min("lng").alias("min_lng"), F.min("lat").alias("min_lat"), F.max("lng").alias("max_lng"), F.max("lat").alias("max_lat"))
    v = versions.groupBy("dataset_id").agg(F.max("version_number").alias("parent_version"))
    j = s.join(v, "dataset_id", "left")
    failed = (F.col("invalid") > 0) | (F.col("_xy") == 0)
    return j.select("dataset_id", F.when(failed, "failed").otherwise("processed").alias("status"), F.coalesce("parent_version", F.lit(0)).alias("parent_version"),
                    F.when(~failed, F.coalesce("parent_version", F.lit(0)) + 1).alias("version_number"), "features", "invalid", "min_lng", "min_lat", "max_lng", "max_lat")


def current_version(versions: DataFrame, order=("created_at", "version_id")) -> DataFrame:
    """Latest version per dataset, as an aggregate (no sort of long histories)."""
    cols = [c for c in versions.columns if c != "dataset_id"]
    g = versions.groupBy("dataset_id").agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_v"), F.count(F.lit(1)).alias("versions"))
    return g.select("dataset_id", "_v.*", "versions")


def pin_run_inputs(runs: DataFrame, datasets: DataFrame, current: DataFrame) -> DataFrame:
    """One row per run and input dataset with the version current at the start of the run."""
    ex = runs.select("run_id", "project_id", F.posexplode("input_dataset_ids").alias("position", "dataset_id"))
    return ex.join(datasets, "dataset_id").join(current.select("dataset_id", F.col("version_id").alias("pinned_version_id")), "dataset_id", "left")


def metric_table(wide: DataFrame, run_id, unit_type: str, unit_id: str, metrics, unit: str = "score") -> DataFrame:
    """Immutable long metrics: run, unit type, unit id, name, value, unit."""
    long = wide.select(F.lit(run_id).alias("run_id"), F.lit(unit_type).alias("unit_type"), F.col(unit_id).cast("string").alias("unit_id"), *[F.col(m).cast("double").alias(m) for m in metrics])
    return long.unpivot(["run_id", "unit_type", "unit_id"], list(metrics), "metric", "value").withColumn("unit", F.lit(unit))


def append_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("append").partitionBy("unit_type").parquet(path)


def denormalise_outputs(outputs: DataFrame, runs: DataFrame) -> DataFrame:
    """Project and owner of an output filled from its run where missing."""
    r = runs.select("run_id", F.col("project_id").alias("_p"), F.col("owner_id").alias("_o"))
    return outputs.join(r, "run_id", "left").withColumns({"project_id": F.coalesce("project_id", "_p"), "owner_id": F.coalesce("owner_id", "_o")}).drop("_p", "_o")
