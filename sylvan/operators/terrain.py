"""Terrain: triangle slopes, cut and fill, route profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.numeric import count_where, js_round
from .ranking import percentiles


def triangle_slopes(vertices: DataFrame, faces: DataFrame, group: str = "surface_id") -> DataFrame:
    """Slope % per face from vertex (vertex_id, x, y = elevation, z) and face (a, b, c) tables; vertical faces are dropped."""
    f = faces
    for k in "abc":
        v = vertices.select(group, F.col("vertex_id").alias(k), *[F.col(x).alias(f"{k}{x}") for x in "xyz"])
        f = f.join(v, [group, k])
    d = lambda p, x: F.col(f"{p}{x}") - F.col(f"a{x}")
    nx = d("b", "y") * d("c", "z") - d("b", "z") * d("c", "y")
    ny = d("b", "z") * d("c", "x") - d("b", "x") * d("c", "z")
    nz = d("b", "x") * d("c", "y") - d("b", "y") * d("c", "x")
    f = f.withColumns({"_v": F.abs(ny), "_h": F.sqrt(nx * nx + nz * nz)}).filter(F.col("_v") > 1e-9)
    return f.select(group, "face_id", (F.col("_h") / F.col("_v") * 100.0).alias("slope_pct"))


def slope_percentiles(slopes: DataFrame, group: str = "surface_id") -> DataFrame:
    """p50, p90, p95 (index int(q*(n-1))) and maximum."""
    return percentiles(slopes, "slope_pct", [50, 90, 95, 100], [group], span_minus_one=True).withColumn("value", js_round("value", 2))


def cut_fill(existing: DataFrame, proposed: DataFrame, spacing: float, group: str = "surface_id") -> DataFrame:
    """Earthwork between two surfaces sampled on one grid (ix, iy, z); cells missing in either are skipped."""
    a = existing.select(group, "ix", "iy", F.col("z").alias("_e"))
    j = proposed.select(group, "ix", "iy", F.col("z").alias("_p")).join(a, [group, "ix", "iy"]).withColumn("_d", F.col("_p") - F.col("_e"))
    d, cell = F.col("_d"), F.lit(spacing * spacing)
    g = j.groupBy(group).agg(
        F.count(F.lit(1)).alias("samples"), (F.sum(F.when(d < 0, -d).otherwise(0.0)) * cell).alias("cut"), (F.sum(F.when(d > 0, d).otherwise(0.0)) * cell).alias("fill"),
        (count_where(F.abs(d) > 0.001) * cell).alias("disturbed_area"), F.max(F.when(d < 0, -d).otherwise(0.0)).alias("max_cut"), F.max(F.when(d > 0, d).otherwise(0.0)).alias("max_fill"))
    total = F.col("cut") + F.col("fill")
    return g.withColumns({"net": F.col("fill") - F.col("cut"), "balance": F.when(total <= 1e-9, F.lit(0.0)).otherwise(F.abs(F.col("fill") - F.col("cut")) / total)})


def route_profile(points: DataFrame, max_slope_pct: float, route: str = "route_id", order: str = "i") -> DataFrame:
    """Lengths, gain, loss, slopes and the length that exceeds the slope limit per route."""
    w = W.partitionBy(route).orderBy(order)
    p = points.withColumns({f"_d{x}": F.col(x) - F.lag(x).over(w) for x in "xyz"}).filter(F.col("_dx").isNotNull())
    h = F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))
    p = p.withColumn("_h", h).withColumn("_s", F.when(F.col("_h") <= 1e-9, F.lit(float("inf"))).otherwise(F.abs("_dz") / F.col("_h") * 100.0))
    ws = F.when(F.col("_h") <= 1e-9, F.lit(0.0)).otherwise(F.col("_s") * F.col("_h"))
    g = p.groupBy(route).agg(F.sum("_h").alias("horizontal_m"), F.sum(F.sqrt(F.col("_h") * F.col("_h") + F.col("_dz") * F.col("_dz"))).alias("terrain_m"),
                             F.sum(F.when(F.col("_dz") > 0, F.col("_dz")).otherwise(0.0)).alias("gain_m"), F.sum(F.when(F.col("_dz") < 0, -F.col("_dz")).otherwise(0.0)).alias("loss_m"),
                             F.max("_s").alias("max_slope_pct"), F.sum(ws).alias("_w"), F.sum(F.when(F.col("_s") > max_slope_pct, F.col("_h")).otherwise(0.0)).alias("violation_m"))
    return g.withColumn("avg_slope_pct", F.when(F.col("horizontal_m") <= 1e-9, F.lit(0.0)).otherwise(F.col("_w") / F.col("horizontal_m"))).drop("_w")
