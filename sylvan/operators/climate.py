"""Hourly weather and plant registers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formulas import COMPASS
from ..functions.numeric import count_where, js_round


def monthly_climate(df: DataFrame) -> DataFrame:
    """Mean and maximum temperature, humidity, wind and summed radiation per station and month."""
    return df.groupBy("station", "month").agg(
        F.bround(F.avg("dry_bulb_c"), 1).alias("mean_c"), F.max("dry_bulb_c").alias("max_c"), F.bround(F.avg("rh_pct"), 1).alias("rh_mean_pct"),
        F.bround(F.avg("wind_ms"), 2).alias("wind_mean_ms"), F.bround(F.sum("ghi_wh_m2") / 1000.0, 1).alias("ghi_kwh_m2"), F.count(F.lit(1)).alias("hours"))


def wind_sectors(df: DataFrame) -> DataFrame:
    """Hours per compass sector with measurable wind."""
    s = F.floor(F.pmod(F.col("wind_dir_deg") + 22.5, F.lit(360.0)) / 45.0).cast("int")
    name = F.get(F.array(*[F.lit(c) for c in COMPASS]), s)
    return df.filter((F.col("wind_ms") > 0.2) & (F.col("wind_dir_deg") < 360)).groupBy("station", name.alias("sector")).agg(F.count(F.lit(1)).alias("hours"))


def heat_hours(df: DataFrame) -> DataFrame:
    t = F.col("dry_bulb_c")
    return df.groupBy("station").agg(F.count(F.lit(1)).alias("hours"), count_where(t >= 35).alias("over_35"), count_where(t >= 40).alias("over_40"),
                                     count_where((t >= 35) & F.col("hour").between(17, 23)).alias("evening_over_35"))


def extreme_hours(df: DataFrame) -> DataFrame:
    """Hottest hour and the hour with the highest temperature plus 0.08 x humidity; first on ties."""
    row = F.struct("month", "day", "hour", "dry_bulb_c", "rh_pct", "wind_dir_deg", "wind_ms")
    g = df.groupBy("station").agg(F.max_by(row, F.struct("dry_bulb_c", -F.col("seq"))).alias("h"), F.max_by(row, F.struct(F.col("dry_bulb_c") + F.col("rh_pct") * 0.08, -F.col("seq"))).alias("m"))
    return g.select("station", F.inline(F.array(F.struct(F.lit("hottest").alias("kind"), F.col("h").alias("r")), F.struct(F.lit("hot_humid").alias("kind"), F.col("m").alias("r"))))).select("station", "kind", "r.*")


def season_extremes(seasons: DataFrame, group: str = "station") -> DataFrame:
    """Worst and best season by comfortable share (``season``, ``comfort_pct``, ``seq``)."""
    return seasons.groupBy(group).agg(F.min_by("season", F.struct("comfort_pct", "seq")).alias("worst_season"), F.max_by("season", F.struct("comfort_pct", -F.col("seq"))).alias("best_season"))


def plant_counts(df: DataFrame, fields) -> DataFrame:
    """Value counts of the given text columns in long form, in one aggregation."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    return df.select(F.inline(pairs)).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def plant_numeric(df: DataFrame, fields) -> DataFrame:
    """Count, minimum, mean and maximum of text columns that hold numbers; anything else is skipped."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).try_cast("double").alias("v")) for f in fields])
    return df.select(F.inline(pairs)).groupBy("field").agg(F.count("v").alias("n"), F.min("v").alias("min"), F.bround(F.avg("v"), 2).alias("mean"), F.max("v").alias("max"))


def plant_quality(df: DataFrame) -> DataFrame:
    """Rows, blank cells and duplicated scientific names."""
    cols = [c for c in df.columns]
    blank = sum([F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", 1).otherwise(0) for c in cols], F.lit(0))
    rows = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(blank).cast("long").alias("blank_cells"))
    dup = df.groupBy(F.trim("scientific_name").alias("_s")).agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") > 1) & (F.col("_s") != "")).agg(F.count(F.lit(1)).alias("duplicate_names"))
    return F.broadcast(rows).join(F.broadcast(dup), how="inner")  # one row each


# Shade by foliage density and leaf retention.
DENSITY = {"Extremely Dense": 1.0, "Very Dense": 0.9, "Dense": 0.75, "Medium": 0.55, "Open": 0.35}
RETENTION = {"Evergreen": 1.0, "Semi-Evergreen": 0.75, "Deciduous": 0.6}


def _pick(col, table, default):
    out = None
    for k, v in table.items():
        out = F.when(col == k, F.lit(v)) if out is None else out.when(col == k, F.lit(v))
    return out.otherwise(F.lit(default))


def plant_derivations(df: DataFrame) -> DataFrame:
    """Hydrozone, role, root radius, shade index and duplicate flag per plant.

    The duplicate flag joins a count per name (combined on the map side) instead of a window
    over the name, so a frequent name is not collected.
    """
    w, habit, dens = F.col("water_demand"), F.coalesce(F.col("habit"), F.lit("")), F.col("foliage_density")
    canopy, dbh = F.coalesce(F.col("canopy_m").try_cast("double"), F.lit(0.0)), F.coalesce(F.col("dbh_m").try_cast("double"), F.lit(0.0))
    has = lambda t: F.contains(F.lower(habit), F.lit(t))
    # Planting roles and hydrozone labels.
    role = (F.when(has("tree") & dens.isin("Dense", "Very Dense", "Extremely Dense"), "Canopy / shaded hollow").when(has("tree"), "Crest / structure tree")
            .when(has("grass"), "Slope stabilization / movement texture").when(has("groundcover"), "Groundcover / erosion control").otherwise("Shrub / habitat layer"))
    zone = (F.when(w == "Very Low", "HZ-CREST Desert Crest").when(w == "Low", "HZ-SLOPE Stabilized Slope").when(F.startswith(w, F.lit("Moderate")), "HZ-HOLLOW Shaded Hollow").otherwise("HZ-WATER Specialized Water"))
    names = df.groupBy("scientific_name").agg(F.count(F.lit(1)).alias("_n"))
    d = df.join(names, "scientific_name", "left")
    return d.withColumns({
        "hydrozone": zone, "role": role, "root_radius_m": js_round(F.greatest(canopy / 2.0, dbh * 6.0), 1),
        "shade_index": js_round(F.lit(math.pi) * F.pow(canopy / 2.0, 2) * _pick(dens, DENSITY, 0.2) * _pick(F.col("leaf_retention"), RETENTION, 0.8), 1),
        "duplicate_note": F.when(F.col("_n") > 1, "Duplicate scientific name").otherwise("")}).drop("_n")
