"""Cell scores, land-use classes and study-area bands."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formulas as fm
from ..functions.geo import bearing_deg, compass, haversine_m
from ..functions.numeric import any_of, clamp, js_round, norm
from ..functions.session import fixed_table
from .ranking import exact_rank, zscore

PARK = ("park_id",)


def road_tier(highway="highway"):
    """Tier of a highway tag by substring; the first matching tier wins."""
    hw = F.coalesce(F.col(highway), F.lit(""))
    out = None
    for tier, tags in fm.ROAD_TIERS:
        cond = any_of([F.contains(hw, F.lit(t)) for t in tags])
        out = F.when(cond, F.lit(tier)) if out is None else out.when(cond, F.lit(tier))
    return out.otherwise(F.lit("other"))


def is_circulation(highway="highway"):
    hw = F.coalesce(F.col(highway), F.lit(""))
    return any_of([F.contains(hw, F.lit(t)) for t in fm.CIRCULATION])


def avg_road_width(roads: DataFrame, group_cols=PARK) -> DataFrame:
    """Length-weighted road width per area; 5 m where there is no length."""
    width = None
    t = road_tier()
    for tier, w in fm.ROAD_WIDTHS.items():
        width = F.when(t == tier, F.lit(float(w))) if width is None else width.when(t == tier, F.lit(float(w)))
    length = F.coalesce(F.col("length"), F.lit(0.0))
    g = roads.groupBy(*group_cols).agg(F.sum(length * width).alias("_a"), F.sum(length).alias("_l"))
    return g.select(*group_cols, F.coalesce(F.try_divide("_a", "_l"), F.lit(5.0)).alias("road_width_m"))


def with_road_width(cells: DataFrame, roads: DataFrame | None = None, group_cols=PARK) -> DataFrame:
    if roads is None:
        return cells.withColumn("road_width_m", F.lit(5.0))
    return cells.join(avg_road_width(roads, group_cols), list(group_cols), "left").withColumn("road_width_m", F.coalesce("road_width_m", F.lit(5.0)))


def score_cells(cells: DataFrame, tree_weights=None) -> DataFrame:
    """All cell scores in one projection (``road_width_m`` required); unused ones are pruned."""
    return cells.selectExpr("*", *[f"{e} AS {k}" for k, e in fm.cell_formulas(tree_weights).items()])


INSTITUTIONAL = ["school_count", "hospital_count", "clinic_count", "mosque_count"]
COMMERCIAL = ["restaurant_count", "cafe_count", "shop_count"]
LAND_USES = ["Residential", "Commercial", "Institutional", "Parks / Open Space", "Undeveloped"]


def classify_land_use(cells: DataFrame, group_cols=PARK) -> DataFrame:
    """Land-use class from the mean z-scores of institutional and commercial fields."""
    zc = zscore(cells, INSTITUTIONAL + COMMERCIAL, group_cols)

    def mean(fields):
        out = F.col(f"z_{fields[0]}")
        for f in fields[1:]:
            out = out + F.col(f"z_{f}")
        return out / F.lit(float(len(fields)))

    inst, comm = mean(INSTITUTIONAL), mean(COMMERCIAL)
    area = F.when(F.coalesce("hex_area_m2", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("hex_area_m2"))
    return zc.withColumn("land_use", F.when(F.coalesce("park_area_m2", F.lit(0.0)) / area >= 0.3, F.lit("Parks / Open Space"))
                         .when(F.coalesce("building_coverage_pct", F.lit(0.0)) < 2, F.lit("Undeveloped"))
                         .when((inst < 0.5) & (comm < 0.5), F.lit("Residential"))
                         .when(inst > comm, F.lit("Institutional")).otherwise(F.lit("Commercial"))
                         ).drop(*[f"z_{f}" for f in INSTITUTIONAL + COMMERCIAL])


def land_use_breakdown(cells: DataFrame, group_cols=PARK) -> DataFrame:
    """Cells, area and share per class (empty classes kept), dominant class and diversity 0-100."""
    keys = list(group_cols)
    d = classify_land_use(cells, keys)
    agg = []
    for i, u in enumerate(LAND_USES):
        agg += [F.sum(F.when(F.col("land_use") == u, 1).otherwise(0)).alias(f"_n{i}"), F.sum(F.when(F.col("land_use") == u, F.coalesce("hex_area_km2", F.lit(0.0))).otherwise(0.0)).alias(f"_a{i}")]
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum("hex_area_km2").alias("_t"), *agg)
    ent = F.lit(0.0)
    for i in range(5):
        p = F.col(f"_n{i}") / F.col("_n")
        ent = ent - F.when(p > 0, p * F.ln(p)).otherwise(F.lit(0.0))
    dominant = None
    best = F.greatest(*[js_round(F.col(f"_a{i}"), 2) for i in range(5)])
    for i, u in enumerate(LAND_USES):
        cond = js_round(F.col(f"_a{i}"), 2) == best
        dominant = F.when(cond, F.lit(u)) if dominant is None else dominant.when(cond, F.lit(u))
    g = g.withColumns({"diversity_index": js_round(ent / F.ln(F.lit(5.0)) * 100.0), "dominant_land_use": dominant})
    rows = F.array(*[F.struct(F.lit(u).alias("category"), F.col(f"_n{i}").cast("long").alias("hex_count"), js_round(F.col(f"_a{i}"), 2).alias("area_km2"),
                              (js_round(F.try_divide(f"_a{i}", "_t") * 1000.0) / 10.0).alias("pct")) for i, u in enumerate(LAND_USES)])
    return g.select(*keys, "diversity_index", "dominant_land_use", F.inline(rows))


def distance_from_center(cells: DataFrame) -> DataFrame:
    return cells.withColumn("center_distance_m", haversine_m("center_lng", "center_lat", "lng", "lat"))


def review_signal(cells: DataFrame, topic_rates: DataFrame, group_cols=PARK) -> DataFrame:
    """Park-level topic rate spread over cells by population share.

    ``topic_rates``: group columns, category, rate.  Adds one row per cell and category;
    the window of the totals is replaced by a join with one row per area.
    """
    keys = list(group_cols)
    tot = cells.groupBy(*keys).agg(F.sum(F.coalesce("population", F.lit(0.0))).alias("_p"), F.count(F.lit(1)).alias("_n"))
    j = cells.join(tot, keys).join(topic_rates, keys)
    pop = F.when(F.col("_p") == 0, F.lit(1.0)).otherwise(F.col("_p"))
    sig = js_round(norm(F.coalesce("population", F.lit(0.0)) / pop * F.col("rate") * 100.0 * F.col("_n"), 100))
    return j.withColumn("review_signal", sig).drop("_p", "_n")


def top_share_zone(cells: DataFrame, metric: str, share: float = 0.05, group_cols=PARK, seq: str = "seq", extra=()) -> DataFrame:
    """Highest ``share`` of the cells per area: mean position and compass direction from the centre.

    The ranking is exact and split over tasks, so a study area of any size works.
    """
    keys = list(group_cols)
    tot = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ranked = exact_rank(cells, keys, [F.desc(metric), F.asc(seq)], "_rank").join(tot, keys)
    top = ranked.filter(F.col("_rank") <= F.greatest(F.lit(1.0), js_round(F.col("_n") * share)))
    g = top.groupBy(*keys).agg(F.count(F.lit(1)).alias("cells"), F.avg("lng").alias("_lng"), F.avg("lat").alias("_lat"), F.first("center_lng").alias("_cx"),
                               F.first("center_lat").alias("_cy"), *extra)
    b = bearing_deg("_cx", "_cy", "_lng", "_lat")
    return g.withColumn("compass", compass(b)).drop("_lng", "_lat", "_cx", "_cy")


def walking_catchments(cells: DataFrame, group_cols=PARK, etl_rounding: bool = False, bands=None) -> DataFrame:
    """Cumulative walking-time bands.  The bands are a fixed table of a few rows, range-joined."""
    keys = list(group_cols)
    rows = [(int(m),) for m in bands or fm.WALK_BANDS]
    bt = fixed_table(cells.sparkSession, rows, "minutes int")
    tot = cells.groupBy(*keys).agg(F.sum(F.coalesce("population", F.lit(0.0))).alias("_total"))
    cols = ["population", "hex_area_km2", "school_count", "bus_stop_count", "clinic_count", "mosque_count", "restaurant_count", "cafe_count", "shop_count"]
    d = cells.filter(F.col("walking_time_to_park_minutes").isNotNull()).join(bt, F.col("walking_time_to_park_minutes") <= F.col("minutes"))
    z = lambda x: F.sum(F.coalesce(x, F.lit(0.0)))
    g = d.groupBy(*keys, "minutes").agg(
        F.count(F.lit(1)).alias("hex_count"), *[z(x).alias(x) for x in cols], F.avg("network_distance_to_park_m").alias("_d"), F.avg("route_directness_ratio").alias("_r"))
    spine = tot.withColumn("minutes", F.explode(F.array(*[F.lit(m) for (m,) in rows])))
    j = spine.join(g, [*keys, "minutes"], "left").fillna(0, ["hex_count", *cols])
    rnd = (lambda x, dp=0: F.bround(x, dp)) if etl_rounding else js_round
    total = F.when(F.col("_total") == 0, F.lit(1.0)).otherwise(F.col("_total"))
    return j.select(
        *keys, "minutes", rnd(F.col("population")).alias("population"), rnd(F.col("hex_area_km2"), 3 if etl_rounding else 2).alias("area_km2"),
        F.coalesce(rnd(F.try_divide("population", "hex_area_km2")), F.lit(0.0)).alias("density_per_km2"),
        (rnd(F.col("population") / total * 1000.0) / 10.0).alias("pct_of_total"), "hex_count", F.col("school_count").alias("schools"), F.col("bus_stop_count").alias("bus_stops"),
        F.col("clinic_count").alias("clinics"), F.col("mosque_count").alias("mosques"), (F.col("restaurant_count") + F.col("cafe_count") + F.col("shop_count")).alias("commercial"),
        rnd(F.col("_d")).alias("avg_route_distance_m"), rnd(F.col("_r"), 3).alias("avg_directness"))


def radius_catchments(cells: DataFrame, group_cols=PARK) -> DataFrame:
    """Cumulative rings around the centre with visitor estimates."""
    keys = list(group_cols)
    rings = fixed_table(cells.sparkSession, [(float(r), lab, rate, i == 0) for i, (r, lab, rate) in enumerate(fm.RINGS)], "radius_m double, visit_label string, rate double, daily boolean")
    d = distance_from_center(cells).select(*keys, "population", "center_distance_m")
    g = d.join(rings, F.col("center_distance_m") <= F.col("radius_m")).groupBy(*keys, "radius_m").agg(
        F.sum(F.coalesce("population", F.lit(0.0))).alias("_pop"), F.count(F.lit(1)).alias("hex_count"))
    ring_rows = F.array(*[F.struct(F.lit(float(r)).alias("radius_m"), F.lit(lab).alias("visit_label"), F.lit(rate).alias("rate"), F.lit(i == 0).alias("daily"))
                          for i, (r, lab, rate) in enumerate(fm.RINGS)])
    spine = cells.select(*keys).distinct().select(*keys, F.inline(ring_rows))
    last = d.filter(F.col("center_distance_m") <= fm.RINGS[-1][0]).groupBy(*keys).agg(F.sum(F.coalesce("population", F.lit(0.0))).alias("_max"))
    j = spine.join(g, [*keys, "radius_m"], "left").join(last, keys, "left").fillna(0, ["_pop", "hex_count", "_max"])
    area = F.lit(math.pi) * F.pow(F.col("radius_m") / 1000.0, 2)
    top = F.when(F.col("_max") == 0, F.lit(1.0)).otherwise(F.col("_max"))
    return j.select(*keys, "radius_m", js_round("_pop").alias("population"), js_round(area, 2).alias("area_km2"), js_round(F.col("_pop") / area).alias("density_per_km2"),
                    js_round(F.col("_pop") / top * 100.0, 1).alias("pct_of_total"), "hex_count", "visit_label",
                    js_round(F.col("_pop") * F.col("rate") / F.when(F.col("daily"), F.lit(7.0)).otherwise(F.lit(1.0))).alias("visitors"))


def clamp100(x):
    return clamp(js_round(x), F.lit(0.0), F.lit(100.0))
