"""Study-area reports: aggregates over scored cells, one row per area or tidy metric rows.

Every report is one aggregation of the cells per area (map-side combined) joined with
one-row-per-area inputs such as road statistics, review health scores and facility counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formulas as fm
from ..functions import lexicon as lx
from ..functions.geo import haversine_m
from ..functions.numeric import band, count_where, js_round, norm
from ..functions.session import fixed_table
from . import cells as cl
from .ranking import percentiles

PARK = ("park_id",)


def z(x):
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(0.0))


def cell_sums(cells: DataFrame, group_cols=PARK) -> DataFrame:
    """Sums and means shared by the reports (scored cells expected)."""
    return cells.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("cells"), F.sum(z("population")).alias("pop"), F.sum(z("hex_area_km2")).alias("km2"), F.sum(z("hex_area_m2")).alias("m2"),
        F.sum(z("building_count")).alias("bldg"), F.sum(z("building_area_m2")).alias("bldg_m2"), F.avg(z("building_coverage_pct")).alias("cov"),
        F.avg(z("green_coverage_pct")).alias("green"), (F.sum(z("green_coverage_pct") * z("hex_area_m2")) / 100.0).alias("green_m2"), F.avg(z("pop_density_km2")).alias("avg_density"),
        F.sum(z("playground_count")).alias("playgrounds"), F.sum(z("intersection_count_hex")).alias("crossings"), F.avg("route_directness_ratio").alias("directness"),
        F.avg(z("amenity_total")).alias("amenity"), F.avg(z("barrier_score_hex")).alias("barrier"), F.avg("transit_score").alias("transit"), F.avg("demand_score").alias("demand"),
        F.avg("nearest_bus_stop_distance_m").alias("bus_m"), F.sum(F.when(F.col("nearest_bus_stop_distance_m") <= 400, z("population")).otherwise(0.0)).alias("pop400"),
        F.sum(z("real_road_length_m") * F.col("road_width_m")).alias("road_m2"), F.avg("heat_score").alias("heat"),
        F.avg(F.when(F.col("heat_score") >= 65, 1.0).otherwise(0.0)).alias("hot"), F.avg(F.when(F.col("heat_score") <= 35, 1.0).otherwise(0.0)).alias("cool"),
        F.avg("cooling_score").alias("cooling"), F.avg("facility_access_score").alias("fac"), F.avg("diversity_score").alias("div"), F.avg("family_demand_score").alias("fam"),
        F.avg("youth_demand_score").alias("you"), F.avg("older_demand_score").alias("old"), F.avg("walking_time_to_park_minutes").alias("walk"),
        F.sum(F.when(F.col("network_distance_to_park_m").isNotNull(), z("population") * F.col("network_distance_to_park_m"))).alias("wd"),
        F.sum(F.when(F.col("network_distance_to_park_m").isNotNull(), z("population"))).alias("wp"), F.avg("network_distance_to_park_m").alias("nd"), F.max("network_distance_to_park_m").alias("nmax"),
    )


def road_stats(roads: DataFrame, area: DataFrame | None = None, group_cols=PARK) -> DataFrame:
    """Network summary per area: lengths, tiers, degree counts, block estimate.

    ``area``: group columns and km2.  Degrees come from one undirected, deduplicated edge
    list; its endpoints are counted per node before anything is counted per area.
    """
    keys = list(group_cols)
    t = cl.road_tier()
    tiers = [x for x, _ in fm.ROAD_TIERS] + ["other"]
    ln = F.coalesce("length", F.lit(0.0))
    agg = [F.sum(ln).alias("total_length_m"), F.count(F.lit(1)).alias("segments")]
    for x in tiers:
        agg += [count_where(F.col("_t") == x).alias(f"n_{x}"), F.sum(F.when(F.col("_t") == x, ln).otherwise(0.0)).alias(f"len_{x}")]
    tot = roads.withColumn("_t", t).groupBy(*keys).agg(*agg)
    deg = graph_degree(roads, keys)
    d = deg.groupBy(*keys).agg(F.count(F.lit(1)).alias("nodes"), (F.sum("degree") / 2).cast("long").alias("edges"), count_where(F.col("degree") >= 3).alias("intersections"),
                               count_where(F.col("degree") == 1).alias("dead_ends"))
    circ = graph_degree(roads.filter(cl.is_circulation() & (F.col("u") != F.col("v"))), keys)
    b = circ.groupBy(*keys).agg(F.greatest(F.lit(1), (F.sum("degree") / 2).cast("long") - F.count(F.lit(1)) + 1).alias("blocks"))
    j = tot.join(d, keys).join(b, keys, "left")
    if area is not None:
        j = j.join(area, keys, "left").withColumns({
            "density_m_per_km2": F.coalesce(F.try_divide("total_length_m", "km2"), F.lit(0.0)), "avg_block_km2": F.bround(F.try_divide("km2", "blocks"), 4)}).drop("km2")
    return j


def canonical_edges(roads: DataFrame, group_cols=PARK) -> DataFrame:
    """Undirected edges, each pair once."""
    return roads.filter(F.col("u").isNotNull() & F.col("v").isNotNull()).select(
        *group_cols, F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()


def graph_degree(roads: DataFrame, group_cols=PARK) -> DataFrame:
    e = canonical_edges(roads, group_cols)
    return e.select(*group_cols, F.explode(F.array("a", "b")).alias("node")).groupBy(*group_cols, "node").agg(F.count(F.lit(1)).alias("degree"))


def road_hierarchy(roads: DataFrame, group_cols=PARK) -> DataFrame:
    """Tier rows with segment count, length and share of the total length."""
    keys = list(group_cols)
    g = roads.groupBy(*keys, cl.road_tier().alias("tier")).agg(F.count(F.lit(1)).alias("segments"), F.sum(F.coalesce("length", F.lit(0.0))).alias("_l"))
    tot = roads.groupBy(*keys).agg(F.sum(F.coalesce("length", F.lit(0.0))).alias("_t"))
    labels = F.create_map(*[F.lit(x) for kv in fm.TIER_LABELS.items() for x in kv])
    return g.join(tot, keys).select(*keys, "tier", F.element_at(labels, F.col("tier")).alias("label"), "segments", (js_round(F.col("_l") / 100.0) / 10.0).alias("length_km"),
                                    (js_round(F.try_divide("_l", "_t") * 1000.0) / 10.0).alias("pct_of_total"))


def population_kpis(cells: DataFrame, group_cols=PARK) -> DataFrame:
    keys = list(group_cols)
    d = z("pop_density_km2")
    g = cells.groupBy(*keys).agg(
        F.sum(z("population")).alias("_p"), F.sum(z("hex_area_km2")).alias("_a"), F.avg(d).alias("_d"), F.count(F.lit(1)).alias("cell_count"),
        F.max_by(F.struct("h3_id", d.alias("d")), F.struct(d, -F.col("seq"))).alias("_mx"), F.min_by(F.struct("h3_id", d.alias("d")), F.struct(d, "seq")).alias("_mn"))
    rings = cl.radius_catchments(cells, keys)
    v = rings.groupBy(*keys).agg(F.max(F.when(F.col("radius_m") == 500, F.col("visitors"))).alias("daily_users"), F.max(F.when(F.col("radius_m") == 1000, F.col("visitors"))).alias("weekly_users"))
    return g.join(v, keys).select(*keys, js_round("_p").alias("total_population"), js_round(F.try_divide("_p", "_a")).alias("aggregate_density"), js_round("_d").alias("avg_density"),
                                  F.col("_mx.h3_id").alias("max_cell"), js_round("_mx.d").alias("max_density"), F.col("_mn.h3_id").alias("min_cell"), js_round("_mn.d").alias("min_density"),
                                  "cell_count", "daily_users", "weekly_users")


def metric_rows(wide: DataFrame, keys, rows) -> DataFrame:
    """rows: (key, value, status, priority) Columns -> long table; null values stay as rows."""
    s = F.array(*[F.struct(F.lit(k).alias("key"), (F.lit(None) if v is None else v).cast("double").alias("value"), st.alias("status"), pr.alias("priority")) for k, v, st, pr in rows])
    return wide.select(*keys, F.inline(s))


def _status(score, inverse=False):
    s = (F.lit(100.0) - score) if inverse else score
    st = F.when(s >= 70, "critical").when(s >= 40, "watch").otherwise("good")
    return st, F.when(st == "critical", "High").when(st == "watch", "Medium").otherwise("Low")


NA = (F.lit, F.lit)


def demand_assessment(cells: DataFrame, roads_summary: DataFrame, group_cols=PARK) -> DataFrame:
    """12 demand metrics per area with status and priority; unavailable ones are null rows."""
    keys = list(group_cols)
    w = cell_sums(cells, keys).join(pedestrian_quality(cells, roads_summary, keys).select(*keys, "walkability_score"), keys)
    green_pc = F.coalesce(F.try_divide("green_m2", "pop"), F.lit(0.0))
    deficit = F.greatest(F.lit(0.0), (F.lit(float(fm.GREEN_M2_PER_CAPITA)) - green_pc) / F.lit(float(fm.GREEN_M2_PER_CAPITA)) * 100.0)
    w = w.withColumns({"_deficit": deficit, "_gpc": green_pc, "_idx": js_round("demand"), "_ha": F.coalesce(F.try_divide(F.col("pop"), F.col("km2") * 100.0), F.lit(0.0)),
                       "_ppp": F.try_divide("pop", "playgrounds"), "_press": js_round(norm(F.coalesce(F.try_divide("pop", "km2"), F.lit(0.0)), 20000))})
    na = (None, F.lit("unavailable"), F.lit("Low"))
    has_play = F.col("playgrounds") > 0
    ps, pp = _status(norm(F.col("_ppp"), 20000))
    rows = [("parkDemandIndex", F.col("_idx"), *_status(F.col("_idx"))), ("residentsPerHectare", js_round("_ha", 1), *_status(norm(F.col("_ha"), 300))),
            ("residentsPerH3", js_round(F.col("pop") / F.col("cells")), F.lit("good"), F.lit("Low")), ("popPerEntrance", *na),
            ("popPerPlayground", F.when(has_play, js_round("_ppp")), F.when(has_play, ps).otherwise("unavailable"), F.when(has_play, pp).otherwise("Low")),
            ("popPerSeating", *na), ("popPerTree", *na),
            ("popPerGreenM2", js_round(F.lit(1.0) / F.when(F.col("_gpc") == 0, F.lit(1.0)).otherwise(F.col("_gpc")), 2), *_status(F.col("_deficit"))),
            ("accessibilityScore", F.col("walkability_score"), *_status(F.col("walkability_score"), True)), ("pressureScore", F.col("_press"), *_status(F.col("_press"))),
            ("greenSpaceDeficit", js_round("_deficit"), *_status(F.col("_deficit"))), ("vulnerabilityIndex", *na)]
    return metric_rows(w, keys, rows)


def population_summary(cells: DataFrame, persona: DataFrame | None = None, group_cols=PARK) -> DataFrame:
    """Headline row; ``persona``: group columns and the leading persona id."""
    keys = list(group_cols)
    s = cell_sums(cells, keys).select(*keys, "pop", "km2", js_round("demand").alias("demand_index"))
    zone = cl.top_share_zone(cells, "demand_score", 0.05, keys, extra=[F.avg(z("building_coverage_pct")).alias("_cov")])
    zone = zone.select(*keys, F.concat("compass", F.when(F.col("_cov") > 30, F.lit(" Residential Corridor")).otherwise(F.lit(" Mixed-Use Area"))).alias("highest_demand_zone"))
    j = s.join(zone, keys, "left")
    if persona is not None:
        m = F.create_map(*[F.lit(x) for kv in lx.PERSONA_POPULATION_LABEL.items() for x in kv])
        j = j.join(persona, keys, "left").withColumn("primary_community", F.coalesce(F.element_at(m, F.col("persona")), F.lit("Insufficient review data"))).drop("persona")
    return j.select(*keys, js_round("pop").alias("population_served"), js_round(F.try_divide("pop", "km2")).alias("avg_density"), "highest_demand_zone", "demand_index",
                    band(F.col("demand_index"), [(75, "VERY HIGH"), (50, "HIGH"), (25, "MEDIUM")], "LOW").alias("demand_level"), *(["primary_community"] if persona is not None else []))


def _surface(stats_cols=True):
    return sum([F.coalesce(F.col(f"len_{t}"), F.lit(0.0)) * F.lit(float(w)) for t, w in fm.ROAD_WIDTHS.items()], F.lit(0.0))


def urban_kpis(cells: DataFrame, roads_summary: DataFrame, group_cols=PARK) -> DataFrame:
    keys = list(group_cols)
    lu = cl.land_use_breakdown(cells, keys)
    lup = lu.groupBy(*keys).agg(F.first("diversity_index").alias("land_use_diversity"), F.first("dominant_land_use").alias("dominant_land_use"),
                                *[F.max(F.when(F.col("category") == c, F.col("pct"))).alias(f"{c.lower()}_pct") for c in ("Residential", "Commercial", "Institutional")])
    j = cell_sums(cells, keys).join(roads_summary, keys, "left").join(lup, keys)
    avg_size = F.coalesce(F.try_divide("bldg_m2", "bldg"), F.lit(0.0))
    dens = F.coalesce(F.try_divide("bldg", "km2"), F.lit(0.0))
    street = F.coalesce(F.col("density_m_per_km2"), F.lit(0.0))
    imp = F.coalesce(F.least(F.lit(100.0), F.try_divide(F.col("bldg_m2") + _surface(), F.col("km2") * 1000000.0) * 100.0), F.lit(0.0))
    return j.select(
        *keys, F.col("bldg").alias("building_count"), js_round("bldg_m2").alias("footprint_m2"), js_round(avg_size).alias("avg_building_m2"), js_round("cov", 1).alias("building_coverage_pct"),
        js_round(F.coalesce("total_length_m", F.lit(0.0)) / 1000.0, 1).alias("road_length_km"), F.coalesce("intersections", F.lit(0)).cast("double").alias("intersections"),
        js_round(F.coalesce(F.try_divide("intersections", "km2"), F.lit(0.0)), 1).alias("intersections_per_km2"), js_round(street).alias("street_density"), "land_use_diversity", "dominant_land_use",
        "residential_pct", "commercial_pct", "institutional_pct", js_round(imp, 1).alias("impervious_pct"), js_round("green", 1).alias("open_space_pct"),
        js_round(norm(dens, 3000) * 0.5 + norm(street, 40000) * 0.5).alias("development_intensity"), js_round(norm(dens, 3000) * 0.6 + (F.lit(100.0) - norm(avg_size, 500)) * 0.4).alias("compactness"),
        js_round(F.coalesce(F.try_divide("intersections", "nodes"), F.lit(0.0)) * 100.0).alias("connectivity"))


def urban_summary(kpis: DataFrame, group_cols=PARK) -> DataFrame:
    lab3 = lambda c, hi, lo: F.when(c >= hi, "High").when(c >= lo, "Medium").otherwise("Low")
    cov = F.col("building_coverage_pct")
    word = F.when(cov > 35, "High Density ").when(cov > 18, "Medium Density ").otherwise("Low Density ")
    return kpis.select(*group_cols, F.concat(word, "dominant_land_use").alias("urban_character"), lab3(F.col("connectivity"), 60, 35).alias("road_connectivity"),
                       lab3(F.col("development_intensity"), 65, 35).alias("development_pressure"),
                       js_round(F.col("development_intensity") * 0.35 + F.col("connectivity") * 0.35 + norm(F.col("land_use_diversity"), 100) * 0.3).alias("urban_score"))


def urban_morphology(cells: DataFrame, roads_summary: DataFrame, group_cols=PARK) -> DataFrame:
    """Grain, built/open ratio, void share, permeability and block size with status."""
    keys = list(group_cols)
    w = cell_sums(cells, keys).join(roads_summary, keys, "left")
    grain = F.coalesce(F.try_divide("bldg_m2", "bldg"), F.lit(0.0))
    ratio = F.when(F.col("green") == 0, F.col("cov")).otherwise(F.try_divide("cov", "green"))
    void = F.greatest(F.lit(0.0), F.lit(100.0) - F.col("cov") - F.col("green"))
    perm = js_round(F.try_divide("intersections", "nodes") * 100.0)
    low = F.lit("Low")
    rows = [("blockSize", F.col("avg_block_km2"), F.when(F.col("avg_block_km2") > 0, "good").otherwise("unavailable"), low),
            ("urbanGrain", js_round(grain), F.when(grain < 150, "good").when(grain < 400, "watch").otherwise("critical"), low),
            ("builtOpenRatio", js_round(ratio, 2), F.when(ratio > 3, "critical").when(ratio > 1.5, "watch").otherwise("good"), low),
            ("voidRatio", js_round(void, 1), F.when(void > 60, "watch").otherwise("good"), low),
            ("permeability", perm, F.when(perm.isNull(), "unavailable").when(perm > 50, "good").otherwise("watch"), low)]
    rows += [(k, None, F.lit("unavailable"), low) for k in ("edgeConditions", "streetEnclosure", "streetWallRatio", "urbanContinuity")]
    return metric_rows(w, keys, rows).drop("priority")


# Default component weights of the pedestrian score, adjustable by the caller.
PEDESTRIAN_WEIGHTS = {"connectivity": 28, "intersection_density": 17, "route_directness": 17, "transit_access": 17, "amenity_access": 11, "sidewalk_coverage": 10}


def pedestrian_quality(cells: DataFrame, roads_summary: DataFrame, group_cols=PARK, weights=None) -> DataFrame:
    keys = list(group_cols)
    wt = {**PEDESTRIAN_WEIGHTS, **(weights or {})}
    w = cell_sums(cells, keys).join(roads_summary, keys, "left")
    side = F.coalesce(F.try_divide("len_pedestrianCycling", "total_length_m"), F.lit(0.0)) * 100.0
    comp = {
        "connectivity": js_round(F.coalesce(F.try_divide("intersections", "nodes"), F.lit(0.0)) * 100.0),
        "intersection_density": js_round(norm(F.col("crossings") / F.when(F.col("km2") == 0, 1.0).otherwise(F.col("km2")), 400)),
        "route_directness": js_round(F.coalesce("directness", F.lit(0.0)) * 100.0), "transit_access": js_round("transit"),
        "amenity_access": js_round(norm(F.col("amenity"), 20)), "sidewalk_coverage": js_round(norm(side, 40)),
    }
    w = w.withColumns(comp)
    total = F.lit(float(sum(wt.values()) or 1))
    score = sum([F.col(k) * F.lit(float(v)) for k, v in wt.items()], F.lit(0.0)) / total
    block = F.col("avg_block_km2") * 1000000.0
    return w.select(*keys, cl.clamp100(score).alias("walkability_score"), *comp, js_round(F.sqrt(block)).alias("avg_block_length_m"), js_round(block).alias("avg_block_m2"),
                    js_round(F.coalesce(F.try_divide("dead_ends", "nodes"), F.lit(0.0)) * 100.0, 1).alias("dead_end_pct"), js_round("directness", 3).alias("directness_avg"), js_round(side, 1).alias("sidewalk_pct"))


def near_counts(points: DataFrame, specs, group_cols=PARK) -> DataFrame:
    """Points of a layer within a radius of the area's centre: specs = {name: (layer, metres)}.

    One distance per point; no pairs are formed.
    """
    p = points.withColumn("_d", haversine_m("center_lng", "center_lat", "lng", "lat"))
    return p.groupBy(*group_cols).agg(*[count_where((F.col("layer") == layer) & (F.col("_d") <= r)).alias(name) for name, (layer, r) in specs.items()])


def transit_accessibility(cells: DataFrame, points: DataFrame, group_cols=PARK) -> DataFrame:
    keys = list(group_cols)
    p = points.groupBy(*keys).agg(count_where(F.col("layer") == "bus_stops").alias("_b"))
    j = cell_sums(cells, keys).join(p, keys, "left").join(near_counts(points, {"cafes_500m": ("cafes", 500)}, keys), keys, "left")
    score = js_round("transit")
    return j.select(*keys, js_round(F.coalesce("_b", F.lit(0)) / F.col("km2"), 1).alias("stops_per_km2"), js_round("pop400").alias("pop_within_400m"),
                    js_round(F.coalesce(F.try_divide("pop400", "pop"), F.lit(0.0)) * 100.0, 1).alias("pop_within_400m_pct"), js_round("bus_m").alias("avg_stop_distance_m"),
                    score.alias("transit_score"), F.when(score >= 60, "High").when(score >= 30, "Moderate").otherwise("Low").alias("transit_label"), F.coalesce("cafes_500m", F.lit(0)).alias("cafes_500m"))


def barrier_analysis(cells: DataFrame, roads_summary: DataFrame, group_cols=PARK) -> DataFrame:
    """Barrier rows (real counts, gaps kept as 0) with the area's exposure score."""
    keys = list(group_cols)
    j = cell_sums(cells, keys).join(roads_summary, keys, "left")
    score = js_round(norm(F.col("barrier"), 4))
    real = [("Primary Road Segments", "n_primary", "High"), ("Secondary Road Segments", "n_secondary", "Medium"), ("Dead-End Streets", "dead_ends", "Medium")]
    gaps = ["Pedestrian Crossings", "Fenced Parcels", "Canals / Waterways", "Construction Zones", "Steep Slopes"]  # fixed values: types without a source layer
    rows = [F.struct(F.lit(t).alias("type"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("n"), F.lit(s).alias("severity")) for t, c, s in real]
    rows += [F.struct(F.lit(t).alias("type"), F.lit(0).cast("long").alias("n"), F.lit("Low").alias("severity")) for t in gaps]
    return j.select(*keys, score.alias("exposure_score"), F.when(score >= 60, "High").when(score >= 30, "Moderate").otherwise("Low").alias("exposure_label"), F.inline(F.array(*rows)))


def accessibility_kpis(cells: DataFrame, points: DataFrame, roads_summary: DataFrame, group_cols=PARK) -> DataFrame:
    keys = list(group_cols)
    bands = cl.walking_catchments(cells, keys)
    pv = bands.groupBy(*keys).agg(*[F.max(F.when(F.col("minutes") == m, F.col("population"))).alias(f"pop_{m}min") for m in (5, 10, 15)],
                                  F.max(F.when(F.col("minutes") == 15, F.col("pct_of_total"))).alias("_p15"), F.max(F.when(F.col("minutes") == 15, F.col("avg_route_distance_m"))).alias("_d15"))
    med = percentiles(cells, "network_distance_to_park_m", [50], keys).select(*keys, js_round("value").alias("median_distance_m"))
    near = near_counts(points, {"bus_500m": ("bus_stops", 500), "bus_300m": ("bus_stops", 300), "schools_1km": ("schools", 1000)}, keys)
    ped = pedestrian_quality(cells, roads_summary, keys).select(*keys, "walkability_score")
    j = cell_sums(cells, keys).join(pv, keys).join(med, keys, "left").join(near, keys, "left").join(ped, keys).join(roads_summary.select(*keys, "n_primary", "n_secondary", "dead_ends"), keys, "left")
    zn = lambda c: F.coalesce(c, F.lit(0))
    overall = js_round(F.col("walkability_score") * 0.45 + js_round("transit") * 0.25 + norm(F.col("_p15"), 100) * 0.3)
    local = F.coalesce("_d15", js_round("nd"))
    entrance = js_round(norm(zn("bus_300m"), 5) * 0.4 + F.coalesce(norm(F.lit(2000.0) - F.least(F.lit(2000.0), local), 2000), F.lit(0.0)) * 0.6)
    return j.select(*keys, "pop_5min", "pop_10min", "pop_15min", F.greatest(F.lit(0.0), js_round(F.col("pop") - F.col("pop_15min"))).alias("pop_outside_15min"), js_round("nd").alias("avg_distance_m"),
                    "median_distance_m", js_round("nmax").alias("max_distance_m"), js_round(F.try_divide("wd", "wp")).alias("weighted_distance_m"), zn("bus_500m").alias("bus_500m"),
                    (zn("n_primary") + zn("n_secondary")).cast("long").alias("road_barriers"), zn("dead_ends").cast("long").alias("dead_ends"), overall.alias("accessibility_score"),
                    band(overall, [(85, "Excellent"), (70, "Very Good"), (50, "Good"), (30, "Fair")], "Poor").alias("status"), zn("bus_300m").alias("bus_300m"), zn("schools_1km").alias("schools_1km"), entrance.alias("entrance_score"))


def land_cover(cells: DataFrame, group_cols=PARK) -> DataFrame:
    """Four shares; the last is the residual."""
    keys = list(group_cols)
    w = cell_sums(cells, keys)
    m2 = F.when(F.col("m2") == 0, 1.0).otherwise(F.col("m2"))
    w = w.withColumn("_b", F.least(F.lit(100.0), F.col("bldg_m2") / m2 * 100.0))
    w = w.withColumn("_r", F.least(F.lit(100.0) - F.col("_b"), F.col("road_m2") / m2 * 100.0))
    void = F.greatest(F.lit(0.0), F.lit(100.0) - F.col("_b") - F.col("_r") - F.col("green"))
    names = [("Buildings", F.col("_b")), ("Estimated Paved / Road", F.col("_r")), ("Green Cover", F.col("green")), ("Void / Unclassified (bare ground, parking, other)", void)]
    return w.select(*keys, F.inline(F.array(*[F.struct(F.lit(n).alias("category"), js_round(v, 1).alias("pct")) for n, v in names])))


def _na(keys):
    return [(k, None, F.lit("unavailable"), F.lit("Low")) for k in keys]


def environmental_kpis(cells: DataFrame, roads_summary: DataFrame, health: DataFrame, water: DataFrame, group_cols=PARK) -> DataFrame:
    """Environmental metric rows.  ``health``: group columns, thermalComfort, biodiversity scores;
    ``water``: group columns and the priority index of water features (may lack rows)."""
    keys = list(group_cols)
    w = cell_sums(cells, keys).join(urban_kpis(cells, roads_summary, keys).select(*keys, F.col("impervious_pct").alias("_imp")), keys)
    w = w.join(health, keys, "left").join(water, keys, "left")
    w = w.withColumns({"_th": F.coalesce("thermalComfort", F.lit(60.0)), "_bio": F.coalesce("biodiversity", F.lit(60.0)), "_hot": F.col("hot") * 100.0})
    overall = js_round(norm(F.col("green"), 40) * 0.25 + (F.lit(100.0) - F.col("_hot")) * 0.2 + F.col("_th") * 0.25 + F.col("_bio") * 0.15 + norm(F.lit(100.0) - F.col("_imp"), 100) * 0.15)
    w = w.withColumns({"_all": overall, "_cool": js_round("cooling")})
    g, low, good = F.col("green"), F.lit("Low"), F.lit("good")
    tri = lambda c: F.when(c >= 65, "good").when(c >= 45, "watch").otherwise("critical")
    wat = F.col("water_priority")
    rows = [("greenCoveragePct", js_round(g, 1), F.when(g >= 25, "good").when(g >= 10, "watch").otherwise("critical"), F.when(g >= 25, "Low").otherwise("High")),
            ("imperviousSurfacePct", F.col("_imp"), F.when(F.col("_imp") > 40, "critical").when(F.col("_imp") > 20, "watch").otherwise("good"), F.when(F.col("_imp") > 40, "High").otherwise("Medium")),
            ("permeableSurfacePct", js_round(F.lit(100.0) - F.col("_imp"), 1), good, low),
            ("hotspotAreaPct", js_round("_hot", 1), F.when(F.col("_hot") > 30, "critical").when(F.col("_hot") > 15, "watch").otherwise("good"), F.when(F.col("_hot") > 30, "High").otherwise("Medium")),
            ("coolZoneAreaPct", js_round(F.col("cool") * 100.0, 1), good, low), ("waterBodyAreaM2", F.lit(0.0), F.lit("watch"), low), ("irrigatedAreaProxyM2", js_round("green_m2"), good, low),
            ("biodiversityScore", F.col("_bio"), tri(F.col("_bio")), F.when(F.col("_bio") >= 65, "Low").otherwise("Medium")), ("thermalComfortScore", F.col("_th"), tri(F.col("_th")), F.when(F.col("_th") >= 65, "Low").otherwise("High")),
            ("waterFeatureSatisfaction", wat, F.when(wat.isNull(), "unavailable").when(wat >= 50, "critical").otherwise("good"), F.when(wat >= 50, "Medium").otherwise("Low")),
            ("coolingOpportunityScore", F.col("_cool"), F.when(F.col("_cool") >= 60, "watch").otherwise("good"), F.when(F.col("_cool") >= 60, "High").otherwise("Medium")),
            ("overallEnvironmentalScore", F.col("_all"), tri(F.col("_all")), F.when(F.col("_all") >= 65, "Low").otherwise("High"))]
    # Metrics that need a source the data model does not have; kept as null rows.
    rows += _na(["avgLST", "maxLST", "minLST", "uhiIntensity", "treeCanopyPct", "avgDaytimeShadePct", "avgAfternoonShadePct", "shadedPathCoveragePct", "ndviMean", "ndviMax",
                 "vegetationHealthScore", "irrigationDemand", "evapotranspirationPotential", "habitatConnectivityScore"])
    return metric_rows(w, keys, rows)


def environmental_summary(cells: DataFrame, kpis: DataFrame, group_cols=PARK) -> DataFrame:
    keys = list(group_cols)
    zone = cl.top_share_zone(cells, "heat_score", 0.05, keys).select(*keys, F.concat("compass", F.lit(" High-Hardscape Edge")).alias("peak_heat_zone"))
    badge = lambda c: band(c, [(85, "EXCELLENT"), (65, "GOOD"), (45, "MODERATE"), (25, "POOR")], "CRITICAL")
    p = kpis.groupBy(*keys).pivot("key", ["greenCoveragePct", "thermalComfortScore", "biodiversityScore", "overallEnvironmentalScore"]).agg(F.first("value"))
    return p.join(zone, keys, "left").select(*keys, "peak_heat_zone", F.col("greenCoveragePct").alias("green_pct"), badge(F.col("thermalComfortScore")).alias("thermal_status"),
                                             badge(F.col("biodiversityScore")).alias("ecology_status"), F.col("overallEnvironmentalScore").alias("score"), badge(F.col("overallEnvironmentalScore")).alias("status"))


# Facility layers in display order; a layer without rows counts as not loaded.
FACILITY_LAYERS = [("schools", "Schools"), ("mosques", "Mosques"), ("clinics", "Clinics"), ("hospitals", "Hospitals"), ("playgrounds", "Playgrounds"), ("sports", "Sports Facilities"),
                   ("restaurants", "Restaurants"), ("cafes", "Cafés"), ("shops", "Retail (All Shops)"), ("toilets", "Public Toilets"), ("drinkingWater", "Drinking Water Points"), ("parks", "Existing Parks")]


def facility_stats(cells: DataFrame, points: DataFrame, group_cols=PARK) -> DataFrame:
    """Per layer: count, density, mean distance to the centre, walk time, people per facility."""
    keys = list(group_cols)
    area = cells.groupBy(*keys).agg(F.sum(z("hex_area_km2")).alias("_a"), F.sum(z("population")).alias("_p"))
    p = points.withColumn("_d", haversine_m("center_lng", "center_lat", "lng", "lat")).groupBy(*keys, F.col("layer").alias("key")).agg(F.count(F.lit(1)).alias("_n"), js_round(F.avg("_d")).alias("_m"))
    spine = area.select(*keys, "_a", "_p", F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("label")) for k, v in FACILITY_LAYERS])))
    j = spine.join(p, [*keys, "key"], "left")
    return j.select(*keys, "key", "label", F.col("_n").isNotNull().alias("loaded"), F.col("_n").cast("double").alias("n"), js_round(F.try_divide("_n", "_a"), 2).alias("density_per_km2"), F.col("_m").alias("avg_distance_m"),
                    js_round(F.col("_m") / fm.WALK_SPEED, 1).alias("avg_walk_minutes"), js_round(F.try_divide("_p", "_n")).alias("pop_per_facility"))


def community_catchments(cells: DataFrame, points: DataFrame, group_cols=PARK) -> DataFrame:
    """Rings with their facility counts per layer."""
    keys = list(group_cols)
    rings = fixed_table(cells.sparkSession, [(float(r),) for r, _, _ in fm.RINGS], "radius_m double")
    layers = ["schools", "mosques", "clinics", "hospitals", "sports", "playgrounds", "shops", "bus_stops", "parks"]
    p = points.withColumn("_d", haversine_m("center_lng", "center_lat", "lng", "lat")).join(rings, F.col("_d") <= F.col("radius_m"))
    c = p.groupBy(*keys, "radius_m").pivot("layer", layers).agg(F.count(F.lit(1)))
    return cl.radius_catchments(cells, keys).select(*keys, "radius_m", "population", "area_km2", "density_per_km2").join(c, [*keys, "radius_m"], "left").fillna(0, layers)


def community_kpis(cells: DataFrame, points: DataFrame, group_cols=PARK) -> DataFrame:
    """33 community metric rows; those without a source stay null."""
    keys = list(group_cols)
    fs = facility_stats(cells, points, keys)
    names = ["schools", "mosques", "clinics", "hospitals", "playgrounds", "sports", "shops"]
    n = fs.groupBy(*keys).agg(*[F.max(F.when(F.col("key") == k, F.col("n"))).alias(f"_n_{k}") for k in names], *[F.max(F.when(F.col("key") == k, F.col("pop_per_facility"))).alias(f"_p_{k}") for k in names])
    w = cell_sums(cells, keys).join(n, keys)
    w = w.withColumns({f"_{k}": js_round(k) for k in ("fac", "div", "fam", "you", "old")})
    w = w.withColumn("_def", F.lit(100.0) - F.col("_fac"))
    w = w.withColumn("_all", js_round(F.col("_fac") * 0.3 + F.col("_div") * 0.25 + F.col("_fam") * 0.25 + (F.lit(100.0) - F.col("_def")) * 0.2))
    good, low = F.lit("good"), F.lit("Low")
    two = lambda c, a, b: F.when(c >= 60, a).otherwise(b)
    rows = [("totalPopulation", js_round("pop"), good, low), ("popDensity", js_round(F.coalesce(F.try_divide("pop", "km2"), F.lit(0.0))), good, low)]
    counts = {"schoolsCount": "schools", "mosquesCount": "mosques", "clinicsCount": "clinics", "hospitalsCount": "hospitals", "playgroundsCount": "playgrounds", "sportsCount": "sports", "retailCount": "shops"}
    rows += [(k, F.col(f"_n_{v}"), F.when(F.col(f"_n_{v}").isNull(), "unavailable").otherwise("good"), low) for k, v in counts.items()]
    pp = F.coalesce(F.col("_p_playgrounds"), F.lit(0.0)) > 8000
    rows += [("popPerSchool", F.col("_p_schools"), good, low), ("popPerPlayground", F.col("_p_playgrounds"), F.when(pp, "critical").otherwise("good"), F.when(pp, "High").otherwise("Low")),
             ("popPerSports", F.col("_p_sports"), good, low), ("popPerClinic", F.col("_p_clinics"), good, low)]
    c3 = lambda c: F.when(c >= 60, "good").when(c >= 35, "watch").otherwise("critical")
    rows += [("facilityAccessScore", F.col("_fac"), c3(F.col("_fac")), two(F.col("_fac"), "Low", "High")), ("communityDiversityScore", F.col("_div"), two(F.col("_div"), "good", "watch"), two(F.col("_div"), "Low", "Medium")),
             ("familyDemandScore", F.col("_fam"), two(F.col("_fam"), "watch", "good"), two(F.col("_fam"), "High", "Medium")), ("youthDemandScore", F.col("_you"), two(F.col("_you"), "watch", "good"), two(F.col("_you"), "High", "Medium")),
             ("olderAdultSupportScore", F.col("_old"), two(F.col("_old"), "good", "watch"), two(F.col("_old"), "Low", "Medium")),
             ("socialInfrastructureDeficitScore", F.col("_def"), F.when(F.col("_def") >= 60, "critical").when(F.col("_def") >= 35, "watch").otherwise("good"), two(F.col("_def"), "High", "Medium")),
             ("overallCommunityScore", F.col("_all"), c3(F.col("_all")), two(F.col("_all"), "Low", "High"))]
    # Metrics without a source in the data model.
    rows += _na(["households", "avgHouseholdSize", "childrenPop", "youthPop", "workingAgePop", "olderAdultPop", "familyHouseholdShare", "nurseriesCount", "universitiesCount", "communityCentersCount",
                 "librariesCount", "culturalFacilitiesCount", "popPerCommunityFacility"])
    return metric_rows(w, keys, rows)


COMMUNITY_BADGE = [(80, "VERY HIGH"), (60, "HIGH"), (35, "MODERATE"), (15, "LOW")]


def community_summary(kpis: DataFrame, group_cols=PARK) -> DataFrame:
    cols = ["totalPopulation", "schoolsCount", "mosquesCount", "clinicsCount", "hospitalsCount", "facilityAccessScore", "familyDemandScore", "overallCommunityScore"]
    p = kpis.groupBy(*group_cols).pivot("key", cols).agg(F.first("value"))
    b = lambda c: band(F.col(c), COMMUNITY_BADGE, "CRITICAL")
    return p.select(*group_cols, F.col("totalPopulation").alias("population_served"), F.col("schoolsCount").alias("schools"), F.col("mosquesCount").alias("mosques"),
                    (F.col("clinicsCount") + F.col("hospitalsCount")).alias("healthcare"), b("facilityAccessScore").alias("access_status"), b("familyDemandScore").alias("family_status"),
                    F.col("overallCommunityScore").alias("score"), b("overallCommunityScore").alias("status"))


def underserved_zones(cells: DataFrame, group_cols=PARK) -> DataFrame:
    """The 5 % of cells with the highest vulnerability times population: direction, people, gaps."""
    c = cells.withColumn("_vp", F.col("community_vulnerability_score") * z("population"))
    zero = lambda x: F.every(z(x) == 0)
    g = cl.top_share_zone(c, "_vp", 0.05, group_cols, extra=[
        F.sum(z("population")).alias("_p"), F.avg("community_vulnerability_score").alias("_v"), F.avg("walking_time_to_park_minutes").alias("_w"), zero("playground_count").alias("_m0"),
        zero("sports_count").alias("_m1"), zero("clinic_count").alias("_m2"), F.every(z("green_coverage_pct") < 5).alias("_m3")])
    missing = F.array_compact(F.array(*[F.when(F.col(f"_m{i}"), F.lit(n)) for i, n in enumerate(["Playgrounds", "Sports Facilities", "Clinics", "Green Space"])]))
    return g.select(*group_cols, F.concat("compass", F.lit(" Residential Edge")).alias("zone"), js_round("_p").alias("population"), js_round("_v").alias("avg_vulnerability"),
                    missing.alias("facilities_missing"), js_round("_w", 1).alias("avg_walk_minutes"))


def cross_context(cells: DataFrame, group_cols=PARK) -> DataFrame:
    """Four means used to back review complaints with site evidence."""
    g = cells.groupBy(*group_cols).agg(F.avg("heat_score").alias("h"), F.avg(z("green_coverage_pct")).alias("g"), F.avg("walking_time_to_park_minutes").alias("w"), F.avg(norm(z("amenity_total"), 20)).alias("f"))
    return g.select(*group_cols, js_round("h").alias("avg_heat"), js_round("g", 1).alias("avg_green"), js_round("w", 1).alias("avg_walk"), js_round("f").alias("avg_access"))


# Age groups (key, personas, facility layers, health sub-scores).
AGE_GROUPS = [
    ("youngChildren", ["children", "parents"], ["playgrounds", "schools"], ["playQuality", "familyFriendliness"]), ("olderChildren", ["children"], ["sports", "schools"], ["playQuality"]),
    ("teenagers", ["teenagers"], ["sports", "schools"], ["playQuality", "communityActivity"]), ("youngAdults", ["joggers", "cyclists", "weekendSocial"], ["sports"], ["walkability", "communityActivity"]),
    ("families", ["parents", "caregivers"], ["schools", "mosques", "playgrounds"], ["familyFriendliness"]), ("workingAdults", ["joggers", "residents"], ["cafes", "shops"], ["walkability"]),
    ("olderAdults", ["seniors"], ["mosques", "clinics"], ["safety", "accessibility"]), ("peopleOfDetermination", ["peopleOfDetermination"], ["clinics"], ["accessibility"]),
    ("caregivers", ["caregivers", "parents"], ["playgrounds", "clinics"], ["familyFriendliness", "safety"]),
]


def review_evidence(personas: DataFrame, health: DataFrame, totals: DataFrame, group_cols) -> DataFrame:
    """One row per group: total reviews, persona -> reviews and sub-score -> score maps.

    Both maps have a fixed number of keys (12 personas, 11 sub-scores).
    """
    keys = list(group_cols)
    p = personas.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("persona", "review_count"))).alias("persona_reviews"))
    h = health.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("key", "score"))).alias("health"))
    return totals.join(p, keys, "left").join(h, keys, "left")


def _map_sum(m, names):
    return sum([F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0)) for k in names], F.lit(0))


def _map_avg(m, names, default):
    vals = F.array_compact(F.array(*[F.try_element_at(m, F.lit(k)) for k in names])) if names else None
    if vals is None:
        return F.lit(default)
    return F.when(F.size(vals) > 0, F.aggregate(vals, F.lit(0.0), lambda a, x: a + x) / F.size(vals)).otherwise(F.lit(default))


def age_group_demand(evidence: DataFrame, facilities: DataFrame, group_cols) -> DataFrame:
    """Demand proxy per age group.  ``facilities``: group columns and a map layer -> count."""
    keys = list(group_cols)
    j = evidence.join(facilities, keys, "left")
    total = F.when(F.col("n") == 0, 1).otherwise(F.col("n"))
    rows = []
    for key, pers, fac, hs in AGE_GROUPS:
        persona = _map_sum(F.col("persona_reviews"), pers)
        counts = F.array_compact(F.array(*[F.try_element_at("facilities", F.lit(k)) for k in fac]))
        fscore = F.when(F.size(counts) > 0, norm(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x), 100)).otherwise(F.lit(50.0))
        score = js_round(norm(persona / total * 100.0, 40) * 0.45 + _map_avg(F.col("health"), hs, 50.0) * 0.3 + fscore * 0.25)
        rows.append(F.struct(F.lit(key).alias("age_group"), persona.cast("long").alias("persona_reviews_n"), score.alias("demand_score"),
                             band(score, [(75, "Very High"), (50, "High"), (25, "Moderate")], "Low").alias("demand_level")))
    return j.select(*keys, F.inline(F.array(*rows)))


def program_demand(evidence: DataFrame, group_cols) -> DataFrame:
    """Demand proxy for the 22 planning programs."""
    from ..functions.programs import PLANNING_PROGRAMS

    keys = list(group_cols)
    total = F.when(F.col("n") == 0, 1).otherwise(F.col("n"))
    rows = []
    for p in PLANNING_PROGRAMS:
        persona = _map_sum(F.col("persona_reviews"), p["personas"])
        hs = p["health"]
        score = js_round(norm(persona / total * 100.0, 30) * 0.55 + (F.lit(100.0) - _map_avg(F.col("health"), hs, 50.0)) * 0.45)
        rows.append(F.struct(F.lit(p["key"]).alias("program"), score.alias("demand_score"), band(score, lx.PRIORITY_CUTS, "Low").alias("priority"),
                             F.least(F.lit(90.0), F.lit(40.0) + persona * 3.0 + F.lit(10.0 * len(hs))).alias("confidence")))
    return evidence.select(*keys, F.inline(F.array(*rows)))


def threshold_findings(metrics: DataFrame, rules, group_cols=PARK) -> DataFrame:
    """Rules (key, '>=' or '<', threshold, kind, finding) against metric rows; a small fixed table, equi-joined on the metric key."""
    unknown = {r[1] for r in rules} - {">=", "<"}
    if unknown:
        raise ValueError(f"unknown comparison {sorted(unknown)}")
    rt = fixed_table(metrics.sparkSession, [(a, b, float(c), d, e) for a, b, c, d, e in rules], "key string, op string, threshold double, kind string, finding string")
    j = metrics.join(rt, "key")
    return j.filter(F.when(F.col("op") == ">=", F.col("value") >= F.col("threshold")).otherwise(F.col("value") < F.col("threshold"))).select(*group_cols, "key", "value", "kind", "finding")


def gis_summary(population: DataFrame, urban: DataFrame, access: DataFrame, environment: DataFrame, community: DataFrame, group_cols=PARK) -> DataFrame:
    """Headline values of the five reports side by side, one row per area.

    The people within a 15-minute walk and their share of the population are separate columns.
    """
    keys = list(group_cols)
    p = population.select(*keys, "total_population", "aggregate_density", "daily_users")
    u = urban.select(*keys, "building_coverage_pct", "impervious_pct", "development_intensity", "connectivity", "dominant_land_use")
    a = access.select(*keys, "accessibility_score", F.col("pop_15min").alias("pop_15min_walk"), F.col("status").alias("access_status"))
    e = environment.groupBy(*keys).pivot("key", ["greenCoveragePct", "hotspotAreaPct", "overallEnvironmentalScore"]).agg(F.first("value"))
    c = community.groupBy(*keys).pivot("key", ["schoolsCount", "facilityAccessScore", "overallCommunityScore"]).agg(F.first("value"))
    j = p.join(u, keys, "left").join(a, keys, "left").join(e, keys, "left").join(c, keys, "left")
    return j.withColumn("pop_15min_walk_pct", js_round(F.try_divide("pop_15min_walk", "total_population") * 100.0, 1))
