"""Per-cell and per-program export tables on 0-1 scales."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.numeric import js_round
from ..functions.programs import PLANNING_PROGRAMS

PARK = ("park_id",)


def _r3(x: str) -> str:
    return f"CAST(floor(({x}) / 100e0 * 1000e0 + 0.5e0) AS DOUBLE) / 1000e0"


def _rnd(x: str) -> str:
    return f"CAST(floor(({x}) + 0.5e0) AS DOUBLE)"


_G = "least(100e0, coalesce(green_coverage_pct, 0e0) / 30e0 * 100e0)"
_R = "greatest(0e0, least(100e0, coalesce(real_road_density_m_per_km2, 0e0) / 40000e0 * 100e0))"
_COOL = "(100e0 - heat_score)"
_PARK = "coalesce(park_area_m2, 0e0) / coalesce(nullif(hex_area_m2, 0e0), 1e0) * 100e0"

# Environmental fields as SQL over scored cells.
ENVIRONMENT = {
    "heat": _r3("heat_score"), "shade": _r3(_rnd(f"{_COOL} * 0.6e0 + {_G} * 0.4e0")), "canopy": _r3(_G), "cooling": _r3("cooling_score"), "biodiversity": _r3("biodiversity_score"), "water": _r3("water_sensitive_score"),
    "environmental_constraint_score": _r3(_rnd(f"least(100e0, {_PARK} / 50e0 * 100e0)")), "playground_suitability": _r3("greatest(0e0, " + _rnd(f"{_COOL} * 0.4e0 + {_G} * 0.3e0 + (100e0 - {_R}) * 0.3e0") + ")"),
    "plaza_suitability": _r3("greatest(0e0, " + _rnd(f"{_R} * 0.4e0 + {_COOL} * 0.3e0 + void_pct * 0.3e0") + ")"), "quiet_garden_suitability": _r3("greatest(0e0, " + _rnd(f"{_G} * 0.4e0 + (100e0 - {_R}) * 0.35e0 + {_COOL} * 0.25e0") + ")"),
    "fitness_suitability": _r3("greatest(0e0, " + _rnd(f"{_R} * 0.4e0 + {_COOL} * 0.3e0 + void_pct * 0.3e0") + ")"), "jogging_suitability": _r3("greatest(0e0, " + _rnd(f"{_R} * 0.5e0 + {_COOL} * 0.5e0") + ")"), "tree_planting": _r3("tree_planting_score"),
}
_SOC = _rnd("(diversity_score + facility_access_score) / 2e0")
# Community fields as SQL over scored cells.
COMMUNITY = {
    "family_demand": _r3("family_demand_score"), "child_demand": _r3("family_demand_score"), "youth_demand": _r3("youth_demand_score"), "older_adult_demand": _r3("older_demand_score"), "community_activity": _r3("diversity_score"),
    "facility_access": _r3("facility_access_score"), "playground_deficit": _r3("playground_deficit_score"), "sports_deficit": _r3("sports_deficit_score"), "green_space_deficit": _r3("green_space_deficit_score"),
    "community_vulnerability": _r3("community_vulnerability_score"), "community_opportunity": _r3("community_opportunity_score"), "social_interaction_potential": _r3(_SOC), "quiet_space_demand": _r3(f"greatest(0e0, 100e0 - {_SOC})"),
    "event_space_demand": _r3(_rnd("diversity_score * 0.5e0 + family_demand_score * 0.5e0")),
}
# Review fields and the topic each follows; topic of each planning program.
REVIEW_FIELDS = {
    "shade_demand": "shade / heat comfort", "playground_demand": "playground", "seating_demand": "seating", "toilet_demand": "toilets", "water_demand": "water features", "sports_demand": "sports facilities", "quiet_space_demand": "crowding",
    "accessibility_demand": "accessibility", "family_demand": "playground", "youth_demand": "sports facilities", "older_adult_demand": "safety", "maintenance_priority": "maintenance", "safety_priority": "safety",
}
REVIEW_TOPICS = list(dict.fromkeys([*REVIEW_FIELDS.values(), "landscape / greenery"]))
PROGRAM_TOPICS = {
    "inclusivePlayground": "playground", "naturePlay": "landscape / greenery", "waterPlay": "water features", "sportsCourt": "sports facilities", "outdoorFitness": "sports facilities", "joggingLoop": "sports facilities", "walkingCircuit": "accessibility",
    "picnicArea": "seating", "familySeating": "seating", "sensoryGarden": "accessibility", "cafe": "food / cafe", "retailKiosk": "food / cafe", "toilets": "toilets", "drinkingFountains": "water features", "dogArea": "pets",
}


def _base(cells: DataFrame) -> DataFrame:
    x, y = geo.to_utm("lng", "lat")
    return cells.withColumns({"centroid_x": x, "centroid_y": y})


def environment_cells(cells: DataFrame) -> DataFrame:
    """13 environmental scores on 0-1, a null wind score and the protected-park flag."""
    c = _base(cells)
    return c.selectExpr("park_id", "h3_id", "centroid_x", "centroid_y", *[f"{e} AS {k}" for k, e in ENVIRONMENT.items()], "CAST(NULL AS DOUBLE) AS wind_score",
                        "coalesce(park_area_m2, 0e0) / coalesce(nullif(hex_area_m2, 0e0), 1e0) >= 0.3e0 AS `constraint`")


def community_cells(cells: DataFrame) -> DataFrame:
    return _base(cells).selectExpr("park_id", "h3_id", "centroid_x", "centroid_y", *[f"{e} AS {k}" for k, e in COMMUNITY.items()])


def topic_rates(reviews: DataFrame, group_cols=PARK) -> DataFrame:
    """Per area a map topic -> struct(mentions, share, negative, positive); one entry per category."""
    keys = list(group_cols)
    c = reviews.groupBy(*keys, "issue_category").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("sentiment") == "NEGATIVE", 1.0).otherwise(0.0)).alias("neg"), F.avg(F.when(F.col("sentiment") == "POSITIVE", 1.0).otherwise(0.0)).alias("pos"))
    t = c.groupBy(*keys).agg(F.sum("n").alias("_t"))
    c = c.join(t, keys).select(*keys, F.struct("issue_category", F.struct("n", (F.col("n") / F.col("_t")).alias("share"), "neg", "pos")).alias("e"))
    return c.groupBy(*keys).agg(F.map_from_entries(F.collect_list("e")).alias("rates"))


def review_cells(cells: DataFrame, rates: DataFrame, reviews: DataFrame, group_cols=PARK) -> DataFrame:
    """16 review demands per cell: the area's topic rate spread by population share."""
    keys = list(group_cols)
    tot = cells.groupBy(*keys).agg(F.sum(F.coalesce("population", F.lit(0.0))).alias("_p"), F.count(F.lit(1)).alias("_n"))
    one = F.when(F.col("sentiment") == "POSITIVE", 1.0).when(F.col("sentiment") == "NEGATIVE", -1.0).otherwise(0.0)
    sat = reviews.groupBy(*keys).agg(js_round((F.avg(one) + 1.0) / 2.0 * 100.0).alias("_sat"))
    j = cells.select(*keys, "h3_id", "population").join(tot, keys).join(rates, keys).join(sat, keys)
    w = F.least(F.lit(1.0), F.coalesce("population", F.lit(0.0)) / F.when(F.col("_p") == 0, 1.0).otherwise(F.col("_p")) * F.col("_n"))
    j = j.withColumn("_w", w)

    def part(topic, field):
        return F.coalesce(F.try_element_at("rates", F.lit(topic))[field], F.lit(0.0))

    rate = lambda t: F.least(F.lit(1.0), part(t, "share") * 0.5 + part(t, "neg") * 0.5)
    return j.select(*keys, "h3_id", *[js_round(rate(t) * F.col("_w"), 3).alias(k) for k, t in REVIEW_FIELDS.items()], js_round(part("crowding", "share") * F.col("_w"), 3).alias("event_space_demand"),
                    js_round(F.col("_w") * part("landscape / greenery", "pos"), 3).alias("positive_identity_value"), js_round(F.col("_sat") / 100.0 * F.col("_w"), 3).alias("community_satisfaction"))


def review_programs(rates: DataFrame, group_cols=PARK) -> DataFrame:
    """Review-driven demand of the planning programs: score, evidence, priority band, confidence."""
    rows = []
    for p in PLANNING_PROGRAMS:
        t = PROGRAM_TOPICS.get(p["key"])
        r = F.try_element_at("rates", F.lit(t)) if t else None
        n = F.coalesce(r["n"], F.lit(0)).cast("long") if t else F.lit(0).cast("long")
        d = F.when(r.isNull(), F.lit(30.0)).otherwise(F.least(F.lit(100.0), js_round(F.least(F.lit(1.0), r["share"] * 3.0) * 50.0 + r["neg"] * 100.0 * 0.5))) if t else F.lit(30.0)
        rows.append(F.struct(F.lit(p["key"]).alias("program"), d.alias("_d"), n.alias("evidence_count")))
    x = rates.select(*group_cols, F.inline(F.array(*rows)))
    return x.select(*group_cols, "program", (F.col("_d") / 100.0).alias("demand_score"), "evidence_count",
                    F.when(F.col("_d") >= 75, "very_high").when(F.col("_d") >= 50, "high").when(F.col("_d") >= 25, "medium").otherwise("low").alias("priority"),
                    (js_round(F.least(F.lit(95.0), F.lit(35.0) + F.col("evidence_count") * 3.0)) / 100.0).alias("confidence"))


def community_programs(demand: DataFrame, group_cols=PARK) -> DataFrame:
    """Planning programs with their demand (0.5 where none) and areas."""
    rows = F.array(*[F.struct(F.lit(p["key"]).alias("program"), *[F.lit(float(a)).alias(n) for n, a in zip(("min_area", "target_area", "max_area"), p["area"])]) for p in PLANNING_PROGRAMS])
    spine = demand.select(*group_cols).distinct().select(*group_cols, F.inline(rows))
    j = spine.join(demand, [*group_cols, "program"], "left")
    s = F.coalesce("demand_score", F.lit(50.0)) / 100.0
    return j.select(*group_cols, "program", "min_area", "target_area", "max_area", js_round(s, 2).alias("priority"), js_round(s, 3).alias("community_demand_score"))
