"""Cell score formulas as SQL expressions.

Fixed values: weights, reference maxima and thresholds of the scores.  An expression may
use the names defined before it (lateral aliases), so each score is written once.  All
numbers are doubles (``0.5e0``); ``rnd`` rounds ties up.
"""

from __future__ import annotations


def n(x: str, top) -> str:
    """Share of ``top`` on a 0-100 scale, clamped."""
    return f"greatest(0e0, least(100e0, ({x}) / {float(top)}e0 * 100e0))"


def rnd(x: str) -> str:
    return f"CAST(floor(({x}) + 0.5e0) AS DOUBLE)"


def z(x: str) -> str:
    return f"coalesce({x}, 0e0)"


def nonzero(x: str, default: str) -> str:
    return f"coalesce(nullif({x}, 0e0), {default})"


DENS = n(z("pop_density_km2"), 20000)
SCHOOL, PLAYG, SPORT, MOSQ, CLIN = (n(z(f"{f}_count"), 2) for f in ("school", "playground", "sports", "mosque", "clinic"))
AREA = nonzero("hex_area_m2", "1e0")
DIVERSITY = ["school", "mosque", "clinic", "hospital", "playground", "sports", "restaurant", "cafe", "shop"]
_transit = f"CASE WHEN nearest_bus_stop_distance_m IS NULL THEN 0e0 ELSE {n('800e0 - least(800e0, nearest_bus_stop_distance_m)', 800)} END"

# Fixed values.  ``road_width_m`` is a column of the input (average road width of the study area).
CELL_FORMULAS = {
    "demand_score": rnd(f"{DENS} * 0.45e0 + {n('100e0 - ' + z('green_coverage_pct'), 100)} * 0.35e0 + {n(z('building_coverage_pct'), 80)} * 0.2e0"),
    "park_access_score": f"CASE WHEN walking_time_to_park_minutes IS NULL THEN 0e0 ELSE {rnd(n('30e0 - least(30e0, walking_time_to_park_minutes)', 30))} END",
    "walkability_score": rnd(f"{n(z('intersection_count_hex') + ' / ' + nonzero('hex_area_km2', '0.0001e0'), 150)} * 0.3e0 + {n(z('real_road_density_m_per_km2'), 40000)} * 0.25e0"
                             f" + {n(z('amenity_total'), 20)} * 0.2e0 + {_transit} * 0.25e0"),
    "transit_score": rnd(_transit),
    "barrier_score": rnd(n(z("barrier_score_hex"), 6)),
    "access_deficit_score": rnd(f"CASE WHEN walking_time_to_park_minutes IS NULL THEN 100e0 ELSE {n('least(30e0, walking_time_to_park_minutes)', 30)} END * 0.4e0"
                                " + (100e0 - walkability_score) * 0.25e0 + (100e0 - transit_score) * 0.15e0 + barrier_score * 0.2e0"),
    "impervious_pct": f"least(100e0, ({z('building_area_m2')} + {z('real_road_length_m')} * road_width_m) / {AREA} * 100e0)",
    "void_pct": f"greatest(0e0, 100e0 - {z('building_coverage_pct')} - {z('green_coverage_pct')})",
    "green_deficit_pct": f"greatest(0e0, 100e0 - {z('green_coverage_pct')})",
    "heat_score": rnd(f"{n('impervious_pct', 100)} * 0.7e0 + {n('100e0 - ' + z('green_coverage_pct'), 100)} * 0.3e0"),
    "cooling_score": rnd(f"{n('heat_score', 100)} * 0.6e0 + {n('void_pct', 100)} * 0.4e0"),
    "biodiversity_score": rnd(f"{n(z('park_area_m2') + ' / ' + AREA + ' * 100e0', 50)} * 0.6e0 + {n(z('green_coverage_pct'), 30)} * 0.4e0"),
    "env_vulnerability_score": rnd(f"{n('heat_score', 100)} * 0.5e0 + {n('green_deficit_pct', 100)} * 0.3e0 + {n('100e0 - biodiversity_score', 100)} * 0.2e0"),
    "tree_planting_score": None,  # filled by tree_planting(weights)
    "water_sensitive_score": rnd(f"{n('impervious_pct', 100)} * 0.5e0 + {n('void_pct', 100)} * 0.5e0"),
    "family_demand_score": rnd(f"{SCHOOL} * 0.3e0 + {PLAYG} * 0.3e0 + {DENS} * 0.4e0"),
    "youth_demand_score": rnd(f"{SPORT} * 0.55e0 + {SCHOOL} * 0.45e0"),
    "older_demand_score": rnd(f"{MOSQ} * 0.3e0 + {CLIN} * 0.3e0 + {DENS} * 0.4e0"),
    "facility_access_score": rnd(n(z("amenity_total"), 20)),
    "diversity_score": rnd("(" + " + ".join(f"CASE WHEN {z(f + '_count')} > 0 THEN 1e0 ELSE 0e0 END" for f in DIVERSITY) + ") / 9e0 * 100e0"),
    "playground_deficit_score": f"CASE WHEN {z('playground_count')} > 0 THEN {rnd(DENS + ' * 0.3e0')} ELSE {rnd(DENS)} END",
    "sports_deficit_score": f"CASE WHEN {z('sports_count')} > 0 THEN {rnd(DENS + ' * 0.3e0')} ELSE {rnd(DENS)} END",
    "green_space_deficit_score": rnd(n("100e0 - " + z("green_coverage_pct"), 100)),
    "community_vulnerability_score": rnd(f"{DENS} * 0.3e0 + green_space_deficit_score * 0.2e0 + CASE WHEN walking_time_to_park_minutes IS NULL THEN 100e0 ELSE "
                                         f"{n('least(60e0, walking_time_to_park_minutes)', 60)} END * 0.3e0 + {n('20e0 - ' + z('amenity_total'), 20)} * 0.2e0"),
    "community_opportunity_score": rnd(f"{n('community_vulnerability_score', 100)} * 0.6e0 + {n('void_pct', 100)} * 0.4e0"),
    "urban_score": rnd(f"{n('CASE WHEN ' + z('hex_area_km2') + ' = 0 THEN 0e0 ELSE ' + z('building_count') + ' / hex_area_km2 END', 3000)} * 0.5e0 + {n(z('building_coverage_pct'), 80)} * 0.5e0"),
    "simple_demand": f"CAST(floor(({z('pop_density_km2')} / 100e0 * (1e0 - {z('green_coverage_pct')} / 100e0)) * 10e0 + 0.5e0) AS DOUBLE) / 10e0",
}

# Default weights of the tree-planting score, adjustable by the caller.
TREE_WEIGHTS = {"heat": 30, "green": 25, "land": 25, "pedestrian": 15, "biodiversity": 5}


def tree_planting(weights=None) -> str:
    w = {k: f"{float(v)}e0" for k, v in {**TREE_WEIGHTS, **(weights or {})}.items()}
    total = f"{float(sum({**TREE_WEIGHTS, **(weights or {})}.values()) or 1)}e0"
    return rnd(f"({n('heat_score', 100)} * {w['heat']} + {n('green_deficit_pct', 100)} * {w['green']} + {n('void_pct', 100)} * {w['land']}"
               f" + {n(z('real_road_density_m_per_km2'), 40000)} * {w['pedestrian']} + {n('100e0 - biodiversity_score', 100)} * {w['biodiversity']}) / {total}")


def cell_formulas(weights=None) -> dict[str, str]:
    return {k: (tree_planting(weights) if v is None else v) for k, v in CELL_FORMULAS.items()}


# Road widths by tier (metres), tiers by substring of the highway tag (first wins).
ROAD_WIDTHS = {"primary": 15, "secondary": 10, "local": 7, "service": 4, "pedestrianCycling": 2.5, "other": 5}
ROAD_TIERS = [
    ("primary", ["motorway", "motorway_link", "primary", "primary_link", "trunk", "trunk_link"]),
    ("secondary", ["secondary", "secondary_link", "tertiary", "tertiary_link"]),
    ("local", ["residential", "living_street", "unclassified"]),
    ("service", ["service", "track"]),
    ("pedestrianCycling", ["footway", "path", "steps", "pedestrian", "corridor", "cycleway"]),
]
TIER_LABELS = {"primary": "Primary Roads", "secondary": "Secondary Roads", "local": "Local Roads", "service": "Service / Parking Aisles",
               "pedestrianCycling": "Pedestrian & Cycling", "other": "Other"}
CIRCULATION = ["residential", "tertiary", "secondary", "primary", "unclassified", "motorway", "motorway_link", "primary_link", "secondary_link", "tertiary_link", "living_street"]

# Visiting rings (radius m, label, weekly visit rate) and walking bands (minutes).
RINGS = [(500, "Expected Daily Visitors", 0.25), (1000, "Weekly Visitors", 0.12), (2000, "Primary Service Area", 0.05), (5000, "Regional Users", 0.02)]
WALK_BANDS = [5, 10, 15, 20]
GREEN_M2_PER_CAPITA = 9
COMPASS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]
R_EARTH, R_EARTH_ETL = 6371008.8, 6371000.0
WALK_SPEED = 80.0
