"""The cell scores as plain SQL for the DuckDB side, written apart from ``functions/formulas``.

``N(x, m)`` stands for x as a share of m between 0 and 100, ``R(x)`` for half-up rounding.
"""

from __future__ import annotations

import re

_TEXT = """
demand_score: R(N(pop_density_km2, 20000) * 0.45 + N(100 - green_coverage_pct, 100) * 0.35 + N(building_coverage_pct, 80) * 0.2)
park_access_score: CASE WHEN walking_time_to_park_minutes IS NULL THEN 0 ELSE R(N(30 - least(30, walking_time_to_park_minutes), 30)) END
walkability_score: R(N(intersection_count_hex / coalesce(nullif(hex_area_km2, 0), 0.0001), 150) * 0.3 + N(real_road_density_m_per_km2, 40000) * 0.25 + N(amenity_total, 20) * 0.2 + coalesce(N(800 - least(800, nearest_bus_stop_distance_m), 800), 0) * 0.25)
transit_score: R(coalesce(N(800 - least(800, nearest_bus_stop_distance_m), 800), 0))
barrier_score: R(N(barrier_score_hex, 6))
access_deficit_score: R(coalesce(N(least(30, walking_time_to_park_minutes), 30), 100) * 0.4 + (100 - walkability_score) * 0.25 + (100 - transit_score) * 0.15 + barrier_score * 0.2)
impervious_pct: least(100, (building_area_m2 + real_road_length_m * road_width_m) / coalesce(nullif(hex_area_m2, 0), 1) * 100)
void_pct: greatest(0, 100 - building_coverage_pct - green_coverage_pct)
green_deficit_pct: greatest(0, 100 - green_coverage_pct)
heat_score: R(N(impervious_pct, 100) * 0.7 + N(100 - green_coverage_pct, 100) * 0.3)
cooling_score: R(N(heat_score, 100) * 0.6 + N(void_pct, 100) * 0.4)
biodiversity_score: R(N(park_area_m2 / coalesce(nullif(hex_area_m2, 0), 1) * 100, 50) * 0.6 + N(green_coverage_pct, 30) * 0.4)
env_vulnerability_score: R(N(heat_score, 100) * 0.5 + N(green_deficit_pct, 100) * 0.3 + N(100 - biodiversity_score, 100) * 0.2)
tree_planting_score: R((N(heat_score, 100) * 30 + N(green_deficit_pct, 100) * 25 + N(void_pct, 100) * 25 + N(real_road_density_m_per_km2, 40000) * 15 + N(100 - biodiversity_score, 100) * 5) / 100)
water_sensitive_score: R(N(impervious_pct, 100) * 0.5 + N(void_pct, 100) * 0.5)
family_demand_score: R(N(school_count, 2) * 0.3 + N(playground_count, 2) * 0.3 + N(pop_density_km2, 20000) * 0.4)
youth_demand_score: R(N(sports_count, 2) * 0.55 + N(school_count, 2) * 0.45)
older_demand_score: R(N(mosque_count, 2) * 0.3 + N(clinic_count, 2) * 0.3 + N(pop_density_km2, 20000) * 0.4)
facility_access_score: R(N(amenity_total, 20))
diversity_score: R(len(list_filter([school_count, mosque_count, clinic_count, hospital_count, playground_count, sports_count, restaurant_count, cafe_count, shop_count], lambda k: k > 0)) / 9 * 100)
playground_deficit_score: R(N(pop_density_km2, 20000) * CASE WHEN playground_count > 0 THEN 0.3 ELSE 1 END)
sports_deficit_score: R(N(pop_density_km2, 20000) * CASE WHEN sports_count > 0 THEN 0.3 ELSE 1 END)
green_space_deficit_score: R(N(100 - green_coverage_pct, 100))
community_vulnerability_score: R(N(pop_density_km2, 20000) * 0.3 + green_space_deficit_score * 0.2 + coalesce(N(least(60, walking_time_to_park_minutes), 60), 100) * 0.3 + N(20 - amenity_total, 20) * 0.2)
community_opportunity_score: R(N(community_vulnerability_score, 100) * 0.6 + N(void_pct, 100) * 0.4)
urban_score: R(N(coalesce(building_count / nullif(hex_area_km2, 0), 0), 3000) * 0.5 + N(building_coverage_pct, 80) * 0.5)
simple_demand: R(pop_density_km2 / 100 * (1 - green_coverage_pct / 100) * 10) / 10
"""

#: Columns that count as 0 when missing.
_ZERO = ("pop_density_km2 green_coverage_pct building_coverage_pct intersection_count_hex real_road_density_m_per_km2 amenity_total barrier_score_hex building_area_m2 real_road_length_m park_area_m2 "
         "school_count playground_count sports_count mosque_count clinic_count hospital_count restaurant_count cafe_count shop_count building_count").split()


def _call(text: str, name: str, make) -> str:
    """Replace every ``name(a, b)`` by ``make(a, b)``, inner ones first."""
    while (at := text.rfind(f"{name}(")) >= 0:
        depth, end, cuts = 0, at + len(name), []
        for end in range(at + len(name), len(text)):
            c = text[end]
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 1:
                cuts.append(end)
            if not depth:
                break
        ends = [at + len(name), *cuts, end]
        text = text[:at] + make(*[text[a + 1:b].strip() for a, b in zip(ends, ends[1:])]) + text[end + 1:]
    return text


def _sql(text: str) -> str:
    text = re.sub(r"(?<![\w.])(\d+(?:\.\d+)?)(?![\w.])", r"\1e0", text)
    text = re.sub(rf"\b({'|'.join(_ZERO)})\b", r"coalesce(\1, 0e0)", text)
    # a missing value stays missing: least and greatest alone would pass over it
    text = _call(text, "N", lambda x, m: f"CASE WHEN ({x}) IS NOT NULL THEN greatest(0e0, least(100e0, ({x}) / {m} * 100e0)) END")
    return _call(text, "R", lambda x: f"CAST(floor(({x}) + 0.5e0) AS DOUBLE)")


CELL_SQL = {name: _sql(text) for name, text in (line.split(": ", 1) for line in _TEXT.strip().splitlines())}
