"""Registered cell-score and study-area queries with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formulas as fm
from ..functions import lexicon as lx
from ..functions.geo import haversine_m
from ..functions.numeric import js_round
from ..functions.programs import PLANNING_PROGRAMS
from ..functions.session import written_table
from ..operators import cells as cl
from ..operators import exports as xp
from ..operators import filters as fl
from ..operators import ranking as rk
from ..operators import reports as rp
from ..operators import reviews as rv
from ..sources import adapters as ad
from .cell_sql import CELL_SQL
from .registry import ORACLE, query
from .review_queries import COMPLAINTS, HEALTH, IMP, PERS, enriched
from .sqlbase import CELLS, ENRICHED, POINTS, ROADS, haversine, js, norm, q, values_list

PARK = ["park_id"]


def tier_sql(col="highway"):
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({col}, {q(t)})" for t in tags) + f" THEN {q(n)}" for n, tags in fm.ROAD_TIERS) + " ELSE 'other' END"


TIER_WIDTH = "CASE tier " + " ".join(f"WHEN {q(k)} THEN {float(v)}e0" for k, v in fm.ROAD_WIDTHS.items()) + " END"
WIDTH = f"""{ROADS}, tiered AS (SELECT *, {tier_sql()} AS tier FROM roads),
width AS (SELECT park_id, sum(length * {TIER_WIDTH}) / sum(length) AS road_width_m FROM tiered GROUP BY park_id)"""
SCORED = f"""{CELLS}, {WIDTH}, wcells AS (SELECT c.*, coalesce(w.road_width_m, 5e0) AS road_width_m FROM cells c LEFT JOIN width w USING (park_id)),
sc AS (SELECT *, {', '.join(f'{e} AS {k}' for k, e in CELL_SQL.items())} FROM wcells)"""


def scored(spark, sf):
    return cl.score_cells(cl.with_road_width(ad.cells(spark, sf), ad.roads(spark, sf)))


def site_points(spark, sf):
    return ad.points(spark, sf).withColumns({"center_lng": F.lit(ad.CENTER[0]), "center_lat": F.lit(ad.CENTER[1])})


def roads_summary(spark, sf):
    area = ad.cells(spark, sf).groupBy("park_id").agg(F.sum("hex_area_km2").alias("km2"))
    return rp.road_stats(ad.roads(spark, sf), area)


TIERS = [t for t, _ in fm.ROAD_TIERS] + ["other"]
CIRC = "(" + " OR ".join(f"contains(highway, {q(t)})" for t in fm.CIRCULATION) + ")"
RSTATS = f"""area AS (SELECT park_id, sum(hex_area_km2) AS km2 FROM cells GROUP BY park_id),
rt AS (SELECT park_id, sum(length) AS total_length_m, count(*) AS segments, {', '.join(f'CAST(count(*) FILTER (WHERE tier = {q(t)}) AS BIGINT) AS "n_{t}", coalesce(sum(length) FILTER (WHERE tier = {q(t)}), 0e0) AS "len_{t}"' for t in TIERS)} FROM tiered GROUP BY park_id),
ce AS (SELECT DISTINCT park_id, least(u, v) AS a, greatest(u, v) AS b FROM roads), deg AS (SELECT park_id, node, count(*) AS degree FROM (SELECT park_id, a AS node FROM ce UNION ALL SELECT park_id, b FROM ce) GROUP BY ALL),
rd AS (SELECT park_id, count(*) AS nodes, CAST(sum(degree) // 2 AS BIGINT) AS edges, count(*) FILTER (WHERE degree >= 3) AS intersections, count(*) FILTER (WHERE degree = 1) AS dead_ends FROM deg GROUP BY park_id),
cc AS (SELECT DISTINCT park_id, least(u, v) AS a, greatest(u, v) AS b FROM roads WHERE {CIRC}), cn AS (SELECT park_id, count(DISTINCT node) AS n FROM (SELECT park_id, a AS node FROM cc UNION ALL SELECT park_id, b FROM cc) GROUP BY park_id),
cb AS (SELECT park_id, greatest(1, e - n + 1) AS blocks FROM (SELECT park_id, count(*) AS e FROM cc GROUP BY park_id) JOIN cn USING (park_id)),
rs AS (SELECT rt.*, nodes, edges, intersections, dead_ends, blocks, coalesce(total_length_m / km2, 0e0) AS density_m_per_km2, round_even(km2 / blocks, 4) AS avg_block_km2 FROM rt JOIN rd USING (park_id) LEFT JOIN cb USING (park_id) LEFT JOIN area USING (park_id))"""
BASE = f"WITH {SCORED}, {RSTATS}"


@query("road_width", f"WITH {WIDTH} SELECT park_id, {js('road_width_m', 6)} AS road_width_m FROM width")
def _(spark, sf):
    return cl.avg_road_width(ad.roads(spark, sf)).withColumn("road_width_m", js_round("road_width_m", 6))


SCORE_COLS = list(fm.CELL_FORMULAS)


@query("cell_scores", f"WITH {SCORED} SELECT park_id, h3_id, {', '.join(js(k, 6) + ' AS ' + k for k in SCORE_COLS)} FROM sc")
def _(spark, sf):
    return scored(spark, sf).select("park_id", "h3_id", *[js_round(k, 6).alias(k) for k in SCORE_COLS])


@query("tree_planting_custom_weights", f"WITH {SCORED}, t AS (SELECT park_id, h3_id, {fm.tree_planting({'heat': 10, 'land': 60})} AS score FROM sc) SELECT * FROM t")
def _(spark, sf):
    return cl.score_cells(cl.with_road_width(ad.cells(spark, sf), ad.roads(spark, sf)), {"heat": 10, "land": 60}).select("park_id", "h3_id", F.col("tree_planting_score").alias("score"))


@query("park_site_cells", f"WITH {CELLS} SELECT park_id, h3_id, park_area_m2 FROM cells WHERE park_area_m2 > 0")
def _(spark, sf):
    return fl.park_site_filter(ad.cells(spark, sf)).select("park_id", "h3_id", "park_area_m2")


def _z(f):
    return f"CASE WHEN stddev_pop({f}) OVER w = 0 THEN 0e0 ELSE ({f} - avg({f}) OVER w) / stddev_pop({f}) OVER w END AS z_{f}"


LANDUSE = f"""zz AS (SELECT *, {', '.join(_z(f) for f in cl.INSTITUTIONAL + cl.COMMERCIAL)} FROM cells WINDOW w AS (PARTITION BY park_id)),
zi AS (SELECT *, ({' + '.join('z_' + f for f in cl.INSTITUTIONAL)}) / 4e0 AS iz, ({' + '.join('z_' + f for f in cl.COMMERCIAL)}) / 3e0 AS cz FROM zz),
lu AS (SELECT park_id, h3_id, hex_area_km2, CASE WHEN park_area_m2 / hex_area_m2 >= 0.3e0 THEN 'Parks / Open Space' WHEN building_coverage_pct < 2 THEN 'Undeveloped' WHEN iz < 0.5e0 AND cz < 0.5e0 THEN 'Residential' WHEN iz > cz THEN 'Institutional' ELSE 'Commercial' END AS land_use FROM zi),
luc AS (SELECT * FROM (VALUES {values_list([(i, u) for i, u in enumerate(cl.LAND_USES)])}) v(o, category)),
lub AS (SELECT p.park_id, o, category, count(h3_id) AS hex_count, coalesce(sum(hex_area_km2), 0e0) AS a FROM (SELECT DISTINCT park_id FROM cells) p CROSS JOIN luc LEFT JOIN lu ON lu.park_id = p.park_id AND lu.land_use = luc.category GROUP BY ALL),
lut AS (SELECT park_id, sum(hex_count) AS n, sum(a) AS t FROM lub GROUP BY park_id),
lud AS (SELECT park_id, {js("-sum(CASE WHEN hex_count > 0 THEN hex_count / CAST(n AS DOUBLE) * ln(hex_count / CAST(n AS DOUBLE)) ELSE 0e0 END) / ln(5e0) * 100e0")} AS diversity_index FROM lub JOIN lut USING (park_id) GROUP BY park_id),
lum AS (SELECT park_id, category AS dominant_land_use FROM (SELECT *, row_number() OVER (PARTITION BY park_id ORDER BY {js('a', 2)} DESC, o) AS r FROM lub) WHERE r = 1),
landuse AS (SELECT b.park_id, diversity_index, dominant_land_use, category, hex_count, {js('a', 2)} AS area_km2, {js('a / t * 1000e0')} / 10e0 AS pct FROM lub b JOIN lut USING (park_id) JOIN lud USING (park_id) JOIN lum USING (park_id))"""


@query("land_use_cells", f"WITH {CELLS}, {LANDUSE} SELECT park_id, h3_id, land_use FROM lu")
def _(spark, sf):
    return cl.classify_land_use(ad.cells(spark, sf)).select("park_id", "h3_id", "land_use")


@query("land_use_breakdown", f"WITH {CELLS}, {LANDUSE} SELECT * FROM landuse")
def _(spark, sf):
    return cl.land_use_breakdown(ad.cells(spark, sf))


@query("cell_zscores", f"WITH {CELLS}, z AS (SELECT park_id, h3_id, {', '.join(_z(f) for f in ('population', 'building_count'))} FROM cells WINDOW w AS (PARTITION BY park_id)) SELECT park_id, h3_id, {js('z_population', 6)} AS z_population, {js('z_building_count', 6)} AS z_building_count FROM z")
def _(spark, sf):
    z = rk.zscore(ad.cells(spark, sf), ["population", "building_count"], PARK)
    return z.select("park_id", "h3_id", js_round("z_population", 6).alias("z_population"), js_round("z_building_count", 6).alias("z_building_count"))


@query("cell_minmax", f"WITH {CELLS}, s AS (SELECT park_id, min(population) lo, max(population) hi FROM cells GROUP BY park_id) SELECT park_id, h3_id, (population - lo) / (hi - lo) * 100e0 AS norm, 1e0 - (population - lo) / (hi - lo) AS inv FROM cells JOIN s USING (park_id)")
def _(spark, sf):
    d = rk.minmax_normalise(ad.cells(spark, sf), "population", "norm", PARK, 100.0)
    return rk.minmax_normalise(d, "population", "inv", PARK, inverse=True).select("park_id", "h3_id", "norm", "inv")


@query("population_weighted_distance", f"WITH {CELLS} SELECT park_id, {js('sum(population * network_distance_to_park_m) / sum(population) FILTER (WHERE network_distance_to_park_m IS NOT NULL)', 6)} AS m FROM cells GROUP BY park_id")
def _(spark, sf):
    return ad.cells(spark, sf).groupBy("park_id").agg(js_round(rk.weighted_mean("network_distance_to_park_m", "population"), 6).alias("m"))


TOPS = {"population": "population", "buildings": "building_count", "road_density": "real_road_density_m_per_km2", "tree_planting": "tree_planting_score", "water_sensitive": "water_sensitive_score",
        "community": "community_opportunity_score", "deficit": "access_deficit_score * floor(population + 0.5e0)", "simple_demand": "simple_demand"}


@query("top_cells", f"WITH {SCORED} " + " UNION ALL ".join(
    f"(SELECT {q(n)} AS list, park_id, h3_id, rank FROM (SELECT park_id, h3_id, row_number() OVER (PARTITION BY park_id ORDER BY {e} DESC, seq) AS rank FROM sc) WHERE rank <= 20)" for n, e in TOPS.items()))
def _(spark, sf):
    s = scored(spark, sf)
    out = None
    for n, e in TOPS.items():
        t = rk.top_n_by(s, F.expr(e), 20, PARK).select(F.lit(n).alias("list"), "park_id", "h3_id", "rank")
        out = t if out is None else out.unionByName(t)
    return out


def _hist_sql(src, col, k):
    return f"""hs AS (SELECT park_id, min({col}) AS lo, CASE WHEN max({col}) = min({col}) THEN 1e0 ELSE (max({col}) - min({col})) / {float(k)}e0 END AS w FROM {src} WHERE {col} IS NOT NULL GROUP BY park_id),
hc AS (SELECT c.park_id, CAST(least({k - 1}, floor(({col} - lo) / w)) AS INTEGER) AS bucket_index, count(*) AS n FROM {src} c JOIN hs USING (park_id) WHERE {col} IS NOT NULL GROUP BY ALL)
SELECT hs.park_id, CAST(i AS INTEGER) AS bucket_index, {js('lo + i * w')} AS bucket, coalesce(n, 0) AS n FROM hs CROSS JOIN range({k}) r(i) LEFT JOIN hc ON hc.park_id = hs.park_id AND hc.bucket_index = i"""


@query("density_histogram", f"WITH {CELLS}, {_hist_sql('cells', 'pop_density_km2', 10)}")
def _(spark, sf):
    return rk.histogram(ad.cells(spark, sf), "pop_density_km2", 10, PARK)


@query("walking_time_histogram", f"WITH {CELLS}, {_hist_sql('cells', 'walking_time_to_park_minutes', 8)}")
def _(spark, sf):
    return rk.histogram(ad.cells(spark, sf), "walking_time_to_park_minutes", 8, PARK)


@query("heat_histogram", f"WITH {SCORED}, {_hist_sql('sc', 'heat_score', 8)}")
def _(spark, sf):
    return rk.histogram(scored(spark, sf), "heat_score", 8, PARK)


PCTS = [10, 25, 50, 75, 90, 95, 99]


@query("density_percentiles", f"WITH {CELLS}, r AS (SELECT park_id, pop_density_km2 AS v, row_number() OVER (PARTITION BY park_id ORDER BY pop_density_km2) - 1 AS i, count(*) OVER (PARTITION BY park_id) AS n FROM cells) "
       + " UNION ALL ".join(f"SELECT park_id, {p} AS percentile, v AS value FROM r WHERE i = least(n - 1, CAST(floor({p} / 100e0 * n) AS BIGINT))" for p in PCTS))
def _(spark, sf):
    return rk.percentiles(ad.cells(spark, sf), "pop_density_km2", PCTS, PARK)


@query("rating_median", f"WITH r AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, 50 AS percentile, v AS value FROM r WHERE i = least(n - 1, n // 2)")
def _(spark, sf):
    return rk.percentiles(ad.table(spark, sf, "events"), "value", [50], ["event_type"])


CDIST = haversine("center_lng", "center_lat", "lng", "lat")
RINGS = f"""cd AS (SELECT *, {CDIST} AS dm FROM cells), rings AS (SELECT * FROM (VALUES {', '.join(f'({float(r)}e0, {q(v)}, {w}e0, {7 if i == 0 else 1}e0)' for i, (r, v, w) in enumerate(fm.RINGS))}) v(radius_m, visit_label, rate, dv)),
rg AS (SELECT p.park_id, radius_m, visit_label, rate, dv, coalesce(sum(population), 0e0) AS pop, count(h3_id) AS hex_count FROM (SELECT DISTINCT park_id FROM cells) p CROSS JOIN rings LEFT JOIN cd ON cd.park_id = p.park_id AND dm <= radius_m GROUP BY ALL),
catch AS (SELECT park_id, radius_m, {js('pop')} AS population, {js('pi() * pow(radius_m / 1000e0, 2)', 2)} AS area_km2, {js('pop / (pi() * pow(radius_m / 1000e0, 2))')} AS density_per_km2,
 {js('pop / coalesce(nullif(max(pop) OVER (PARTITION BY park_id), 0e0), 1e0) * 100e0', 1)} AS pct_of_total, hex_count, visit_label, {js('pop * rate / dv')} AS visitors FROM rg)"""


@query("radius_catchments", f"WITH {CELLS}, {RINGS} SELECT * FROM catch")
def _(spark, sf):
    return cl.radius_catchments(ad.cells(spark, sf))


def _walk_sql(etl=False):
    r = (lambda x, dp=0: f"round_even({x}, {dp})") if etl else js
    return f"""wb AS (SELECT * FROM (VALUES (5), (10), (15), (20)) v(minutes)),
wj AS (SELECT p.park_id, minutes, count(h3_id) AS hex_count, coalesce(sum(population), 0e0) AS pop, coalesce(sum(hex_area_km2), 0e0) AS a, {', '.join(f'coalesce(sum({f}_count), 0e0) AS {g}' for f, g in (('school', 'schools'), ('bus_stop', 'bus_stops'), ('clinic', 'clinics'), ('mosque', 'mosques')))},
 coalesce(sum(restaurant_count + cafe_count + shop_count), 0e0) AS commercial, avg(network_distance_to_park_m) AS d, avg(route_directness_ratio) AS dr
 FROM (SELECT DISTINCT park_id FROM cells) p CROSS JOIN wb LEFT JOIN cells c ON c.park_id = p.park_id AND walking_time_to_park_minutes <= minutes GROUP BY ALL),
wt AS (SELECT park_id, sum(population) AS total FROM cells GROUP BY park_id),
walk AS (SELECT park_id, minutes, {r('pop')} AS population, {r('a', 3 if etl else 2)} AS area_km2, coalesce({r('pop / nullif(a, 0)')}, 0e0) AS density_per_km2, {r('pop / coalesce(nullif(total, 0), 1) * 1000e0')} / 10e0 AS pct_of_total, hex_count, schools, bus_stops, clinics, mosques, commercial,
 {r('d')} AS avg_route_distance_m, {r('dr', 3)} AS avg_directness FROM wj JOIN wt USING (park_id))"""


@query("walking_catchments", f"WITH {CELLS}, {_walk_sql()} SELECT * FROM walk")
def _(spark, sf):
    return cl.walking_catchments(ad.cells(spark, sf))


@query("walking_catchments_etl", f"WITH {CELLS}, {_walk_sql(True)} SELECT * FROM walk")
def _(spark, sf):
    return cl.walking_catchments(ad.cells(spark, sf), etl_rounding=True)


@query("population_kpis", f"WITH {CELLS}, {RINGS}, mx AS (SELECT *, row_number() OVER (PARTITION BY park_id ORDER BY pop_density_km2 DESC, seq) AS rx, row_number() OVER (PARTITION BY park_id ORDER BY pop_density_km2, seq) AS rn FROM cells) "
       f"SELECT park_id, {js('sum(population)')} AS total_population, {js('sum(population) / sum(hex_area_km2)')} AS aggregate_density, {js('avg(pop_density_km2)')} AS avg_density, max(h3_id) FILTER (WHERE rx = 1) AS max_cell, {js('max(pop_density_km2)')} AS max_density, "
       f"max(h3_id) FILTER (WHERE rn = 1) AS min_cell, {js('min(pop_density_km2)')} AS min_density, count(*) AS cell_count, (SELECT max(visitors) FROM catch c WHERE c.park_id = mx.park_id AND radius_m = 500) AS daily_users, (SELECT max(visitors) FROM catch c WHERE c.park_id = mx.park_id AND radius_m = 1000) AS weekly_users FROM mx GROUP BY park_id")
def _(spark, sf):
    return rp.population_kpis(ad.cells(spark, sf))


@query("road_stats", f"{BASE} SELECT * REPLACE ({js('density_m_per_km2', 4)} AS density_m_per_km2) FROM rs")
def _(spark, sf):
    return roads_summary(spark, sf).withColumn("density_m_per_km2", js_round("density_m_per_km2", 4))


@query("road_hierarchy", f"WITH {WIDTH}, t AS (SELECT park_id, sum(length) AS t FROM roads GROUP BY park_id) SELECT park_id, tier, CASE tier {' '.join(f'WHEN {q(a)} THEN {q(b)}' for a, b in fm.TIER_LABELS.items())} END AS label, count(*) AS segments, {js('sum(length) / 100e0')} / 10e0 AS length_km, {js('sum(length) / any_value(t) * 1000e0')} / 10e0 AS pct_of_total FROM tiered JOIN t USING (park_id) GROUP BY park_id, tier")
def _(spark, sf):
    return rp.road_hierarchy(ad.roads(spark, sf))


@query("node_degree", f"{BASE} SELECT * FROM deg")
def _(spark, sf):
    return rp.graph_degree(ad.roads(spark, sf))


PED = f"""pq0 AS (SELECT park_id, sum(hex_area_km2) AS km2, sum(intersection_count_hex) AS cr, avg(route_directness_ratio) AS dr, avg(transit_score) AS ts, avg(amenity_total) AS am FROM sc GROUP BY park_id),
pq1 AS (SELECT p.park_id, {js('coalesce(intersections / CAST(nodes AS DOUBLE), 0e0) * 100e0')} AS connectivity, {js(norm('cr / km2', 400))} AS intersection_density, {js('coalesce(dr, 0e0) * 100e0')} AS route_directness, {js('ts')} AS transit_access,
 {js(norm('am', 20))} AS amenity_access, {js(norm('coalesce("len_pedestrianCycling" / total_length_m, 0e0) * 100e0', 40))} AS sidewalk_coverage, avg_block_km2 * 1000000e0 AS blk, dr, coalesce(dead_ends / CAST(nodes AS DOUBLE), 0e0) * 100e0 AS de, coalesce("len_pedestrianCycling" / total_length_m, 0e0) * 100e0 AS side
 FROM pq0 p LEFT JOIN rs USING (park_id)),
ped AS (SELECT park_id, greatest(0e0, least(100e0, {js('(connectivity * 28e0 + intersection_density * 17e0 + route_directness * 17e0 + transit_access * 17e0 + amenity_access * 11e0 + sidewalk_coverage * 10e0) / 100e0')})) AS walkability_score,
 connectivity, intersection_density, route_directness, transit_access, amenity_access, sidewalk_coverage, {js('sqrt(blk)')} AS avg_block_length_m, {js('blk')} AS avg_block_m2, {js('de', 1)} AS dead_end_pct, {js('dr', 3)} AS directness_avg, {js('side', 1)} AS sidewalk_pct FROM pq1)"""


@query("pedestrian_quality", f"{BASE}, {PED} SELECT * FROM ped")
def _(spark, sf):
    return rp.pedestrian_quality(scored(spark, sf), roads_summary(spark, sf))


def st(score, inverse=False):
    s = f"(100e0 - {score})" if inverse else f"({score})"
    return f"CASE WHEN {s} >= 70 THEN 'critical' WHEN {s} >= 40 THEN 'watch' ELSE 'good' END", f"CASE WHEN {s} >= 70 THEN 'High' WHEN {s} >= 40 THEN 'Medium' ELSE 'Low' END"


def rows_sql(src, rows):
    return " UNION ALL ".join(f"SELECT park_id, {q(k)} AS key, CAST({v} AS DOUBLE) AS value, {s} AS status, {p} AS priority FROM {src}" for k, v, s, p in rows)


def na_rows(keys):
    return [(k, "NULL", "'unavailable'", "'Low'") for k in keys]


GOOD, LOW = "'good'", "'Low'"
_dr = [("parkDemandIndex", "idx", *st("idx")), ("residentsPerHectare", js("ha", 1), *st(norm("ha", 300))), ("residentsPerH3", js("pop / n"), GOOD, LOW), *na_rows(["popPerEntrance", "popPerSeating", "popPerTree", "vulnerabilityIndex"]),
       ("popPerPlayground", js("ppp"), f"CASE WHEN ppp IS NULL THEN 'unavailable' ELSE {st(norm('ppp', 20000))[0]} END", f"CASE WHEN ppp IS NULL THEN 'Low' ELSE {st(norm('ppp', 20000))[1]} END"),
       ("popPerGreenM2", js("1e0 / coalesce(nullif(gpc, 0e0), 1e0)", 2), *st("def")), ("accessibilityScore", "walkability_score", *st("walkability_score", True)),
       ("pressureScore", "press", *st("press")), ("greenSpaceDeficit", js("def"), *st("def"))]
DEMAND = f"""da0 AS (SELECT park_id, count(*) AS n, sum(population) AS pop, sum(hex_area_km2) AS km2, sum(playground_count) AS pl, sum(green_coverage_pct * hex_area_m2) / 100e0 AS gm, {js('avg(demand_score)')} AS idx FROM sc GROUP BY park_id),
da AS (SELECT da0.*, walkability_score, coalesce(gm / pop, 0e0) AS gpc, greatest(0e0, (9e0 - coalesce(gm / pop, 0e0)) / 9e0 * 100e0) AS def, pop / (km2 * 100e0) AS ha, pop / nullif(pl, 0) AS ppp, {js(norm('pop / km2', 20000))} AS press FROM da0 JOIN ped USING (park_id))"""


@query("demand_assessment", f"{BASE}, {PED}, {DEMAND} {rows_sql('da', _dr)}")
def _(spark, sf):
    return rp.demand_assessment(scored(spark, sf), roads_summary(spark, sf))


def zone_sql(metric, name="zn"):
    """Top 5 % cells per park with their compass direction."""
    brg = "degrees(atan2(sin(radians(zlng - 55.2201e0)) * cos(radians(zlat)), cos(radians(25.1552e0)) * sin(radians(zlat)) - sin(radians(25.1552e0)) * cos(radians(zlat)) * cos(radians(zlng - 55.2201e0))))"
    return f"""{name}r AS (SELECT *, row_number() OVER (PARTITION BY park_id ORDER BY {metric} DESC, seq) AS zr, count(*) OVER (PARTITION BY park_id) AS zc FROM sc),
{name}t AS (SELECT * FROM {name}r WHERE zr <= greatest(1e0, {js('zc * 0.05e0')})),
{name}c AS (SELECT park_id, avg(lng) AS zlng, avg(lat) AS zlat FROM {name}t GROUP BY park_id),
{name} AS (SELECT park_id, (['N','NE','E','SE','S','SW','W','NW'])[CAST({js(f'(({brg} + 360e0) % 360e0) / 45e0')} AS INTEGER) % 8 + 1] AS compass FROM {name}c)"""


@query("population_summary", f"WITH {SCORED}, {zone_sql('demand_score')}, a AS (SELECT park_id, {js('sum(population)')} AS population_served, {js('sum(population) / sum(hex_area_km2)')} AS avg_density, {js('avg(demand_score)')} AS demand_index FROM sc GROUP BY park_id), c AS (SELECT park_id, avg(building_coverage_pct) AS cov FROM znt GROUP BY park_id) "
       "SELECT a.*, compass || CASE WHEN cov > 30 THEN ' Residential Corridor' ELSE ' Mixed-Use Area' END AS highest_demand_zone, CASE WHEN demand_index >= 75 THEN 'VERY HIGH' WHEN demand_index >= 50 THEN 'HIGH' WHEN demand_index >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS demand_level FROM a JOIN zn USING (park_id) JOIN c USING (park_id)")
def _(spark, sf):
    return rp.population_summary(scored(spark, sf))


SURF = " + ".join(f'"len_{t}" * {float(w)}e0' for t, w in fm.ROAD_WIDTHS.items())
URBAN = f"""{LANDUSE}, u0 AS (SELECT park_id, sum(building_count) AS b, sum(building_area_m2) AS bm, sum(hex_area_km2) AS km2, avg(building_coverage_pct) AS cov, avg(green_coverage_pct) AS green FROM sc GROUP BY park_id),
u1 AS (SELECT park_id, any_value(diversity_index) AS land_use_diversity, any_value(dominant_land_use) AS dominant_land_use, {', '.join(f"max(pct) FILTER (WHERE category = {q(c)}) AS {c.lower()}_pct" for c in ('Residential', 'Commercial', 'Institutional'))} FROM landuse GROUP BY park_id),
u2 AS (SELECT u0.*, coalesce(bm / nullif(b, 0), 0e0) AS asz, b / u0.km2 AS dens, coalesce(density_m_per_km2, 0e0) AS street, coalesce(least(100e0, (bm + coalesce({SURF}, 0e0)) / (u0.km2 * 1000000e0) * 100e0), 0e0) AS imp, coalesce(intersections, 0) AS ix, nodes, coalesce(total_length_m, 0e0) AS tl FROM u0 LEFT JOIN rs USING (park_id)),
urban AS (SELECT u2.park_id, b AS building_count, {js('bm')} AS footprint_m2, {js('asz')} AS avg_building_m2, {js('cov', 1)} AS building_coverage_pct, {js('tl / 1000e0', 1)} AS road_length_km, CAST(ix AS DOUBLE) AS intersections, {js('ix / km2', 1)} AS intersections_per_km2, {js('street')} AS street_density,
 land_use_diversity, dominant_land_use, residential_pct, commercial_pct, institutional_pct, {js('imp', 1)} AS impervious_pct, {js('green', 1)} AS open_space_pct, {js(norm('dens', 3000) + ' * 0.5e0 + ' + norm('street', 40000) + ' * 0.5e0')} AS development_intensity,
 {js(norm('dens', 3000) + ' * 0.6e0 + (100e0 - ' + norm('asz', 500) + ') * 0.4e0')} AS compactness, {js('coalesce(ix / CAST(nodes AS DOUBLE), 0e0) * 100e0')} AS connectivity FROM u2 JOIN u1 USING (park_id))"""


@query("urban_kpis", f"{BASE}, {URBAN} SELECT * FROM urban")
def _(spark, sf):
    return rp.urban_kpis(scored(spark, sf), roads_summary(spark, sf))


@query("urban_summary", f"{BASE}, {URBAN} SELECT park_id, CASE WHEN building_coverage_pct > 35 THEN 'High Density ' WHEN building_coverage_pct > 18 THEN 'Medium Density ' ELSE 'Low Density ' END || dominant_land_use AS urban_character, CASE WHEN connectivity >= 60 THEN 'High' WHEN connectivity >= 35 THEN 'Medium' ELSE 'Low' END AS road_connectivity, "
       f"CASE WHEN development_intensity >= 65 THEN 'High' WHEN development_intensity >= 35 THEN 'Medium' ELSE 'Low' END AS development_pressure, {js('development_intensity * 0.35e0 + connectivity * 0.35e0 + ' + norm('land_use_diversity', 100) + ' * 0.3e0')} AS urban_score FROM urban")
def _(spark, sf):
    return rp.urban_summary(rp.urban_kpis(scored(spark, sf), roads_summary(spark, sf)))


@query("urban_morphology", f"""{BASE}, m0 AS (SELECT s.park_id, sum(building_area_m2) / nullif(sum(building_count), 0) AS grain, avg(building_coverage_pct) AS cov, avg(green_coverage_pct) AS green, any_value(avg_block_km2) AS blk, {js('any_value(intersections) / CAST(any_value(nodes) AS DOUBLE) * 100e0')} AS perm FROM sc s LEFT JOIN rs USING (park_id) GROUP BY s.park_id),
m AS (SELECT *, coalesce(grain, 0e0) AS g, CASE WHEN green = 0 THEN cov ELSE cov / green END AS ratio, greatest(0e0, 100e0 - cov - green) AS void FROM m0)
SELECT * EXCLUDE (priority) FROM ({rows_sql('m', [('blockSize', 'blk', "CASE WHEN blk > 0 THEN 'good' ELSE 'unavailable' END", LOW), ('urbanGrain', js('g'), "CASE WHEN g < 150 THEN 'good' WHEN g < 400 THEN 'watch' ELSE 'critical' END", LOW), ('builtOpenRatio', js('ratio', 2), "CASE WHEN ratio > 3 THEN 'critical' WHEN ratio > 1.5 THEN 'watch' ELSE 'good' END", LOW), ('voidRatio', js('void', 1), "CASE WHEN void > 60 THEN 'watch' ELSE 'good' END", LOW), ('permeability', 'perm', "CASE WHEN perm IS NULL THEN 'unavailable' WHEN perm > 50 THEN 'good' ELSE 'watch' END", LOW), *na_rows(['edgeConditions', 'streetEnclosure', 'streetWallRatio', 'urbanContinuity'])])})""")
def _(spark, sf):
    return rp.urban_morphology(scored(spark, sf), roads_summary(spark, sf))


PTS = f"{POINTS}, pd AS (SELECT *, {haversine('55.2201e0', '25.1552e0', 'lng', 'lat')} AS dm FROM points)"


def near_sql(specs):
    return "nc AS (SELECT park_id, " + ", ".join(f"CAST(count(*) FILTER (WHERE layer = {q(a)} AND dm <= {r}) AS BIGINT) AS {n}" for n, (a, r) in specs.items()) + ", CAST(count(*) FILTER (WHERE layer = 'bus_stops') AS BIGINT) AS stops FROM pd GROUP BY park_id)"


@query("transit_accessibility", f"""WITH {SCORED}, {PTS}, {near_sql({'cafes_500m': ('cafes', 500)})},
t AS (SELECT park_id, sum(hex_area_km2) AS km2, sum(population) AS pop, coalesce(sum(population) FILTER (WHERE nearest_bus_stop_distance_m <= 400), 0e0) AS p4, avg(nearest_bus_stop_distance_m) AS bm, {js('avg(transit_score)')} AS ts FROM sc GROUP BY park_id)
SELECT t.park_id, {js('coalesce(stops, 0) / km2', 1)} AS stops_per_km2, {js('p4')} AS pop_within_400m, {js('p4 / pop * 100e0', 1)} AS pop_within_400m_pct, {js('bm')} AS avg_stop_distance_m, ts AS transit_score, CASE WHEN ts >= 60 THEN 'High' WHEN ts >= 30 THEN 'Moderate' ELSE 'Low' END AS transit_label, coalesce(cafes_500m, 0) AS cafes_500m FROM t LEFT JOIN nc USING (park_id)""")
def _(spark, sf):
    return rp.transit_accessibility(scored(spark, sf), site_points(spark, sf))


BAR = [("Primary Road Segments", 'coalesce("n_primary", 0)', "High"), ("Secondary Road Segments", 'coalesce("n_secondary", 0)', "Medium"), ("Dead-End Streets", "coalesce(dead_ends, 0)", "Medium"),
       *[(t, "CAST(0 AS BIGINT)", "Low") for t in ("Pedestrian Crossings", "Fenced Parcels", "Canals / Waterways", "Construction Zones", "Steep Slopes")]]


@query("barrier_analysis", f"{BASE}, b AS (SELECT park_id, {js(norm('avg(barrier_score_hex)', 4))} AS exposure_score FROM sc GROUP BY park_id), bj AS (SELECT * FROM b LEFT JOIN rs USING (park_id)) " + " UNION ALL ".join(
    f"SELECT park_id, exposure_score, CASE WHEN exposure_score >= 60 THEN 'High' WHEN exposure_score >= 30 THEN 'Moderate' ELSE 'Low' END AS exposure_label, {q(t)} AS type, {n} AS n, {q(s)} AS severity FROM bj" for t, n, s in BAR))
def _(spark, sf):
    return rp.barrier_analysis(scored(spark, sf), roads_summary(spark, sf))


@query("accessibility_kpis", f"""{BASE}, {PED}, {_walk_sql()}, {PTS}, {near_sql({'bus_500m': ('bus_stops', 500), 'bus_300m': ('bus_stops', 300), 'schools_1km': ('schools', 1000)})},
wp AS (SELECT park_id, {', '.join(f'max(population) FILTER (WHERE minutes = {m}) AS pop_{m}min' for m in (5, 10, 15))}, max(pct_of_total) FILTER (WHERE minutes = 15) AS p15, max(avg_route_distance_m) FILTER (WHERE minutes = 15) AS d15 FROM walk GROUP BY park_id),
md AS (SELECT park_id, {js('network_distance_to_park_m')} AS median_distance_m FROM (SELECT *, row_number() OVER (PARTITION BY park_id ORDER BY network_distance_to_park_m) - 1 AS i, count(*) OVER (PARTITION BY park_id) AS n FROM sc WHERE network_distance_to_park_m IS NOT NULL) WHERE i = least(n - 1, n // 2)),
a AS (SELECT park_id, sum(population) AS pop, {js('avg(network_distance_to_park_m)')} AS avg_distance_m, {js('max(network_distance_to_park_m)')} AS max_distance_m, {js('sum(population * network_distance_to_park_m) / sum(population) FILTER (WHERE network_distance_to_park_m IS NOT NULL)')} AS weighted_distance_m, {js('avg(transit_score)')} AS ts FROM sc GROUP BY park_id),
k AS (SELECT a.park_id, pop_5min, pop_10min, pop_15min, greatest(0e0, {js('pop - pop_15min')}) AS pop_outside_15min, avg_distance_m, median_distance_m, max_distance_m, weighted_distance_m, coalesce(bus_500m, 0) AS bus_500m, coalesce("n_primary", 0) + coalesce("n_secondary", 0) AS road_barriers, coalesce(dead_ends, 0) AS dead_ends,
 {js('walkability_score * 0.45e0 + ts * 0.25e0 + ' + norm('p15', 100) + ' * 0.3e0')} AS accessibility_score, coalesce(bus_300m, 0) AS bus_300m, coalesce(schools_1km, 0) AS schools_1km,
 {js(norm('coalesce(bus_300m, 0)', 5) + ' * 0.4e0 + coalesce(' + norm('2000e0 - least(2000e0, coalesce(d15, avg_distance_m))', 2000) + ', 0e0) * 0.6e0')} AS entrance_score
 FROM a JOIN wp USING (park_id) LEFT JOIN md USING (park_id) LEFT JOIN nc USING (park_id) JOIN ped USING (park_id) LEFT JOIN rs USING (park_id))
SELECT *, CASE WHEN accessibility_score >= 85 THEN 'Excellent' WHEN accessibility_score >= 70 THEN 'Very Good' WHEN accessibility_score >= 50 THEN 'Good' WHEN accessibility_score >= 30 THEN 'Fair' ELSE 'Poor' END AS status FROM k""")
def _(spark, sf):
    return rp.accessibility_kpis(scored(spark, sf), site_points(spark, sf), roads_summary(spark, sf))


@query("accessibility_zone", f"WITH {SCORED}, {zone_sql('access_deficit_score * population')} SELECT park_id, compass || ' Residential Edge' AS zone FROM zn")
def _(spark, sf):
    s = scored(spark, sf).withColumn("_m", F.col("access_deficit_score") * F.col("population"))
    return cl.top_share_zone(s, "_m").select("park_id", F.concat("compass", F.lit(" Residential Edge")).alias("zone"))


@query("land_cover", f"""WITH {SCORED}, a AS (SELECT park_id, sum(hex_area_m2) AS m2, sum(building_area_m2) AS b, sum(real_road_length_m * road_width_m) AS r, avg(green_coverage_pct) AS g FROM sc GROUP BY park_id),
p AS (SELECT *, least(100e0, b / m2 * 100e0) AS bp FROM a), p2 AS (SELECT *, least(100e0 - bp, r / m2 * 100e0) AS rp FROM p)
SELECT park_id, 'Buildings' AS category, {js('bp', 1)} AS pct FROM p2 UNION ALL SELECT park_id, 'Estimated Paved / Road', {js('rp', 1)} FROM p2 UNION ALL SELECT park_id, 'Green Cover', {js('g', 1)} FROM p2 UNION ALL SELECT park_id, 'Void / Unclassified (bare ground, parking, other)', {js('greatest(0e0, 100e0 - bp - rp - g)', 1)} FROM p2""")
def _(spark, sf):
    return rp.land_cover(scored(spark, sf))


# Reviews of place srcN belong to study area N.
def review_parks(spark, sf):
    return enriched(spark, sf).withColumn("park_id", F.substring("place_id", 4, 10).cast("long"))


def review_parks_table(spark, sf):
    """The reviews of study areas, written for several uses; without keywords, which cost most to find and which none of them reads."""
    return written_table(review_parks(spark, sf).drop("keywords"))


ENV = f"""eh AS (SELECT CAST(substr(place_id, 4) AS BIGINT) AS park_id, max(score) FILTER (WHERE key = 'thermalComfort') AS th, max(score) FILTER (WHERE key = 'biodiversity') AS bio FROM health GROUP BY place_id),
ew AS (SELECT CAST(substr(place_id, 4) AS BIGINT) AS park_id, priority_index AS wat FROM impact WHERE issue_category = 'water features'),
e0 AS (SELECT park_id, avg(green_coverage_pct) AS green, avg(CASE WHEN heat_score >= 65 THEN 1e0 ELSE 0e0 END) * 100e0 AS hot, avg(CASE WHEN heat_score <= 35 THEN 1e0 ELSE 0e0 END) * 100e0 AS cool, {js('avg(cooling_score)')} AS cs, sum(green_coverage_pct * hex_area_m2) / 100e0 AS gm FROM sc GROUP BY park_id),
e1 AS (SELECT e0.*, impervious_pct AS imp, coalesce(th, 60e0) AS th, coalesce(bio, 60e0) AS bio, wat FROM e0 JOIN urban USING (park_id) LEFT JOIN eh USING (park_id) LEFT JOIN ew USING (park_id)),
env AS (SELECT *, {js(norm('green', 40) + ' * 0.25e0 + (100e0 - hot) * 0.2e0 + th * 0.25e0 + bio * 0.15e0 + ' + norm('100e0 - imp', 100) + ' * 0.15e0')} AS al FROM e1)"""


def tri(c):
    return f"CASE WHEN {c} >= 65 THEN 'good' WHEN {c} >= 45 THEN 'watch' ELSE 'critical' END"


def pick(cond, a, b):
    return f"CASE WHEN {cond} THEN {q(a)} ELSE {q(b)} END"


ENV_ROWS = [("greenCoveragePct", js("green", 1), "CASE WHEN green >= 25 THEN 'good' WHEN green >= 10 THEN 'watch' ELSE 'critical' END", pick("green >= 25", "Low", "High")),
            ("imperviousSurfacePct", "imp", "CASE WHEN imp > 40 THEN 'critical' WHEN imp > 20 THEN 'watch' ELSE 'good' END", pick("imp > 40", "High", "Medium")), ("permeableSurfacePct", js("100e0 - imp", 1), GOOD, LOW),
            ("hotspotAreaPct", js("hot", 1), "CASE WHEN hot > 30 THEN 'critical' WHEN hot > 15 THEN 'watch' ELSE 'good' END", pick("hot > 30", "High", "Medium")), ("coolZoneAreaPct", js("cool", 1), GOOD, LOW),
            ("waterBodyAreaM2", "0e0", "'watch'", LOW), ("irrigatedAreaProxyM2", js("gm"), GOOD, LOW), ("biodiversityScore", "bio", tri("bio"), pick("bio >= 65", "Low", "Medium")), ("thermalComfortScore", "th", tri("th"), pick("th >= 65", "Low", "High")),
            ("waterFeatureSatisfaction", "wat", "CASE WHEN wat IS NULL THEN 'unavailable' WHEN wat >= 50 THEN 'critical' ELSE 'good' END", pick("wat >= 50", "Medium", "Low")),
            ("coolingOpportunityScore", "cs", pick("cs >= 60", "watch", "good"), pick("cs >= 60", "High", "Medium")), ("overallEnvironmentalScore", "al", tri("al"), pick("al >= 65", "Low", "High")),
            *na_rows(["avgLST", "maxLST", "minLST", "uhiIntensity", "treeCanopyPct", "avgDaytimeShadePct", "avgAfternoonShadePct", "shadedPathCoveragePct", "ndviMean", "ndviMax", "vegetationHealthScore", "irrigationDemand", "evapotranspirationPotential", "habitatConnectivityScore"])]


def environment(spark, sf):
    r = review_parks_table(spark, sf)
    h = rv.health_score(r, PARK).groupBy("park_id").pivot("key", ["thermalComfort", "biodiversity"]).agg(F.first("score"))
    w = rv.issue_impact(r, PARK).filter(F.col("issue_category") == "water features").select("park_id", F.col("priority_index").alias("water_priority"))
    s = scored(spark, sf)
    return s, rp.environmental_kpis(s, roads_summary(spark, sf), h, w)


@query("environmental_kpis", f"{BASE}, {URBAN}, {ENRICHED}, {HEALTH}, {IMP}, {ENV} {rows_sql('env', ENV_ROWS)}")
def _(spark, sf):
    return environment(spark, sf)[1]


def badge(c):
    return f"CASE WHEN {c} >= 85 THEN 'EXCELLENT' WHEN {c} >= 65 THEN 'GOOD' WHEN {c} >= 45 THEN 'MODERATE' WHEN {c} >= 25 THEN 'POOR' ELSE 'CRITICAL' END"


@query("environmental_summary", f"{BASE}, {URBAN}, {ENRICHED}, {HEALTH}, {IMP}, {ENV}, {zone_sql('heat_score')} SELECT park_id, compass || ' High-Hardscape Edge' AS peak_heat_zone, {js('green', 1)} AS green_pct, {badge('th')} AS thermal_status, {badge('bio')} AS ecology_status, al AS score, {badge('al')} AS status FROM env JOIN zn USING (park_id)")
def _(spark, sf):
    s, k = environment(spark, sf)
    return rp.environmental_summary(s, k)


FAC = f"""fa AS (SELECT park_id, sum(hex_area_km2) AS km2, sum(population) AS pop FROM cells GROUP BY park_id), fl AS (SELECT * FROM (VALUES {values_list(rp.FACILITY_LAYERS)}) v(key, label)),
fp AS (SELECT park_id, layer AS key, count(*) AS c, {js('avg(dm)')} AS m FROM pd GROUP BY ALL),
fac AS (SELECT fa.park_id, fl.key, label, c IS NOT NULL AS loaded, CAST(c AS DOUBLE) AS n, {js('c / km2', 2)} AS density_per_km2, m AS avg_distance_m, {js('m / 80e0', 1)} AS avg_walk_minutes, {js('pop / c')} AS pop_per_facility FROM fa CROSS JOIN fl LEFT JOIN fp ON fp.park_id = fa.park_id AND fp.key = fl.key)"""


@query("facility_stats", f"WITH {CELLS}, {PTS}, {FAC} SELECT * FROM fac")
def _(spark, sf):
    return rp.facility_stats(ad.cells(spark, sf), site_points(spark, sf))


LAY = ["schools", "mosques", "clinics", "hospitals", "sports", "playgrounds", "shops", "bus_stops", "parks"]


@query("community_catchments", f"WITH {CELLS}, {RINGS}, {PTS}, c AS (SELECT park_id, radius_m, " + ", ".join(f"count(*) FILTER (WHERE layer = {q(x)}) AS {x}" for x in LAY) + " FROM pd JOIN rings ON dm <= radius_m GROUP BY ALL) "
       "SELECT k.park_id, k.radius_m, population, area_km2, density_per_km2, " + ", ".join(f"coalesce({x}, 0) AS {x}" for x in LAY) + " FROM catch k LEFT JOIN c USING (park_id, radius_m)")
def _(spark, sf):
    return rp.community_catchments(ad.cells(spark, sf), site_points(spark, sf))


CK_COUNTS = {"schoolsCount": "schools", "mosquesCount": "mosques", "clinicsCount": "clinics", "hospitalsCount": "hospitals", "playgroundsCount": "playgrounds", "sportsCount": "sports", "retailCount": "shops"}
COMM = f"""{PTS}, {FAC}, k0 AS (SELECT park_id, {', '.join(f'max(n) FILTER (WHERE key = {q(v)}) AS n_{v}, max(pop_per_facility) FILTER (WHERE key = {q(v)}) AS p_{v}' for v in CK_COUNTS.values())} FROM fac GROUP BY park_id),
k1 AS (SELECT park_id, sum(population) AS pop, sum(hex_area_km2) AS km2, {js('avg(facility_access_score)')} AS fa, {js('avg(diversity_score)')} AS di, {js('avg(family_demand_score)')} AS fm, {js('avg(youth_demand_score)')} AS yo, {js('avg(older_demand_score)')} AS ol FROM sc GROUP BY park_id),
ck AS (SELECT *, 100e0 - fa AS de, {js('fa * 0.3e0 + di * 0.25e0 + fm * 0.25e0 + (100e0 - (100e0 - fa)) * 0.2e0')} AS al FROM k1 JOIN k0 USING (park_id))"""


def c3(c):
    return f"CASE WHEN {c} >= 60 THEN 'good' WHEN {c} >= 35 THEN 'watch' ELSE 'critical' END"


CK_ROWS = [("totalPopulation", js("pop"), GOOD, LOW), ("popDensity", js("pop / km2"), GOOD, LOW), *[(k, f"n_{v}", f"CASE WHEN n_{v} IS NULL THEN 'unavailable' ELSE 'good' END", LOW) for k, v in CK_COUNTS.items()],
           ("popPerSchool", "p_schools", GOOD, LOW), ("popPerPlayground", "p_playgrounds", pick("coalesce(p_playgrounds, 0) > 8000", "critical", "good"), pick("coalesce(p_playgrounds, 0) > 8000", "High", "Low")), ("popPerSports", "p_sports", GOOD, LOW), ("popPerClinic", "p_clinics", GOOD, LOW),
           ("facilityAccessScore", "fa", c3("fa"), pick("fa >= 60", "Low", "High")), ("communityDiversityScore", "di", pick("di >= 60", "good", "watch"), pick("di >= 60", "Low", "Medium")), ("familyDemandScore", "fm", pick("fm >= 60", "watch", "good"), pick("fm >= 60", "High", "Medium")),
           ("youthDemandScore", "yo", pick("yo >= 60", "watch", "good"), pick("yo >= 60", "High", "Medium")), ("olderAdultSupportScore", "ol", pick("ol >= 60", "good", "watch"), pick("ol >= 60", "Low", "Medium")),
           ("socialInfrastructureDeficitScore", "de", "CASE WHEN de >= 60 THEN 'critical' WHEN de >= 35 THEN 'watch' ELSE 'good' END", pick("de >= 60", "High", "Medium")), ("overallCommunityScore", "al", c3("al"), pick("al >= 60", "Low", "High")),
           *na_rows(["households", "avgHouseholdSize", "childrenPop", "youthPop", "workingAgePop", "olderAdultPop", "familyHouseholdShare", "nurseriesCount", "universitiesCount", "communityCentersCount", "librariesCount", "culturalFacilitiesCount", "popPerCommunityFacility"])]


@query("community_kpis", f"WITH {SCORED}, {COMM} {rows_sql('ck', CK_ROWS)}")
def _(spark, sf):
    return rp.community_kpis(scored(spark, sf), site_points(spark, sf))


def cbadge(c):
    return f"CASE WHEN {c} >= 80 THEN 'VERY HIGH' WHEN {c} >= 60 THEN 'HIGH' WHEN {c} >= 35 THEN 'MODERATE' WHEN {c} >= 15 THEN 'LOW' ELSE 'CRITICAL' END"


@query("community_summary", f"WITH {SCORED}, {COMM} SELECT park_id, {js('pop')} AS population_served, n_schools AS schools, n_mosques AS mosques, n_clinics + n_hospitals AS healthcare, {cbadge('fa')} AS access_status, {cbadge('fm')} AS family_status, al AS score, {cbadge('al')} AS status FROM ck")
def _(spark, sf):
    return rp.community_summary(rp.community_kpis(scored(spark, sf), site_points(spark, sf)))


@query("underserved_zones", f"WITH {SCORED}, {zone_sql('community_vulnerability_score * population')}, a AS (SELECT park_id, {js('sum(population)')} AS population, {js('avg(community_vulnerability_score)')} AS avg_vulnerability, concat_ws('|', CASE WHEN bool_and(playground_count = 0) THEN 'Playgrounds' END, CASE WHEN bool_and(sports_count = 0) THEN 'Sports Facilities' END, CASE WHEN bool_and(clinic_count = 0) THEN 'Clinics' END, CASE WHEN bool_and(green_coverage_pct < 5) THEN 'Green Space' END) AS facilities_missing, {js('avg(walking_time_to_park_minutes)', 1)} AS avg_walk_minutes FROM znt GROUP BY park_id) SELECT a.*, compass || ' Residential Edge' AS zone FROM a JOIN zn USING (park_id)")
def _(spark, sf):
    return rp.underserved_zones(scored(spark, sf)).withColumn("facilities_missing", F.array_join("facilities_missing", "|"))


CTX = f"ctx AS (SELECT park_id, {js('avg(heat_score)')} AS avg_heat, {js('avg(green_coverage_pct)', 1)} AS avg_green, {js('avg(walking_time_to_park_minutes)', 1)} AS avg_walk, {js('avg(' + norm('amenity_total', 20) + ')')} AS avg_access FROM sc GROUP BY park_id)"


@query("cross_context", f"WITH {SCORED}, {CTX} SELECT * FROM ctx")
def _(spark, sf):
    return rp.cross_context(scored(spark, sf))


@query("design_requirement_matrix", f"""WITH {SCORED}, {CTX}, {ENRICHED}, {COMPLAINTS},
r AS (SELECT c.*, ctx.* FROM complaints c LEFT JOIN ctx ON ctx.park_id = CAST(substr(c.place_id, 4) AS BIGINT) WHERE rank <= 12),
h AS (SELECT *, (issue_category = 'shade / heat comfort' AND (coalesce(avg_heat, 0) >= 55 OR coalesce(avg_green, 100) < 10)) OR (issue_category = 'playground' AND coalesce(avg_access, 100) < 50) OR (issue_category IN ('accessibility','parking') AND coalesce(avg_walk, 0) > 20) AS site_reinforced FROM r)
SELECT CAST(substr(place_id, 4) AS BIGINT) AS park_id, 'REQ-' || lpad(CAST(rank AS VARCHAR), 3, '0') AS id, issue_category AS topic, severity, site_reinforced, CASE WHEN severity = 'Critical' THEN 'Must Have' WHEN severity = 'High' AND site_reinforced THEN 'Must Have' WHEN severity = 'High' THEN 'High Priority' WHEN severity = 'Medium' THEN 'Medium Priority' ELSE 'Optional' END AS priority_class, mentions AS evidence_count, confidence FROM h""")
def _(spark, sf):
    return rv.design_requirement_matrix(rv.complaint_intelligence(review_parks_table(spark, sf), PARK), rp.cross_context(scored(spark, sf)), PARK)


def msum(names):
    return "(" + " + ".join(f"coalesce(max(review_count) FILTER (WHERE persona = {q(k)}), 0)" for k in names) + ")" if names else "0"


def havg(names):
    return f"(SELECT avg(score) FROM health h WHERE h.place_id = t.place_id AND key IN ({', '.join(q(k) for k in names)}))" if names else "50e0"


EVID = "tot AS (SELECT place_id, count(*) AS n FROM enriched GROUP BY place_id), pj AS (SELECT tot.place_id, n, persona, review_count FROM tot LEFT JOIN personas USING (place_id))"


def _age_sql():
    out = []
    for k, pers, fac, hs in rp.AGE_GROUPS:
        fs = f"(SELECT sum(n) FROM fac f WHERE f.park_id = CAST(substr(t.place_id, 4) AS BIGINT) AND f.key IN ({', '.join(q(x) for x in fac)}))"
        out.append(f"SELECT CAST(substr(place_id, 4) AS BIGINT) AS park_id, {q(k)} AS age_group, CAST(pn AS BIGINT) AS persona_reviews_n, {js(norm('pn / CAST(n AS DOUBLE) * 100e0', 40) + ' * 0.45e0 + coalesce(' + havg(hs) + ', 50e0) * 0.3e0 + coalesce(' + norm(fs, 100) + ' + CASE WHEN ' + fs + ' IS NULL THEN NULL ELSE 0e0 END, 50e0) * 0.25e0')} AS demand_score FROM (SELECT place_id, n, {msum(pers)} AS pn FROM pj GROUP BY place_id, n) t")
    return " UNION ALL ".join(out)


def evidence(spark, sf):
    r = review_parks_table(spark, sf)
    return rp.review_evidence(rv.persona_analytics(r, PARK), rv.health_score(r, PARK), r.groupBy("park_id").agg(F.count(F.lit(1)).alias("n")), PARK)


@query("age_group_demand", f"WITH {CELLS}, {PTS}, {FAC}, {ENRICHED}, {PERS}, {HEALTH}, {EVID}, ag AS ({_age_sql()}) SELECT *, CASE WHEN demand_score >= 75 THEN 'Very High' WHEN demand_score >= 50 THEN 'High' WHEN demand_score >= 25 THEN 'Moderate' ELSE 'Low' END AS demand_level FROM ag")
def _(spark, sf):
    fac = rp.facility_stats(ad.cells(spark, sf), site_points(spark, sf)).filter("loaded").groupBy("park_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("facilities"))
    return rp.age_group_demand(evidence(spark, sf), fac, PARK)


def _prog_sql():
    out = []
    for p in PLANNING_PROGRAMS:
        out.append(f"SELECT CAST(substr(place_id, 4) AS BIGINT) AS park_id, {q(p['key'])} AS program, {js(norm('pn / CAST(n AS DOUBLE) * 100e0', 30) + ' * 0.55e0 + (100e0 - coalesce(' + havg(p['health']) + ', 50e0)) * 0.45e0')} AS demand_score, least(90e0, 40e0 + pn * 3e0 + {10.0 * len(p['health'])}e0) AS confidence FROM (SELECT place_id, n, {msum(p['personas'])} AS pn FROM pj GROUP BY place_id, n) t")
    return " UNION ALL ".join(out)


@query("program_demand", f"WITH {ENRICHED}, {PERS}, {HEALTH}, {EVID}, pg AS ({_prog_sql()}) SELECT *, CASE WHEN demand_score >= 75 THEN 'Very High' WHEN demand_score >= 50 THEN 'High' WHEN demand_score >= 25 THEN 'Medium' ELSE 'Low' END AS priority FROM pg")
def _(spark, sf):
    return rp.program_demand(evidence(spark, sf), PARK)


RULES = [("facilityAccessScore", ">=", 60, "strength", "good facility access"), ("facilityAccessScore", "<", 35, "weakness", "poor facility access"), ("communityDiversityScore", ">=", 60, "strength", "diverse facilities"),
         ("familyDemandScore", ">=", 60, "weakness", "unmet family demand"), ("overallCommunityScore", "<", 60, "weakness", "community score below target")]


@query("threshold_findings", f"WITH {SCORED}, {COMM}, m AS ({rows_sql('ck', CK_ROWS)}), r AS (SELECT * FROM (VALUES {values_list(RULES)}) v(key, op, threshold, kind, finding)) SELECT park_id, m.key, value, kind, finding FROM m JOIN r USING (key) WHERE CASE WHEN op = '>=' THEN value >= threshold ELSE value < threshold END")
def _(spark, sf):
    return rp.threshold_findings(rp.community_kpis(scored(spark, sf), site_points(spark, sf)), RULES)


@query("review_signal_cells", f"""WITH {CELLS}, {ENRICHED}, tr AS (SELECT CAST(substr(place_id, 4) AS BIGINT) AS park_id, issue_category AS category, count(*) / CAST(sum(count(*)) OVER (PARTITION BY place_id) AS DOUBLE) AS rate FROM enriched GROUP BY place_id, issue_category),
t AS (SELECT park_id, sum(population) AS p, count(*) AS n FROM cells GROUP BY park_id) SELECT c.park_id, h3_id, category, {js(norm('population / coalesce(nullif(p, 0e0), 1e0) * rate * 100e0 * n', 100))} AS review_signal FROM cells c JOIN t USING (park_id) JOIN tr USING (park_id)""")
def _(spark, sf):
    rates = rv.issue_impact(review_parks(spark, sf), PARK).select("park_id", F.col("issue_category").alias("category"), F.col("mention_share").alias("rate"))
    return cl.review_signal(ad.cells(spark, sf), rates).select("park_id", "h3_id", "category", "review_signal")


_pick = lambda keys: ", ".join(f"max(CASE WHEN key = {q(k)} THEN value END) AS \"{k}\"" for k in keys)


@query("gis_summary", f"""WITH p AS ({ORACLE['population_kpis']}), u AS ({ORACLE['urban_kpis']}), a AS ({ORACLE['accessibility_kpis']}),
e AS (SELECT park_id, {_pick(['greenCoveragePct', 'hotspotAreaPct', 'overallEnvironmentalScore'])} FROM ({ORACLE['environmental_kpis']}) GROUP BY park_id),
c AS (SELECT park_id, {_pick(['schoolsCount', 'facilityAccessScore', 'overallCommunityScore'])} FROM ({ORACLE['community_kpis']}) GROUP BY park_id)
SELECT p.park_id, total_population, aggregate_density, daily_users, building_coverage_pct, impervious_pct, development_intensity, connectivity, dominant_land_use, accessibility_score, pop_15min AS pop_15min_walk, status AS access_status,
e.* EXCLUDE (park_id), c.* EXCLUDE (park_id), {js('pop_15min / nullif(total_population, 0e0) * 100e0', 1)} AS pop_15min_walk_pct FROM p LEFT JOIN u USING (park_id) LEFT JOIN a USING (park_id) LEFT JOIN e USING (park_id) LEFT JOIN c USING (park_id)""")
def _(spark, sf):
    s, env = environment(spark, sf)
    r, pts = roads_summary(spark, sf), site_points(spark, sf)
    return rp.gis_summary(rp.population_kpis(s), rp.urban_kpis(s, r), rp.accessibility_kpis(s, pts, r), env, rp.community_kpis(s, pts))


@query("community_program_export", f"WITH {ENRICHED}, {PERS}, {HEALTH}, {EVID}, pg AS ({_prog_sql()}), ar AS (SELECT program, CAST(a AS DOUBLE) AS min_area, CAST(b AS DOUBLE) AS target_area, CAST(c AS DOUBLE) AS max_area FROM (VALUES {values_list([(p['key'], *p['area']) for p in PLANNING_PROGRAMS])}) v(program, a, b, c)) SELECT park_id, program, min_area, target_area, max_area, {js('demand_score / 100e0', 2)} AS priority, {js('demand_score / 100e0', 3)} AS community_demand_score FROM pg JOIN ar USING (program)")
def _(spark, sf):
    return xp.community_programs(rp.program_demand(evidence(spark, sf), PARK).select("park_id", "program", "demand_score"))


@query("review_summary_complaints", f"WITH {ENRICHED}, {COMPLAINTS} SELECT place_id, rank, issue_category, severity, mentions, confidence FROM complaints WHERE rank <= 8")
def _(spark, sf):
    return rv.review_summary(written_table(enriched(spark, sf)))["complaints"].select("place_id", "rank", "issue_category", "severity", "mentions", "confidence")
