"""Registered entrance-candidate queries with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import js_round
from ..operators import access as ac
from ..functions.session import cut_lineage, written_table
from ..operators.spatial import rounded
from ..sources import adapters as ad
from .registry import query
from .spatial_queries import BLDG, M, PATHS, SITES, XY
from .sqlbase import CELLS, js

SPACING, RADIUS, ROAD_MAX = 40.0, 600.0, 60.0


def _planar_sites(spark, sf):
    return ad.sites(spark, sf).select("park_id", "site_id", F.transform("ring", lambda p: F.struct(((p["lng"] - ad.LNG0) * M).alias("x"), ((p["lat"] - ad.LAT0) * M).alias("y"))).alias("ring"))


def _pts(spark, sf, layer):
    x, y = (F.col("lng") - ad.LNG0) * M, (F.col("lat") - ad.LAT0) * M
    return ad.points(spark, sf).filter(F.col("layer") == layer).select("park_id", "feature_id", x.alias("ax"), y.alias("ay"), x.alias("bx"), y.alias("by"))


def _building_segments(spark, sf):
    b = ad.buildings(spark, sf)
    c = F.concat("poly", F.slice("poly", 1, 1))
    seg = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(F.get(c, i)["x"].alias("ax"), F.get(c, i)["y"].alias("ay"), F.get(c, i + 1)["x"].alias("bx"), F.get(c, i + 1)["y"].alias("by")))
    return b.select("park_id", "building_id", F.inline(seg))


def _cells(spark, sf):
    return ad.cells(spark, sf).select("park_id", "h3_id", ((F.col("lng") - ad.LNG0) * M).alias("x"), ((F.col("lat") - ad.LAT0) * M).alias("y"), "population", "intersection_count_hex", "barrier_score_hex")


def metrics(spark, sf):
    cand = cut_lineage(ac.boundary_candidates(_planar_sites(spark, sf), SPACING))
    mem = ac.catchment(cand, _cells(spark, sf), RADIUS)
    m = ac.candidate_metrics(cand, mem, ad.paths(spark, sf), _pts(spark, sf, "schools"), _building_segments(spark, sf), _pts(spark, sf, "bus_stops"), RADIUS)
    return cut_lineage(ac.candidate_normalise(ac.candidate_exclusions(m, ROAD_MAX))), mem


SX = f"(min_lng - {ad.LNG0}e0) * {M}e0 AS x0, (min_lat - {ad.LAT0}e0) * {M}e0 AS y0, (max_lng - {ad.LNG0}e0) * {M}e0 AS x1, (max_lat - {ad.LAT0}e0) * {M}e0 AS y1"


def segd(ax, ay, bx, by, px="c.x", py="c.y"):
    t = f"greatest(0e0, least(1e0, (({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / (pow({bx} - {ax}, 2) + pow({by} - {ay}, 2))))"
    return f"CASE WHEN pow({bx} - {ax}, 2) + pow({by} - {ay}, 2) = 0 THEN sqrt(pow({px} - {ax}, 2) + pow({py} - {ay}, 2)) ELSE sqrt(pow({px} - ({ax} + {t} * ({bx} - {ax})), 2) + pow({py} - ({ay} + {t} * ({by} - {ay})), 2)) END"


CAND = f"""{SITES}, sx AS (SELECT park_id, site_id, {SX} FROM sites),
ed AS (SELECT park_id, site_id, 1 AS edge, x0 AS ax, y0 AS ay, x1 AS bx, y0 AS yb FROM sx UNION ALL SELECT park_id, site_id, 2, x1, y0, x1, y1 FROM sx UNION ALL SELECT park_id, site_id, 3, x1, y1, x0, y1 FROM sx UNION ALL SELECT park_id, site_id, 4, x0, y1, x0, y0 FROM sx),
en AS (SELECT *, greatest(1, CAST(ceil(sqrt(pow(bx - ax, 2) + pow(yb - ay, 2)) / {SPACING}e0) AS INTEGER)) AS n FROM ed), ei AS (SELECT *, unnest(range(1, n + 1)) AS idx FROM en),
cand AS (SELECT park_id, site_id, edge, CAST(idx AS INTEGER) AS index, (idx - 0.5e0) / n AS t, ax + (bx - ax) * ((idx - 0.5e0) / n) AS x, ay + (yb - ay) * ((idx - 0.5e0) / n) AS y, 'access-edge-' || site_id || '-' || edge || '-' || idx AS candidate_id FROM ei)"""


@query("boundary_candidates", f"WITH {CAND} SELECT park_id, site_id, edge, index, candidate_id, {js('t', 6)} AS t, {js('x', 3)} AS x, {js('y', 3)} AS y FROM cand")
def _(spark, sf):
    return rounded(ac.boundary_candidates(_planar_sites(spark, sf), SPACING), ["x", "y"], 3).withColumn("t", js_round("t", 6))


METR = f"""{CELLS}, {PATHS}, {BLDG}, {CAND}, cxy AS (SELECT park_id, h3_id, population, intersection_count_hex, barrier_score_hex, {XY} FROM cells),
bseg AS (SELECT park_id, building_id, unnest([{{'a': bx0, 'b': by0, 'c': bx1, 'd': by0}}, {{'a': bx1, 'b': by0, 'c': bx1, 'd': by1}}, {{'a': bx1, 'b': by1, 'c': bx0, 'd': by1}}, {{'a': bx0, 'b': by1, 'c': bx0, 'd': by0}}]) AS s FROM (SELECT p_partkey AS building_id, p_partkey // 1200 AS park_id, CAST((p_partkey*373) % 11000 AS DOUBLE) AS bx0, CAST((p_partkey*197) % 9900 AS DOUBLE) AS by0, CAST((p_partkey*373) % 11000 AS DOUBLE) + 10e0 + p_size AS bx1, CAST((p_partkey*197) % 9900 AS DOUBLE) + CAST(10 + (p_partkey*7) % 60 AS DOUBLE) AS by1 FROM part)),
nr AS (SELECT c.candidate_id, min({segd('p.ax', 'p.ay', 'p.bx', 'p.yb')}) AS nearest_road_m FROM cand c JOIN paths p USING (park_id) GROUP BY ALL),
ns AS (SELECT c.candidate_id, min(sqrt(pow(c.x - p.x, 2) + pow(c.y - p.y, 2))) AS nearest_school_m, count(*) FILTER (WHERE sqrt(pow(c.x - p.x, 2) + pow(c.y - p.y, 2)) <= {RADIUS}) AS schools_within FROM cand c JOIN pxy p USING (park_id) WHERE p.layer = 'schools' GROUP BY ALL),
nu AS (SELECT c.candidate_id, min(sqrt(pow(c.x - p.x, 2) + pow(c.y - p.y, 2))) AS nearest_bus_m FROM cand c JOIN pxy p USING (park_id) WHERE p.layer = 'bus_stops' GROUP BY ALL),
nb0 AS (SELECT c.candidate_id, building_id, min({segd('s.a', 's.b', 's.c', 's.d')}) AS d FROM cand c JOIN bseg USING (park_id) GROUP BY ALL), nb AS (SELECT candidate_id, min(d) AS nearest_building_m, count(*) FILTER (WHERE d <= {RADIUS}) AS buildings_within FROM nb0 GROUP BY ALL),
mem AS (SELECT c.park_id, c.site_id, c.candidate_id, k.h3_id, sqrt(pow(c.x - k.x, 2) + pow(c.y - k.y, 2)) AS d, population, intersection_count_hex, barrier_score_hex FROM cand c JOIN cxy k USING (park_id) WHERE sqrt(pow(c.x - k.x, 2) + pow(c.y - k.y, 2)) <= {RADIUS}),
ma AS (SELECT candidate_id, sum(population * greatest(0e0, 1e0 - d / {RADIUS}e0)) AS population_pull, sum(population) AS population_within, sum(intersection_count_hex) AS intersections, avg(barrier_score_hex) AS avg_barrier FROM mem GROUP BY ALL),
mt AS (SELECT c.*, nearest_road_m, nearest_school_m, nearest_building_m, nearest_bus_m, coalesce(population_pull, 0e0) AS population_pull, coalesce(population_within, 0e0) AS population_within, coalesce(intersections, 0e0) AS intersections, avg_barrier, coalesce(schools_within, 0) AS schools_within, coalesce(buildings_within, 0) AS buildings_within
 FROM cand c LEFT JOIN nr USING (candidate_id) LEFT JOIN ns USING (candidate_id) LEFT JOIN nb USING (candidate_id) LEFT JOIN nu USING (candidate_id) LEFT JOIN ma USING (candidate_id)),
ex AS (SELECT *, concat_ws('|', CASE WHEN nearest_road_m IS NULL OR nearest_road_m > {ROAD_MAX} THEN 'not_within_approved_road_edge_distance' END, CASE WHEN nearest_school_m IS NOT NULL AND (nearest_road_m IS NULL OR nearest_school_m < nearest_road_m) THEN 'school_facing_edge' END,
 CASE WHEN nearest_building_m IS NOT NULL AND (nearest_road_m IS NULL OR nearest_building_m < nearest_road_m) THEN 'building_facing_edge' END) AS hard_exclusions FROM mt),
nz AS (SELECT *, hard_exclusions = '' AS eligible, {', '.join(f"CASE WHEN {m} IS NULL THEN 0e0 ELSE {'1e0 - ' if inv else ''}CASE WHEN max({m}) OVER w = min({m}) OVER w THEN 1e0 ELSE ({m} - min({m}) OVER w) / (max({m}) OVER w - min({m}) OVER w) END END AS {o}" for m, o, inv in ac.NORMALISED)} FROM ex WINDOW w AS (PARTITION BY park_id, site_id)),
sh AS (SELECT a.candidate_id AS a, b.candidate_id AS b, sum(a.population) AS shared FROM mem a JOIN mem b ON a.park_id = b.park_id AND a.site_id = b.site_id AND a.h3_id = b.h3_id AND a.candidate_id <> b.candidate_id GROUP BY ALL),
pa0 AS (SELECT a.park_id, a.site_id, a.candidate_id AS candidate_a, b.candidate_id AS candidate_b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS distance_m, a.edge = b.edge AS same_edge, a.population_within AS pa, b.population_within AS pb, coalesce(shared, 0e0) AS shared
 FROM nz a JOIN nz b ON a.park_id = b.park_id AND a.site_id = b.site_id AND a.eligible AND b.eligible AND (a.edge < b.edge OR (a.edge = b.edge AND a.index < b.index)) LEFT JOIN sh ON sh.a = a.candidate_id AND sh.b = b.candidate_id),
pairs AS (SELECT park_id, site_id, candidate_a, candidate_b, distance_m, same_edge, CASE WHEN pa + pb - shared > 0 THEN shared / (pa + pb - shared) ELSE 0e0 END AS overlap_ratio, pa - shared AS additional_a, pb - shared AS additional_b, pa + pb - shared AS combined_population FROM pa0)"""


@query("candidate_metrics", f"WITH {METR} SELECT candidate_id, hard_exclusions, eligible, population_within, intersections, CAST(schools_within AS BIGINT) AS schools_within, CAST(buildings_within AS BIGINT) AS buildings_within, "
       + ", ".join(f"{js(c, 4)} AS {c}" for c in ("nearest_road_m", "nearest_school_m", "nearest_building_m", "nearest_bus_m", "population_pull", "avg_barrier")) + ", " + ", ".join(f"{js(o, 4)} AS {o}" for _, o, _ in ac.NORMALISED) + " FROM nz")
def _(spark, sf):
    m, _ = metrics(spark, sf)
    cols = ["nearest_road_m", "nearest_school_m", "nearest_building_m", "nearest_bus_m", "population_pull", "avg_barrier", *[o for _, o, _ in ac.NORMALISED]]
    return m.select("candidate_id", F.array_join("hard_exclusions", "|").alias("hard_exclusions"), "eligible", "population_within", "intersections", "schools_within", "buildings_within", *[js_round(c, 4).alias(c) for c in cols])


@query("candidate_pairs", f"WITH {METR} SELECT candidate_a, candidate_b, {js('distance_m', 3)} AS distance_m, same_edge, {js('overlap_ratio', 6)} AS overlap_ratio, additional_a, additional_b, combined_population FROM pairs")
def _(spark, sf):
    m, mem = metrics(spark, sf)
    return ac.candidate_pairs(m, mem).select("candidate_a", "candidate_b", js_round("distance_m", 3).alias("distance_m"), "same_edge", js_round("overlap_ratio", 6).alias("overlap_ratio"), "additional_a", "additional_b", "combined_population")


@query("candidate_summary", f"WITH {METR}, pc AS (SELECT park_id, site_id, count(*) AS pairs FROM pairs GROUP BY ALL) SELECT n.park_id, n.site_id, count(*) AS candidates, count(*) FILTER (WHERE eligible) AS eligible, count(*) FILTER (WHERE contains(hard_exclusions, 'school')) AS school_facing, count(*) FILTER (WHERE contains(hard_exclusions, 'building')) AS building_facing, coalesce(any_value(pairs), 0) AS pairs FROM nz n LEFT JOIN pc ON pc.park_id = n.park_id AND pc.site_id = n.site_id GROUP BY n.park_id, n.site_id")
def _(spark, sf):
    m, mem = metrics(spark, sf)
    return ac.candidate_summary(m, ac.candidate_pairs(m, mem))


COMBO = f"""{METR}, bo AS (SELECT park_id, site_id, candidate_a AS main, candidate_b AS secondary, additional_b AS ad, distance_m, overlap_ratio, combined_population FROM pairs UNION ALL SELECT park_id, site_id, candidate_b, candidate_a, additional_a, distance_m, overlap_ratio, combined_population FROM pairs),
combo AS (SELECT b.park_id, b.site_id, main, secondary, s.candidate_id AS service, {js('-combined_population', 6)} AS o_combined, {js('-ad', 6)} AS o_additional, {js('overlap_ratio', 6)} AS o_overlap, {js('-distance_m', 6)} AS o_separation, {js('-(m.transit_norm + c.transit_norm)', 6)} AS o_transit,
 {js('-(m.intersection_norm + c.intersection_norm)', 6)} AS o_intersections, {js('-s.road_norm', 6)} AS o_service_road, {js('-(m.barrier_norm + c.barrier_norm + s.barrier_norm) / 3e0', 6)} AS o_low_barrier
 FROM bo b JOIN nz m ON m.candidate_id = main JOIN nz c ON c.candidate_id = secondary JOIN nz s ON s.park_id = b.park_id AND s.site_id = b.site_id AND s.eligible AND s.candidate_id <> main AND s.candidate_id <> secondary)"""


def combos(spark, sf):
    m, mem = metrics(spark, sf)
    return rounded(ac.evaluate_combinations(ac.candidate_pairs(m, mem), m), ac.OBJECTIVES, 6)


@query("entrance_combinations", f"WITH {COMBO} SELECT * FROM combo")
def _(spark, sf):
    return combos(spark, sf)


@query("non_dominated_combinations", f"WITH {COMBO} SELECT * FROM combo a WHERE NOT EXISTS (SELECT 1 FROM combo b WHERE b.park_id = a.park_id AND b.site_id = a.site_id AND " + " AND ".join(f"b.{o} <= a.{o}" for o in ac.OBJECTIVES) + " AND (" + " OR ".join(f"b.{o} < a.{o}" for o in ac.OBJECTIVES) + "))")
def _(spark, sf):
    m, mem = metrics(spark, sf)
    m = cut_lineage(m)
    pairs = cut_lineage(ac.candidate_pairs(m, mem))
    tried = ac.evaluate_combinations(pairs, m, services=ac.service_choices(pairs, m, margin=1e-6))
    return ac.non_dominated(written_table(rounded(tried, ac.OBJECTIVES, 6)))
