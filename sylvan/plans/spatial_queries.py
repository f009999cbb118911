"""Registered spatial and graph queries with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..functions.formulas import CIRCULATION
from ..functions.numeric import js_round
from ..operators import cells as cl
from ..operators import graph as gr
from ..operators import spatial as sp
from ..sources import adapters as ad
from .registry import query
from .site_queries import SCORED, tier_sql, scored
from .sqlbase import CELLS, HAVERSINE_ETL_R, POINTS, ROADS, haversine, js, q

P = ["park_id"]
INSIDE = "p.lng >= c.min_lng AND p.lng < c.max_lng AND p.lat >= c.min_lat AND p.lat < c.max_lat"
M = ad.M_PER_DEG
XY = f"(lng - {ad.LNG0}e0) * {M}e0 AS x, (lat - {ad.LAT0}e0) * {M}e0 AS y"


@query("center_distance", f"WITH {POINTS} SELECT feature_id, {js(haversine('55.2201e0', '25.1552e0', 'lng', 'lat'), 3)} AS m, {js(haversine('55.2201e0', '25.1552e0', 'lng', 'lat', HAVERSINE_ETL_R), 3)} AS m_etl FROM points")
def _(spark, sf):
    c = (F.lit(ad.CENTER[0]), F.lit(ad.CENTER[1]))
    return ad.points(spark, sf).select("feature_id", js_round(geo.haversine_m(*c, "lng", "lat"), 3).alias("m"), js_round(geo.haversine_m(*c, "lng", "lat", geo.R_EARTH - 8.8), 3).alias("m_etl"))


@query("points_to_cells", f"WITH {CELLS}, {POINTS} SELECT p.park_id, feature_id, min(h3_id) AS h3_id FROM points p JOIN cells c ON p.park_id = c.park_id AND {INSIDE} GROUP BY ALL")
def _(spark, sf):
    return sp.assign_points_to_polygons(ad.points(spark, sf), ad.cell_polygons(spark, sf))


@query("facility_counts_per_cell", f"WITH {CELLS}, {POINTS} SELECT p.park_id, h3_id, layer, count(*) AS n FROM points p JOIN cells c ON p.park_id = c.park_id AND {INSIDE} GROUP BY ALL")
def _(spark, sf):
    pts = ad.points(spark, sf)
    hit = sp.assign_points_to_polygons(pts, ad.cell_polygons(spark, sf))
    return hit.join(pts.select("feature_id", "layer"), "feature_id").groupBy("park_id", "h3_id", "layer").agg(F.count(F.lit(1)).alias("n"))


NODEXY = f"{ad.LNG0}e0 + (v % 25) / 250e0 AS lng, {ad.LAT0}e0 + (v // 25) / 250e0 AS lat"


@query("road_length_per_cell", f"WITH {CELLS}, {ROADS}, p AS (SELECT *, {NODEXY} FROM roads), s AS (SELECT p.park_id, h3_id, sum(length) AS l FROM p JOIN cells c ON p.park_id = c.park_id AND {INSIDE} GROUP BY ALL) SELECT c.park_id, c.h3_id, coalesce(l, 0e0) AS real_road_length_m, coalesce(l / hex_area_km2, 0e0) AS real_road_density_m_per_km2 FROM cells c LEFT JOIN s ON s.park_id = c.park_id AND s.h3_id = c.h3_id")
def _(spark, sf):
    return sp.length_per_cell(ad.road_shapes(spark, sf), ad.cell_polygons(spark, sf))


HV = haversine("c.lng", "c.lat", "p.lng", "p.lat")


@query("nearest_bus_stop", f"WITH {CELLS}, {POINTS} SELECT c.park_id, h3_id, {js(f'min({HV})', 3)} AS distance FROM cells c LEFT JOIN (SELECT * FROM points WHERE layer = 'bus_stops') p ON p.park_id = c.park_id GROUP BY ALL")
def _(spark, sf):
    stops = ad.points(spark, sf).filter(F.col("layer") == "bus_stops")
    return sp.nearest_point(ad.cell_polygons(spark, sf), stops).select("park_id", "h3_id", js_round("distance", 3).alias("distance"))


@query("facilities_within_300m", f"WITH {CELLS}, {POINTS} SELECT c.park_id, h3_id, count(p.feature_id) AS n FROM cells c LEFT JOIN points p ON p.park_id = c.park_id AND abs(p.lat - c.lat) < 0.01e0 AND {HV} <= 300 GROUP BY ALL")
def _(spark, sf):
    return sp.count_within_radius(ad.cell_polygons(spark, sf), ad.points(spark, sf), 300.0)


@query("footprint_centroids", f"SELECT s_suppkey, {js('a * 5e0 / 6e0', 6)} AS x, {js('b * 5e0 / 6e0', 6)} AS y, {js('3e0 * a * b', 3)} AS area FROM (SELECT s_suppkey, 1e0 + s_suppkey % 40 AS a, 2e0 + s_nationkey AS b FROM supplier)")
def _(spark, sf):
    # L-shaped footprints: the centre of the area is not the mean of the corners
    a, b = F.lit(1.0) + F.col("s_suppkey") % 40, F.lit(2.0) + F.col("s_nationkey")
    corners = [(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2), (0, 0)]
    ring = F.array(*[F.struct((a * float(i)).alias("x"), (b * float(j)).alias("y")) for i, j in corners])
    d = ad.table(spark, sf, "supplier").select("s_suppkey", ring.alias("ring"))
    return d.select("s_suppkey", geo.area_centroid("ring").alias("c"), geo.shoelace_area("ring").alias("area")).select("s_suppkey", js_round("c.x", 6).alias("x"), js_round("c.y", 6).alias("y"), js_round("area", 3).alias("area"))


@query("cell_geometry", f"WITH {CELLS}, k AS (SELECT h3_id, min_lng, min_lat, max_lng, max_lat, (max_lng - min_lng) * {M}e0 AS w, (max_lat - min_lat) * {M}e0 AS h FROM cells) SELECT h3_id, {js('(min_lng + max_lng) / 2e0', 6)} AS lng, {js('(min_lat + max_lat) / 2e0', 6)} AS lat, {js('w * h', 2)} AS area, {js('2e0 * (w + h)', 3)} AS perimeter, CASE WHEN w > h THEN 0e0 ELSE 90e0 END AS axis FROM k")
def _(spark, sf):
    c = ad.cell_polygons(spark, sf)
    planar = F.transform("ring", lambda p: F.struct(((p["lng"] - ad.LNG0) * M).alias("x"), ((p["lat"] - ad.LAT0) * M).alias("y")))
    c = c.select("h3_id", geo.ring_centroid("ring").alias("ce"), planar.alias("pl"))
    return c.select("h3_id", js_round("ce.lng", 6).alias("lng"), js_round("ce.lat", 6).alias("lat"), js_round(geo.shoelace_area("pl"), 2).alias("area"), js_round(geo.ring_perimeter("pl"), 3).alias("perimeter"),
                    js_round(geo.principal_axis_deg("pl")).alias("axis"))


_A, _F = 6378137.0, 1 / 298.257223563
_E2 = _F * (2 - _F)
_EP = _E2 / (1 - _E2)


def _d(x):
    return f"CAST('{x!r}' AS DOUBLE)"


UTM = f"""ut0 AS (SELECT *, radians(lat) AS phi, cos(radians(lat)) * (radians(lng) - radians(57e0)) AS a, pow(tan(radians(lat)), 2) AS t, {_d(_EP)} * pow(cos(radians(lat)), 2) AS c,
 {_d(_A)} / sqrt(1e0 - {_d(_E2)} * pow(sin(radians(lat)), 2)) AS n FROM {{src}}),
utm AS (SELECT *, {js(f'0.9996e0 * n * (a + (1e0 - t + c) * pow(a, 3) / 6e0 + (5e0 - 18e0 * t + t * t + 72e0 * c - {_d(58 * _EP)}) * pow(a, 5) / 120e0) + 500000e0', 2)} AS x,
 {js(f"0.9996e0 * ({_d(_A)} * ({_d(1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256)} * phi - {_d(3 * _E2 / 8 + 3 * _E2**2 / 32 + 45 * _E2**3 / 1024)} * sin(2e0 * phi) + {_d(15 * _E2**2 / 256 + 45 * _E2**3 / 1024)} * sin(4e0 * phi) - {_d(35 * _E2**3 / 3072)} * sin(6e0 * phi)) + n * tan(phi) * (a * a / 2e0 + (5e0 - t + 9e0 * c + 4e0 * c * c) * pow(a, 4) / 24e0 + (61e0 - 58e0 * t + t * t + 600e0 * c - {_d(330 * _EP)}) * pow(a, 6) / 720e0))", 2)} AS y FROM ut0)"""


@query("points_utm", f"WITH {POINTS}, {UTM.replace('{src}', 'points')} SELECT feature_id, x, y FROM utm")
def _(spark, sf):
    x, y = geo.to_utm("lng", "lat")
    return ad.points(spark, sf).select("feature_id", x.alias("x"), y.alias("y"))


PATHS = f"{POINTS}, pxy AS (SELECT *, {XY} FROM points), paths AS (SELECT park_id, feature_id AS segment_id, CASE WHEN feature_id % 6 = 0 THEN 'footway' ELSE 'residential' END AS highway, x AS ax, y AS ay, x + (feature_id % 13 - 6) * 10 AS bx, y + (feature_id % 7 - 3) * 10 AS yb FROM pxy)"
SEGD = "CASE WHEN pow(bx - ax, 2) + pow(yb - ay, 2) = 0 THEN sqrt(pow(c.x - ax, 2) + pow(c.y - ay, 2)) ELSE sqrt(pow(c.x - (ax + tt * (bx - ax)), 2) + pow(c.y - (ay + tt * (yb - ay)), 2)) END"


@query("distance_to_path", f"""WITH {CELLS}, {PATHS}, cx AS (SELECT park_id, h3_id, {XY} FROM cells),
j AS (SELECT c.park_id, c.h3_id, c.x, c.y, ax, ay, bx, yb, greatest(0e0, least(1e0, ((c.x - ax) * (bx - ax) + (c.y - ay) * (yb - ay)) / nullif(pow(bx - ax, 2) + pow(yb - ay, 2), 0))) AS tt FROM cx c LEFT JOIN paths p ON p.park_id = c.park_id)
SELECT park_id, h3_id, {js('min(' + SEGD + ')', 3)} AS distance FROM j c GROUP BY ALL""")
def _(spark, sf):
    c = ad.cell_polygons(spark, sf).select("park_id", "h3_id", ((F.col("lng") - ad.LNG0) * M).alias("x"), ((F.col("lat") - ad.LAT0) * M).alias("y"))
    return sp.nearest_segment(c, ad.paths(spark, sf), "h3_id", "segment_id").select("park_id", "h3_id", js_round("distance", 3).alias("distance"))


@query("layer_manifest", f"WITH {POINTS} SELECT park_id, layer, count(*) AS features, min(lng) AS min_lng, min(lat) AS min_lat, max(lng) AS max_lng, max(lat) AS max_lat FROM points GROUP BY ALL")
def _(spark, sf):
    return sp.layer_extent(ad.points(spark, sf), group_cols=P)


@query("bbox_filter", f"WITH {POINTS}, h AS (SELECT * FROM points WHERE lng >= 55.18e0 AND lng <= 55.22e0 AND lat >= 25.12e0 AND lat <= 25.16e0) SELECT feature_id, layer, (SELECT count(*) FROM h) AS matched_count, false AS truncated FROM h")
def _(spark, sf):
    p = ad.points(spark, sf).withColumns({"min_lng": F.col("lng"), "max_lng": F.col("lng"), "min_lat": F.col("lat"), "max_lat": F.col("lat")})
    return sp.bbox_filter(p, (55.18, 25.12, 55.22, 25.16)).select("feature_id", "layer", "matched_count", "truncated")


BOXES = f"bxs AS (SELECT park_id, h3_id, (min_lng - {ad.LNG0}e0) * {M}e0 AS x0, (min_lat - {ad.LAT0}e0) * {M}e0 AS y0 FROM cells), boxes AS (SELECT *, x0 + 100e0 AS x1, y0 + 100e0 AS y1 FROM bxs)"
BLDG = "bl0 AS (SELECT p_partkey // 1200 AS park_id, CAST((p_partkey*373) % 11000 AS DOUBLE) AS bx0, CAST((p_partkey*197) % 9900 AS DOUBLE) AS by0, 10e0 + p_size AS w, CAST(10 + (p_partkey*7) % 60 AS DOUBLE) AS h FROM part), bldg AS (SELECT *, bx0 + w AS bx1, by0 + h AS by1 FROM bl0)"


@query("building_overlap", f"WITH {CELLS}, {BOXES}, {BLDG}, a AS (SELECT c.park_id, h3_id, sum((least(x1, bx1) - greatest(x0, bx0)) * (least(y1, by1) - greatest(y0, by0))) AS a FROM boxes c JOIN bldg b ON b.park_id = c.park_id AND bx0 < x1 AND bx1 > x0 AND by0 < y1 AND by1 > y0 GROUP BY ALL) SELECT c.park_id, c.h3_id, {js('coalesce(a, 0e0)', 4)} AS building_area_m2, {js('coalesce(least(100e0, a / ((x1 - x0) * (y1 - y0)) * 100e0), 0e0)', 4)} AS building_coverage_pct FROM boxes c LEFT JOIN a USING (park_id, h3_id)")
def _(spark, sf):
    return sp.rounded(sp.building_overlap(ad.boxes(spark, sf), ad.buildings(spark, sf)), ["building_area_m2", "building_coverage_pct"], 4)


@query("road_length_in_buffer", f"""WITH {CELLS}, {BOXES}, {PATHS}, l AS (SELECT *, sqrt(pow(bx - ax, 2) + pow(yb - ay, 2)) AS len FROM paths WHERE highway <> 'footway'), l2 AS (SELECT *, greatest(2, CAST(ceil(len / 5e0) AS INTEGER)) AS n FROM l WHERE len > 0),
s0 AS (SELECT park_id, ax, ay, bx, yb, n, len / (n + 1) AS w, unnest(range(0, n + 1)) AS i FROM l2), s AS (SELECT park_id, w, ax + (bx - ax) * (i / CAST(n AS DOUBLE)) AS sx, ay + (yb - ay) * (i / CAST(n AS DOUBLE)) AS sy FROM s0),
a AS (SELECT c.park_id, h3_id, sum(w) AS l FROM boxes c JOIN s ON s.park_id = c.park_id AND sx >= x0 - 20 AND sx <= x1 + 20 AND sy >= y0 - 20 AND sy <= y1 + 20 AND pow(greatest(x0 - sx, 0e0, sx - x1), 2) + pow(greatest(y0 - sy, 0e0, sy - y1), 2) <= 400 GROUP BY ALL)
SELECT c.park_id, c.h3_id, {js('coalesce(l, 0e0)', 4)} AS road_length_m, {js('coalesce(l, 0e0) / ((x1 - x0) * (y1 - y0) + (x1 - x0 + y1 - y0) * 40e0 + pi() * 400e0) * 1000000e0', 2)} AS road_density_m_per_km2 FROM boxes c LEFT JOIN a USING (park_id, h3_id)""")
def _(spark, sf):
    r = sp.road_length_in_buffer(ad.boxes(spark, sf), ad.paths(spark, sf))
    return r.select("park_id", "h3_id", js_round("road_length_m", 4).alias("road_length_m"), js_round("road_density_m_per_km2", 2).alias("road_density_m_per_km2"))


SITES = f"site0 AS (SELECT s_suppkey // 60 AS park_id, s_suppkey AS site_id, {ad.LNG0}e0 + (s_suppkey*37 % 90) / 1000e0 AS min_lng, {ad.LAT0}e0 + (s_suppkey*53 % 80) / 1000e0 AS min_lat FROM supplier), sites AS (SELECT *, min_lng + (site_id % 5 + 5) / 10000e0 AS max_lng, min_lat + (site_id % 3 + 5) / 10000e0 AS max_lat FROM site0)"


@query("site_grid", f"""WITH {CELLS}, {SITES}, d AS (SELECT *, {_d(sp.GRID_DEG)} AS st, CAST(floor((max_lng - min_lng) / {_d(sp.GRID_DEG)}) AS INTEGER) AS nx, CAST(floor((max_lat - min_lat) / {_d(sp.GRID_DEG)}) AS INTEGER) AS ny FROM sites),
g0 AS (SELECT *, unnest(range(0, nx)) AS i FROM d), g1 AS (SELECT *, unnest(range(0, ny)) AS j FROM g0),
p AS (SELECT park_id, site_id, st, site_id || '-' || i || '-' || j AS grid_id, min_lng + (max_lng - min_lng - nx * st) / 2e0 + i * st + st / 2e0 AS lng, min_lat + (max_lat - min_lat - ny * st) / 2e0 + j * st + st / 2e0 AS lat FROM g1)
SELECT p.park_id, site_id, grid_id, h3_id AS parent_h3_id, {js(f'st * st * {_d((sp.math.pi / 180.0 * sp.R_EARTH) ** 2)} * cos(radians(p.lat))', 4)} AS area_m2, {js(f'pop_density_km2 * st * st * {_d((sp.math.pi / 180.0 * sp.R_EARTH) ** 2)} * cos(radians(p.lat)) / 1000000e0', 4)} AS population
FROM p JOIN cells c ON c.park_id = p.park_id AND {INSIDE}""")
def _(spark, sf):
    g = sp.square_grid_cells(ad.sites(spark, sf), ad.cell_polygons(spark, sf))
    return g.select("park_id", "site_id", "grid_id", "parent_h3_id", js_round("area_m2", 4).alias("area_m2"), js_round("population", 4).alias("population"))


@query("nearest_cell_transfer", f"WITH {SCORED}, {POINTS}, j AS (SELECT p.park_id, feature_id, h3_id, heat_score, void_pct, row_number() OVER (PARTITION BY p.park_id, feature_id ORDER BY {haversine('p.lng', 'p.lat', 'c.lng', 'c.lat')}, h3_id) AS r FROM points p LEFT JOIN sc c ON c.park_id = p.park_id) SELECT park_id, feature_id, h3_id, heat_score, void_pct FROM j WHERE r = 1")
def _(spark, sf):
    s = scored(spark, sf)
    return sp.nearest_cell_transfer(ad.points(spark, sf), s, ["heat_score", "void_pct"]).drop("distance")


REG = f"reg0 AS (SELECT s_suppkey // 60 AS park_id, s_suppkey AS s, 'r' || s_suppkey AS region_id, (['HardBarrier','DestinationOnly','PermeableLandscape','PreferredCorridor'])[CAST(s_suppkey % 4 AS INTEGER) + 1] AS behavior, CAST(s_suppkey % 5 AS DOUBLE) AS priority, {ad.LNG0}e0 + (s_suppkey*37 % 80) / 1000e0 AS min_lng, {ad.LAT0}e0 + (s_suppkey*53 % 70) / 1000e0 AS min_lat FROM supplier), reg AS (SELECT *, min_lng + (s % 9 + 4) / 1000e0 AS max_lng, min_lat + (s % 7 + 4) / 1000e0 AS max_lat FROM reg0)"


@query("movement_cost_field", f"""WITH {CELLS}, {REG}, j AS (SELECT p.park_id, h3_id, region_id, behavior, row_number() OVER (PARTITION BY p.park_id, h3_id ORDER BY CASE behavior WHEN 'HardBarrier' THEN 4 WHEN 'DestinationOnly' THEN 3 WHEN 'PermeableLandscape' THEN 2 ELSE 1 END DESC, priority DESC, region_id) AS r FROM cells p JOIN reg c ON c.park_id = p.park_id AND {INSIDE})
SELECT c.park_id, c.h3_id, region_id, behavior, coalesce(behavior, '') NOT IN ('HardBarrier', 'DestinationOnly') AS traversable, greatest(0.05e0, {sp.COSTS['distance']}e0 + CASE behavior WHEN 'PermeableLandscape' THEN {sp.COSTS['permeability']}e0 WHEN 'PreferredCorridor' THEN -{sp.COSTS['corridor']}e0 ELSE 0e0 END) AS cost FROM cells c LEFT JOIN j ON j.park_id = c.park_id AND j.h3_id = c.h3_id AND j.r = 1""")
def _(spark, sf):
    return sp.classify_cells_by_region(ad.cell_polygons(spark, sf), ad.regions(spark, sf))


# --- graph ----------------------------------------------------------------------

CIRC = "(" + " OR ".join(f"contains(highway, {q(t)})" for t in CIRCULATION) + ")"
EDGES = f"{ROADS}, re AS (SELECT park_id, least(u, v) AS a, greatest(u, v) AS b, min(CASE WHEN coalesce(length, 0) = 0 THEN 1e0 ELSE length END) AS length FROM roads WHERE {CIRC} GROUP BY ALL), sym AS (SELECT park_id, a AS u, b AS v, length FROM re UNION ALL SELECT park_id, b, a, length FROM re)"
NODES = f"ncx AS (SELECT park_id, segment_id, u AS node, 0 AS o FROM roads UNION ALL SELECT park_id, segment_id, v, 1 FROM roads), nodes AS (SELECT park_id, node, {ad.LNG0}e0 + (node % 25) / 250e0 AS lng, {ad.LAT0}e0 + (node // 25) / 250e0 AS lat FROM (SELECT DISTINCT park_id, node FROM ncx))"


@query("routing_edges", f"WITH {EDGES} SELECT * FROM re")
def _(spark, sf):
    return gr.routing_edges(ad.roads(spark, sf))


@query("node_coordinates", f"WITH {ROADS}, {NODES} SELECT * FROM nodes")
def _(spark, sf):
    return gr.node_coordinates(ad.road_shapes(spark, sf))


CNODES = NODES.replace("FROM roads", f"FROM (SELECT * FROM roads WHERE {CIRC})")
ENTR = f"entr AS (SELECT park_id, node AS src, lng AS entrance_lng, lat AS entrance_lat, m AS snap_m FROM (SELECT *, {haversine('55.2201e0', '25.1552e0', 'lng', 'lat', HAVERSINE_ETL_R)} AS m, row_number() OVER (PARTITION BY park_id ORDER BY {haversine('55.2201e0', '25.1552e0', 'lng', 'lat', HAVERSINE_ETL_R)}, node) AS r FROM nodes) WHERE r = 1)"


def _network(spark, sf):
    lines = ad.road_shapes(spark, sf)
    nodes = gr.node_coordinates(lines.filter(cl.is_circulation())).withColumns({"center_lng": F.lit(ad.CENTER[0]), "center_lat": F.lit(ad.CENTER[1])})
    return gr.routing_edges(lines), nodes, gr.entrance_node(nodes)


@query("entrance_node", f"WITH {EDGES}, {CNODES}, {ENTR} SELECT * REPLACE ({js('snap_m', 3)} AS snap_m) FROM entr")
def _(spark, sf):
    return sp.rounded(_network(spark, sf)[2], ["snap_m"], 3)


SSSP = """sssp(park_id, src, node, distance) USING KEY (park_id, src, node) AS (SELECT park_id, src, src, 0e0 FROM {start}
 UNION SELECT d.park_id, d.src, e.v, min(d.distance + e.length) FROM sssp d JOIN sym e ON e.park_id = d.park_id AND e.u = d.node LEFT JOIN recurring.sssp r ON r.park_id = d.park_id AND r.src = d.src AND r.node = e.v
 WHERE r.distance IS NULL OR r.distance > d.distance + e.length GROUP BY d.park_id, d.src, e.v)"""


def sssp(start):
    return SSSP.replace("{start}", start)


@query("shortest_paths", f"WITH RECURSIVE {EDGES}, {CNODES}, {ENTR}, {sssp('entr')} SELECT * FROM sssp")
def _(spark, sf):
    e, _, s = _network(spark, sf)
    return gr.shortest_paths(e, s)


NET = f"nd AS (SELECT h.park_id, h3_id, distance, h.node, h.lng, h.lat, row_number() OVER (PARTITION BY h.park_id, h3_id ORDER BY distance, h.node) AS r FROM (SELECT s.*, n.lng, n.lat FROM sssp s JOIN nodes n USING (park_id, node)) h JOIN cells c ON h.park_id = c.park_id AND {INSIDE.replace('p.', 'h.')}), net AS (SELECT * FROM nd WHERE r = 1)"


@query("cell_network_access", f"WITH RECURSIVE {CELLS}, {EDGES}, {CNODES}, {ENTR}, {sssp('entr')}, {NET} SELECT c.park_id, c.h3_id, round_even(distance, 1) AS network_distance_m, round_even(distance / 80e0, 1) AS walk_minutes, "
       f"CASE WHEN distance > 0 THEN round_even({haversine('entrance_lng', 'entrance_lat', 'n.lng', 'n.lat', HAVERSINE_ETL_R)} / distance, 3) END AS directness FROM cells c LEFT JOIN net n ON n.park_id = c.park_id AND n.h3_id = c.h3_id LEFT JOIN entr e ON e.park_id = c.park_id")
def _(spark, sf):
    e, nodes, s = _network(spark, sf)
    polys = ad.cell_polygons(spark, sf)
    return gr.walk_access(polys, gr.cell_network_distance(gr.shortest_paths(e, s), nodes, polys), s)


@query("cell_intersections", f"WITH {CELLS}, {ROADS}, {NODES}, ce AS (SELECT DISTINCT park_id, least(u, v) AS a, greatest(u, v) AS b FROM roads), dg AS (SELECT park_id, node, count(*) AS degree FROM (SELECT park_id, a AS node FROM ce UNION ALL SELECT park_id, b FROM ce) GROUP BY ALL), p AS (SELECT d.*, lng, lat FROM dg d JOIN nodes USING (park_id, node) WHERE degree >= 3) SELECT c.park_id, c.h3_id, count(p.node) AS intersections FROM cells c LEFT JOIN p ON p.park_id = c.park_id AND {INSIDE} GROUP BY ALL")
def _(spark, sf):
    lines = ad.road_shapes(spark, sf)
    return gr.cell_intersections(lines, gr.node_coordinates(lines), ad.cell_polygons(spark, sf))


@query("cell_barriers", f"WITH {CELLS}, {ROADS}, p AS (SELECT *, {NODEXY}, CASE {tier_sql()} WHEN 'primary' THEN 2 WHEN 'secondary' THEN 1 END AS w FROM roads), a AS (SELECT c.park_id, c.h3_id, CAST(sum(w) AS BIGINT) AS s FROM cells c JOIN p ON p.park_id = c.park_id AND {INSIDE} GROUP BY ALL) SELECT c.park_id, c.h3_id, coalesce(s, 0) AS barrier_score FROM cells c LEFT JOIN a USING (park_id, h3_id)")
def _(spark, sf):
    return gr.cell_barriers(ad.road_shapes(spark, sf), ad.cell_polygons(spark, sf))


PIV = f"pnode AS (SELECT DISTINCT park_id, u AS src FROM sym), piv AS (SELECT park_id, src FROM (SELECT *, row_number() OVER (PARTITION BY park_id ORDER BY md5(src::VARCHAR), src) AS r FROM pnode) WHERE r <= {gr.PIVOTS})"


@query("closeness", f"WITH RECURSIVE {EDGES}, src AS (SELECT DISTINCT park_id, u AS src FROM sym), {sssp('src')}, n AS (SELECT park_id, count(*) AS n FROM src GROUP BY park_id), g AS (SELECT park_id, src, count(*) AS reached, sum(distance) AS s FROM sssp GROUP BY ALL) "
       f"SELECT g.park_id, src AS node, reached, {js('coalesce((reached - 1) / nullif(s, 0) * ((reached - 1) / CAST(nullif(n - 1, 0) AS DOUBLE)), 0e0)', 9)} AS closeness FROM g JOIN n USING (park_id)")
def _(spark, sf):
    e = gr.cut_lineage(gr.routing_edges(ad.roads(spark, sf)))
    src = gr.graph_nodes(e).select("park_id", F.col("node").alias("src"))
    return sp.rounded(gr.closeness(e, src), ["closeness"], 9)


BETW = f"""dag AS (SELECT a.park_id, a.src, a.node AS u, b.node AS v FROM sssp a JOIN sym e ON e.park_id = a.park_id AND e.u = a.node JOIN sssp b ON b.park_id = a.park_id AND b.src = a.src AND b.node = e.v WHERE a.distance + e.length = b.distance),
sw(park_id, src, node, value, k) AS (SELECT park_id, src, src, 1e0, 0 FROM piv UNION ALL SELECT w.park_id, w.src, d.v, sum(w.value), w.k + 1 FROM sw w JOIN dag d ON d.park_id = w.park_id AND d.src = w.src AND d.u = w.node GROUP BY w.park_id, w.src, d.v, w.k),
sg AS (SELECT park_id, src, node, sum(value) AS s FROM sw GROUP BY ALL), lk AS (SELECT d.*, a.s / b.s AS f FROM dag d JOIN sg a ON a.park_id = d.park_id AND a.src = d.src AND a.node = d.u JOIN sg b ON b.park_id = d.park_id AND b.src = d.src AND b.node = d.v),
dw(park_id, src, node, value, k) AS (SELECT park_id, src, u, sum(f), 0 FROM lk GROUP BY park_id, src, u UNION ALL SELECT w.park_id, w.src, l.u, sum(w.value * l.f), w.k + 1 FROM dw w JOIN lk l ON l.park_id = w.park_id AND l.src = w.src AND l.v = w.node GROUP BY w.park_id, w.src, l.u, w.k),
bt AS (SELECT park_id, node, sum(value) AS b FROM dw WHERE node <> src GROUP BY ALL), nn AS (SELECT DISTINCT park_id, u AS node FROM sym), cn AS (SELECT park_id, count(*) AS n FROM nn GROUP BY park_id), ck AS (SELECT park_id, count(*) AS k FROM piv GROUP BY park_id)"""
BETW_SELECT = f"""SELECT nn.park_id, nn.node, {js('coalesce(b, 0e0) * (n / CAST(k AS DOUBLE) / ((n - 1) * (n - 2)))', 9)} AS betweenness FROM nn LEFT JOIN bt ON bt.park_id = nn.park_id AND bt.node = nn.node JOIN cn ON cn.park_id = nn.park_id JOIN ck ON ck.park_id = nn.park_id"""


@query("betweenness", f"WITH RECURSIVE {EDGES}, {PIV}, {sssp('piv')}, {BETW} {BETW_SELECT}")
def _(spark, sf):
    # min(500, N) sources of each network
    e = gr.cut_lineage(gr.routing_edges(ad.roads(spark, sf)))
    return sp.rounded(gr.betweenness(e, gr.pivots(e)), ["betweenness"], 9)


@query("space_syntax", f"""WITH RECURSIVE {EDGES}, {CNODES}, {PIV}, {sssp('pnode')}, cs AS (SELECT park_id, src AS node, count(*) AS reached, sum(distance) AS s FROM sssp GROUP BY ALL), cn0 AS (SELECT park_id, count(*) AS n FROM pnode GROUP BY park_id),
cl AS (SELECT park_id, node, coalesce((reached - 1) / nullif(s, 0) * ((reached - 1) / CAST(nullif(n - 1, 0) AS DOUBLE)), 0e0) AS c FROM cs JOIN cn0 USING (park_id)),
{BETW.replace('FROM sssp a JOIN', 'FROM (SELECT s.* FROM sssp s JOIN piv USING (park_id, src)) a JOIN')}, bw AS ({BETW_SELECT}),
dg AS (SELECT park_id, u AS node, count(*) AS degree FROM sym GROUP BY ALL), x AS (SELECT park_id, node, c, betweenness AS b FROM cl JOIN bw USING (park_id, node)), mm AS (SELECT park_id, min(c) AS c0, max(c) AS c1, min(b) AS b0, max(b) AS b1 FROM x GROUP BY park_id)
SELECT park_id, node, lng, lat, round_even((c - c0) / CASE WHEN c1 = c0 THEN 1e0 ELSE c1 - c0 END * 100e0, 2) AS integration, round_even((b - b0) / CASE WHEN b1 = b0 THEN 1e0 ELSE b1 - b0 END * 100e0, 2) AS choice, degree FROM x JOIN mm USING (park_id) JOIN dg USING (park_id, node) JOIN nodes USING (park_id, node)""")
def _(spark, sf):
    lines = ad.road_shapes(spark, sf)
    return gr.space_syntax(gr.routing_edges(lines), gr.node_coordinates(lines.filter(cl.is_circulation())))


JOUR = "jn AS (SELECT o_custkey // 900 AS package_id, o_orderkey AS journey_id, o_orderpriority AS persona_id, CAST(1 + o_orderkey % 4 AS DOUBLE) AS weight, l_linenumber * 100 + l_suppkey AS position, l_partkey AS part_id, l_partkey % 44 AS space FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query("traversal_counts", f"WITH {JOUR}, c AS (SELECT package_id, space, count(*) AS n FROM jn GROUP BY ALL) SELECT package_id, space, n, greatest(1e0, least(10e0, {js('n / CAST(greatest(1, max(n) OVER (PARTITION BY package_id)) AS DOUBLE) * 10e0')})) AS priority FROM c")
def _(spark, sf):
    return gr.traversal_counts(ad.journeys(spark, sf))


@query("od_demand", f"WITH {JOUR}, l AS (SELECT *, space AS origin, lead(space) OVER (PARTITION BY package_id, journey_id ORDER BY position, part_id) AS destination FROM jn) SELECT package_id, origin, destination, {js('sum(weight)', 6)} AS weight, count(DISTINCT journey_id) AS journeys, string_agg(DISTINCT persona_id, '|' ORDER BY persona_id) AS personas FROM l WHERE destination IS NOT NULL AND origin <> destination GROUP BY ALL")
def _(spark, sf):
    j = ad.journeys(spark, sf, dealt=True).withColumn("position", F.struct("position", "part_id"))
    return gr.od_demand(j).withColumn("personas", F.array_join("personas", "|"))


@query("od_demand_journeys", f"WITH {JOUR}, l AS (SELECT *, space AS origin, lead(space) OVER (PARTITION BY package_id, journey_id ORDER BY position, part_id) AS destination FROM jn) SELECT DISTINCT package_id, origin, destination, journey_id FROM l WHERE destination IS NOT NULL AND origin <> destination")
def _(spark, sf):
    return gr.od_journeys(ad.journeys(spark, sf, dealt=True).withColumn("position", F.struct("position", "part_id")))


FLOWC = gr.FLOW_TIERS


@query("flow_links", f"""WITH {JOUR}, f AS (SELECT package_id, (['Kids','Teens','Adults','Old'])[CAST(journey_id % 4 AS INTEGER) + 1] AS age, persona_id AS archetype, 'a' || journey_id % 5 AS activity, 'e' || part_id % 7 AS experience, CASE WHEN part_id % 2 = 0 THEN 'cheap' ELSE 'dear' END AS cost, 's' || space AS space, CASE WHEN part_id % 3 = 0 THEN 'High' WHEN part_id % 3 = 1 THEN 'Medium' ELSE 'Low' END AS score, CAST(part_id % 50 AS DOUBLE) AS area FROM jn),
p AS ({' UNION ALL '.join(f"SELECT package_id, age, {q(a)} AS source_column, {a} AS source, {q(b)} AS target_column, {b} AS target, greatest(1e0, area) AS v FROM f" for a, b in zip(FLOWC, FLOWC[1:]))}),
g AS (SELECT package_id, source_column, source, target_column, target, age, sum(v) AS v FROM p GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY package_id, source_column, source, target_column, target ORDER BY v DESC, list_position(['Kids','Teens','Adults','Old'], age)) AS r, sum(v) OVER (PARTITION BY package_id, source_column, source, target_column, target) AS value FROM g)
SELECT package_id, source_column, source, target_column, target, value, age AS dominant_tier FROM r WHERE r = 1""")
def _(spark, sf):
    j = ad.journeys(spark, sf)
    age = F.get(F.array(*[F.lit(x) for x in ("Kids", "Teens", "Adults", "Old")]), (F.col("journey_id") % 4).cast("int"))
    f = j.select("package_id", age.alias("age"), F.col("persona_id").alias("archetype"), F.concat(F.lit("a"), (F.col("journey_id") % 5).cast("string")).alias("activity"), F.concat(F.lit("e"), (F.col("part_id") % 7).cast("string")).alias("experience"),
                 F.when(F.col("part_id") % 2 == 0, "cheap").otherwise("dear").alias("cost"), F.concat(F.lit("s"), F.col("space").cast("string")).alias("space"),
                 F.when(F.col("part_id") % 3 == 0, "High").when(F.col("part_id") % 3 == 1, "Medium").otherwise("Low").alias("score"), (F.col("part_id") % 50).cast("double").alias("area"))
    return gr.flow_links(f, ["package_id"], FLOWC)
