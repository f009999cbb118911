"""Spatial joins on a tile grid.

Every join is an equi-join on (study area, tile) followed by an exact test, so Spark can
hash-partition it; polygons and segments are copied to the tiles they touch.  Points of a
crowded tile are spread over ``salt`` sub-keys (the other side is copied per sub-key), and
AQE may split what is still skewed.  Results are whole: no candidate is capped.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.formulas import R_EARTH
from ..functions.numeric import js_round
from . import quadtree

PARK = ("park_id",)


def _cover(df: DataFrame, size: float, x0="min_lng", y0="min_lat", x1="max_lng", y1="max_lat") -> DataFrame:
    """One row per tile that the bounding box touches."""
    df = df.withColumn("_tx", F.explode(F.sequence(geo.tile(x0, size), geo.tile(x1, size))))
    return df.withColumn("_ty", F.explode(F.sequence(geo.tile(y0, size), geo.tile(y1, size))))


def assign_points_to_polygons(points: DataFrame, polygons: DataFrame, point_id: str = "feature_id", polygon_id: str = "h3_id", order: str = "seq",
                              tile: float = 0.01, salt: int = 4, group_cols=PARK) -> DataFrame:
    """(point_id, polygon_id): the first polygon, in ``order``, that contains the point.

    ``points``: lng, lat.  ``polygons``: ring, min/max_lng, min/max_lat.  Choose ``tile`` near
    the polygon size.
    """
    keys = list(group_cols)
    p = points.select(*keys, point_id, "lng", "lat").withColumns({
        "_tx": geo.tile("lng", tile), "_ty": geo.tile("lat", tile), "_s": F.pmod(F.xxhash64(point_id), F.lit(salt)).cast("int")})
    g = _cover(polygons.select(*keys, polygon_id, order, "ring", "min_lng", "min_lat", "max_lng", "max_lat"), tile)
    g = g.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    j = p.join(g, [*keys, "_tx", "_ty", "_s"])
    j = j.filter(F.col("lng").between(F.col("min_lng"), F.col("max_lng")) & F.col("lat").between(F.col("min_lat"), F.col("max_lat")))
    j = j.filter(geo.point_in_ring("lng", "lat", "ring"))
    return j.groupBy(*keys, point_id).agg(F.min_by(polygon_id, order).alias(polygon_id))


def sum_per_cell(points: DataFrame, value: str, polygons: DataFrame, group_cols=PARK, **kw) -> DataFrame:
    """Sum of ``value`` over the points in each cell that has any.

    Values at one position are added up before the join, so copies cost nothing and no
    point id is needed.
    """
    keys = list(group_cols)
    spots = points.groupBy(*keys, "lng", "lat").agg(F.sum(value).alias("_v")).withColumn("_spot", F.struct("lng", "lat"))
    hit = assign_points_to_polygons(spots, polygons, "_spot", group_cols=keys, **kw)
    return hit.join(spots.select(*keys, "_spot", "_v"), [*keys, "_spot"]).groupBy(*keys, "h3_id").agg(F.sum("_v").alias("_sum"))


def middle_vertex(lines: DataFrame, *cols) -> DataFrame:
    mid = F.get("coords", F.floor(F.size("coords") / F.lit(2)).cast("int"))
    return lines.filter(F.size("coords") >= 2).select(*cols, mid["lng"].alias("lng"), mid["lat"].alias("lat"))


def length_per_cell(lines: DataFrame, polygons: DataFrame, group_cols=PARK, **kw) -> DataFrame:
    """Length of each line added to the cell of its middle vertex; cells without lines get 0."""
    keys = list(group_cols)
    m = middle_vertex(lines, *keys, F.coalesce("length", F.lit(0.0)).alias("length"))
    j = polygons.select(*keys, "h3_id", "hex_area_km2").join(sum_per_cell(m, "length", polygons, keys, **kw), [*keys, "h3_id"], "left")
    return j.select(*keys, "h3_id", F.coalesce("_sum", F.lit(0.0)).alias("real_road_length_m"),
                    F.coalesce(F.try_divide("_sum", "hex_area_km2"), F.lit(0.0)).alias("real_road_density_m_per_km2"))


def _around(points: DataFrame, lng: str) -> DataFrame:
    """The points, and copies of those beyond 90 degrees shifted by a full turn, so that both sides of the date line meet."""
    x = F.col(lng)
    return points.withColumn(lng, F.explode(F.array_compact(F.array(x, F.when(x > 90, x - 360.0).when(x < -90, x + 360.0)))))


def count_within_radius(queries: DataFrame, points: DataFrame, radius_m: float, query_id: str = "h3_id", group_cols=PARK, out: str = "n") -> DataFrame:
    """Points within ``radius_m`` of each query, anywhere on the globe.

    Tiles are bands of latitude cut into widths that suit the band.  Points at one place are counted
    once with a weight, so copies do not multiply the join.
    """
    keys = list(group_cols)
    angle = radius_m / R_EARTH * 1.0001
    size = math.degrees(angle)

    def width(band):
        # degrees of longitude that the radius spans, seen from the band or one next to it
        edge = F.greatest(F.abs(band - 1), F.abs(band + 2)) * F.lit(size)
        s = F.lit(math.sin(min(angle, math.pi / 2))) / F.cos(F.radians(F.least(edge, F.lit(89.999999))))
        return F.when((edge >= 89.9) | (s >= 1), F.lit(720.0)).otherwise(F.degrees(F.asin(F.least(s, F.lit(1.0)))) * 1.0001)

    def column(x, band):
        return F.floor(F.col(x) / width(band)).cast("int")

    spots = points.groupBy(*keys, F.col("lng").alias("_x"), F.col("lat").alias("_y")).agg(F.count(F.lit(1)).alias("_w"))
    spots = _around(spots, "_x").withColumn("_ty", geo.tile("_y", size)).withColumn("_tx", column("_x", F.col("_ty")))
    q = queries.select(*keys, query_id, "lng", "lat", F.explode(F.array(*[F.lit(d) for d in (-1, 0, 1)])).alias("_d")).withColumn("_ty", geo.tile("lat", size) + F.col("_d"))
    q = q.withColumn("_tx", F.explode(F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: column("lng", F.col("_ty")) + d))).drop("_d")
    hit = q.join(spots, [*keys, "_tx", "_ty"]).filter(geo.haversine_m("lng", "lat", "_x", "_y") <= radius_m)
    c = hit.groupBy(*keys, query_id).agg(F.sum("_w").alias(out))
    return queries.select(*keys, query_id).join(c, [*keys, query_id], "left").withColumn(out, F.coalesce(out, F.lit(0)).cast("long"))


def nearest_point(queries: DataFrame, points: DataFrame, query_id: str = "h3_id", payload: str = "feature_id", group_cols=PARK) -> DataFrame:
    """Nearest point by great-circle distance (metres), exact: (query_id, distance, payload), null when the area has none."""
    keys = list(group_cols)
    points = _around(points, "lng")
    t = points.select(*keys, F.col("lng").alias("_px"), F.col("lat").alias("_py"), F.col("lng").alias("_x0"), F.col("lat").alias("_y0"),
                      F.col("lng").alias("_x1"), F.col("lat").alias("_y1"), payload)

    def box_distance(b):
        east = F.greatest(F.lit(0.0), b["_x0"] - F.col("lng"), F.col("lng") - b["_x1"])
        north = F.greatest(F.lit(0.0), b["_y0"] - F.col("lat"), F.col("lat") - b["_y1"])
        # distance to the nearest meridian and parallel of the box, slightly reduced
        mer = F.asin(F.cos(F.radians("lat")) * F.sin(F.radians(F.least(east, F.lit(90.0)))))
        return F.greatest(mer, F.radians(north)) * (R_EARTH * 0.999999)

    distance = lambda g: geo.haversine_m("lng", "lat", g["_px"], g["_py"])
    return quadtree.nearest(queries, t, query_id, payload, payload, distance, distance, box_distance, ["_px", "_py"], "lng", "lat", keys)


def nearest_segment(queries: DataFrame, segments: DataFrame, query_id: str, payload: str, group_cols=PARK) -> DataFrame:
    """Nearest line segment in planar metres, exact.  ``segments``: ax, ay, bx, by; ``queries``: x, y."""
    keys, ends = list(group_cols), ["ax", "ay", "bx", "by"]
    t = segments.select(*keys, *ends, payload, F.least("ax", "bx").alias("_x0"), F.least("ay", "by").alias("_y0"),
                        F.greatest("ax", "bx").alias("_x1"), F.greatest("ay", "by").alias("_y1"))

    def to_first_end(g):
        dx, dy = F.col("x") - g["ax"], F.col("y") - g["ay"]
        return F.sqrt(dx * dx + dy * dy)

    def box_distance(b):
        east = F.greatest(F.lit(0.0), b["_x0"] - F.col("x"), F.col("x") - b["_x1"])
        north = F.greatest(F.lit(0.0), b["_y0"] - F.col("y"), F.col("y") - b["_y1"])
        return F.sqrt(east * east + north * north) * 0.999999

    return quadtree.nearest(queries, t, query_id, payload, payload, lambda g: geo.segment_distance("x", "y", *[g[e] for e in ends]), to_first_end, box_distance, ends, "x", "y", keys)


def lines_to_segments(lines: DataFrame, keep=()) -> DataFrame:
    """Consecutive vertex pairs of a planar ``coords`` array<struct<x,y>>; a single vertex becomes a point segment."""
    c = F.col("coords")
    seg = F.when(F.size(c) == 1, F.array(F.struct(c[0]["x"].alias("ax"), c[0]["y"].alias("ay"), c[0]["x"].alias("bx"), c[0]["y"].alias("by")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(c) - 2), lambda i: F.struct(F.get(c, i)["x"].alias("ax"), F.get(c, i)["y"].alias("ay"), F.get(c, i + 1)["x"].alias("bx"), F.get(c, i + 1)["y"].alias("by"))))
    return lines.select(*keep, F.inline(seg))


def nearest_cell_transfer(designer: DataFrame, scored: DataFrame, score_cols, designer_id: str = "feature_id", group_cols=PARK) -> DataFrame:
    """Each designer cell takes the scores of the nearest scored cell."""
    s = scored.select(*group_cols, F.col("lng"), F.col("lat"), F.struct("h3_id", *score_cols).alias("payload"))
    n = nearest_point(designer, s, designer_id, "payload", group_cols=group_cols)
    return n.select(*group_cols, designer_id, "distance", "payload.*")


# Restriction order of region behaviours (strongest first) and traversal costs.
REGION_RANK = {"HardBarrier": 4, "DestinationOnly": 3, "PermeableLandscape": 2, "PreferredCorridor": 1}
COSTS = {"distance": 1.0, "permeability": 2.0, "corridor": 0.4}


def classify_cells_by_region(cells: DataFrame, regions: DataFrame, costs=None, tile: float = 0.01, group_cols=PARK, cell_id: str = "h3_id") -> DataFrame:
    """Strongest region containing each cell centre, traversable flag and movement cost.

    ``cells`` may carry inside_site (default true).  ``regions``: region_id, behavior, priority, ring and bbox.
    """
    keys, w = list(group_cols), {**COSTS, **(costs or {})}
    rank = F.create_map(*[F.lit(x) for kv in REGION_RANK.items() for x in kv])
    r = regions.withColumn("_ord", F.struct((-F.coalesce(F.element_at(rank, F.col("behavior")), F.lit(0))).alias("r"), (-F.col("priority")).alias("p"), F.col("region_id").alias("i")))
    hit = assign_points_to_polygons(cells, r.withColumn("_pid", F.struct("region_id", "behavior")), cell_id, "_pid", "_ord", tile, group_cols=keys)
    j = cells.join(hit, [*keys, cell_id], "left")
    b = F.col("_pid.behavior")
    inside = F.coalesce(F.col("inside_site"), F.lit(True)) if "inside_site" in cells.columns else F.lit(True)
    cost = F.lit(w["distance"]) + F.when(b == "PermeableLandscape", F.lit(w["permeability"])).when(b == "PreferredCorridor", F.lit(-w["corridor"])).otherwise(F.lit(0.0))
    return j.select(*keys, cell_id, F.col("_pid.region_id").alias("region_id"), b.alias("behavior"),
                    (inside & ~F.coalesce(b.isin("HardBarrier", "DestinationOnly"), F.lit(False))).alias("traversable"), F.greatest(F.lit(0.05), cost).alias("cost"))


POLY = "array<struct<x:double,y:double>>"


def clip_half_plane(poly, a, b, c0):
    """Part of an open polygon where a*x + b*y + c >= 0 (one step of convex clipping, all Columns)."""
    from ..functions.text import let

    def side(p):
        return a * p["x"] + b * p["y"] + c0

    def edges(v):
        def edge(i):
            p, q = F.get(v, i), F.get(v, F.pmod(i + 1, F.size(v)))
            sp, sq = side(p), side(q)
            t = F.try_divide(sp, sp - sq)
            cut = F.struct((p["x"] + (q["x"] - p["x"]) * t).alias("x"), (p["y"] + (q["y"] - p["y"]) * t).alias("y"))
            end = F.struct(q["x"].alias("x"), q["y"].alias("y"))
            none = F.array().cast(POLY)
            return F.when((sp >= 0) & (sq >= 0), F.array(end)).when((sp >= 0) & (sq < 0), F.array(cut)).when((sp < 0) & (sq >= 0), F.array(cut, end)).otherwise(none).cast(POLY)

        return F.when(F.size(v) > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.size(v) - 1), edge))).otherwise(F.array().cast(POLY)).cast(POLY)

    return let(poly, edges)


def clip_to_box(poly, x0, y0, x1, y1):
    """Open polygon clipped to an axis-parallel box."""
    one, zero = F.lit(1.0), F.lit(0.0)
    p = clip_half_plane(poly, one, zero, -x0)
    p = clip_half_plane(p, -one, zero, x1)
    p = clip_half_plane(p, zero, one, -y0)
    return clip_half_plane(p, zero, -one, y1)


def open_area(poly):
    """Area of an open polygon (0 for fewer than 3 vertices), taken relative to its first vertex."""
    from ..functions.text import let

    def area(v):
        def term(s, i):
            p, q, o = F.get(v, i), F.get(v, i + 1), F.get(v, F.lit(0))
            return s + (p["x"] - o["x"]) * (q["y"] - o["y"]) - (q["x"] - o["x"]) * (p["y"] - o["y"])

        return F.when(F.size(v) >= 3, F.abs(F.aggregate(F.sequence(F.lit(1), F.size(v) - 2), F.lit(0.0), term)) / F.lit(2.0)).otherwise(F.lit(0.0))

    return let(poly, area)


def building_overlap(cells: DataFrame, buildings: DataFrame, tile: float = 100.0, group_cols=PARK) -> DataFrame:
    """Sum of area(cell box with building polygon) and coverage % (at most 100), in planar metres.

    ``cells``: x0,y0,x1,y1; ``buildings``: building_id, poly (open array<struct<x,y>>), bx0..by1.
    A pair meets in every shared tile; the tile holding the lower-left corner of the common
    box keeps it, so no distinct is needed.
    """
    keys = list(group_cols)
    c = _cover(cells.select(*keys, "h3_id", "x0", "y0", "x1", "y1"), tile, "x0", "y0", "x1", "y1")
    b = _cover(buildings.select(*keys, "building_id", "poly", "bx0", "by0", "bx1", "by1"), tile, "bx0", "by0", "bx1", "by1")
    j = c.join(b, [*keys, "_tx", "_ty"]).filter((F.col("bx0") < F.col("x1")) & (F.col("bx1") > F.col("x0")) & (F.col("by0") < F.col("y1")) & (F.col("by1") > F.col("y0")))
    j = j.filter((geo.tile(F.greatest("x0", "bx0"), tile) == F.col("_tx")) & (geo.tile(F.greatest("y0", "by0"), tile) == F.col("_ty")))
    a = j.groupBy(*keys, "h3_id").agg(F.sum(open_area(clip_to_box(F.col("poly"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))).alias("_a"))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return cells.join(a, [*keys, "h3_id"], "left").select(*keys, "h3_id", F.coalesce("_a", F.lit(0.0)).alias("building_area_m2"),
                                                          F.coalesce(F.least(F.lit(100.0), F.col("_a") / area * 100.0), F.lit(0.0)).alias("building_coverage_pct"))


# Way types that do not count as roads near a cell.
PEDESTRIAN_WAYS = ["footway", "path", "pedestrian", "steps", "corridor", "living_street", "cycleway"]


def road_length_in_buffer(cells: DataFrame, lines: DataFrame, buffer_m: float = 20.0, step_m: float = 5.0, tile: float = 100.0, group_cols=PARK) -> DataFrame:
    """Road length within ``buffer_m`` of each cell box, estimated from samples every ``step_m``.

    ``lines``: segment_id, highway, ax, ay, bx, by (planar metres).  Samples are generated
    inside Spark and joined by tile; each sample carries length/(n+1), so the per-cell sum
    needs no regrouping by line.
    """
    keys = list(group_cols)
    length = F.sqrt(F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by") - F.col("ay"), 2))
    ln = lines.filter(~F.coalesce(F.col("highway").isin(PEDESTRIAN_WAYS), F.lit(False))).withColumn("_len", length).filter(F.col("_len") > 0)
    ln = ln.withColumn("_n", F.greatest(F.lit(2), F.ceil(F.col("_len") / step_m)).cast("int"))
    s = ln.select(*keys, "ax", "ay", "bx", "by", "_n", (F.col("_len") / (F.col("_n") + 1)).alias("_w"), F.explode(F.sequence(F.lit(0), F.col("_n"))).alias("_i"))
    f = F.col("_i") / F.col("_n")
    s = s.select(*keys, "_w", (F.col("ax") + (F.col("bx") - F.col("ax")) * f).alias("_sx"), (F.col("ay") + (F.col("by") - F.col("ay")) * f).alias("_sy"))
    s = s.withColumns({"_tx": geo.tile("_sx", tile), "_ty": geo.tile("_sy", tile)})
    c = cells.select(*keys, "h3_id", "x0", "y0", "x1", "y1")
    wide = c.withColumns({"_a": F.col("x0") - buffer_m, "_b": F.col("y0") - buffer_m, "_c": F.col("x1") + buffer_m, "_d": F.col("y1") + buffer_m})
    j = _cover(wide, tile, "_a", "_b", "_c", "_d").join(s, [*keys, "_tx", "_ty"])
    dx = F.greatest(F.col("x0") - F.col("_sx"), F.lit(0.0), F.col("_sx") - F.col("x1"))
    dy = F.greatest(F.col("y0") - F.col("_sy"), F.lit(0.0), F.col("_sy") - F.col("y1"))
    g = j.filter(dx * dx + dy * dy <= buffer_m * buffer_m).groupBy(*keys, "h3_id").agg(F.sum("_w").alias("_l"))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    area = w * h + (w + h) * (2.0 * buffer_m) + F.lit(math.pi * buffer_m * buffer_m)
    out = c.join(g, [*keys, "h3_id"], "left").withColumn("_l", F.coalesce("_l", F.lit(0.0)))
    return out.select(*keys, "h3_id", F.col("_l").alias("road_length_m"), (F.col("_l") / area * 1000000.0).alias("road_density_m_per_km2"))


GRID_DEG = math.degrees(0.01 / 6371.0088)  # 10 m as degrees


def square_grid_cells(parks: DataFrame, cells: DataFrame, min_area_m2: float = 5.0, group_cols=PARK, tile: float = 0.01) -> DataFrame:
    """10 m squares over each park polygon, clipped to it, with the attributes of the parent cell.

    ``parks``: site_id, ring and bbox.  ``cells``: polygons with ring, bbox and pop_density_km2.
    The grid is generated by exploding row and column numbers, so a large park spreads over tasks.
    """
    keys = list(group_cols)
    step = F.lit(GRID_DEG)
    nx, ny = F.floor((F.col("max_lng") - F.col("min_lng")) / step), F.floor((F.col("max_lat") - F.col("min_lat")) / step)
    p = parks.withColumns({"_nx": nx.cast("int"), "_ny": ny.cast("int")}).filter((F.col("_nx") > 0) & (F.col("_ny") > 0))
    p = p.withColumns({"_ox": F.col("min_lng") + (F.col("max_lng") - F.col("min_lng") - F.col("_nx") * step) / 2.0, "_oy": F.col("min_lat") + (F.col("max_lat") - F.col("min_lat") - F.col("_ny") * step) / 2.0})
    g = p.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_nx") - 1))).repartition(*keys, "site_id", "_i").withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_ny") - 1)))
    g = g.withColumns({"x0": F.col("_ox") + F.col("_i") * step, "y0": F.col("_oy") + F.col("_j") * step})
    ring = F.transform(F.slice("ring", 1, F.size("ring") - 1), lambda q: F.struct((q["lng"] - F.col("x0")).alias("x"), (q["lat"] - F.col("y0")).alias("y"))).cast(POLY)
    g = g.withColumn("_clip", clip_to_box(ring, F.lit(0.0), F.lit(0.0), step, step))
    m = math.pi / 180.0 * R_EARTH
    g = g.withColumn("area_m2", open_area(F.col("_clip")) * F.lit(m * m) * F.cos(F.radians(F.col("y0") + step / 2.0))).filter(F.col("area_m2") >= min_area_m2)
    n = F.size("_clip")
    g = g.withColumns({"lng": F.col("x0") + F.try_divide(F.aggregate("_clip", F.lit(0.0), lambda s, q: s + q["x"]), n), "lat": F.col("y0") + F.try_divide(F.aggregate("_clip", F.lit(0.0), lambda s, q: s + q["y"]), n),
                       "grid_id": F.concat_ws("-", F.col("site_id").cast("string"), F.col("_i").cast("string"), F.col("_j").cast("string"))})
    g = g.select(*keys, "site_id", "grid_id", "x0", "y0", "lng", "lat", "area_m2")
    hit = assign_points_to_polygons(g, cells, "grid_id", "h3_id", "seq", tile, group_cols=keys)
    d = cells.select(*keys, "h3_id", "pop_density_km2")
    return g.join(hit, [*keys, "grid_id"]).join(d, [*keys, "h3_id"]).withColumnRenamed("h3_id", "parent_h3_id").withColumn(
        "population", F.coalesce("pop_density_km2", F.lit(0.0)) * F.col("area_m2") / 1000000.0)


def layer_extent(features: DataFrame, layer: str = "layer", group_cols=()) -> DataFrame:
    """Feature count and bounding box per layer."""
    return features.groupBy(*group_cols, layer).agg(F.count(F.lit(1)).alias("features"), F.min("lng").alias("min_lng"), F.min("lat").alias("min_lat"),
                                                    F.max("lng").alias("max_lng"), F.max("lat").alias("max_lat"))


def bbox_filter(features: DataFrame, bbox, page: int | None = None, seq: str = "feature_id") -> DataFrame:
    """Features whose box meets the query box, with the matched count.

    ``page`` asks for the first rows by ``seq`` only and then flags the cut in ``truncated``.  Range
    predicates on stored box columns reach the parquet scan.
    """
    x0, y0, x1, y1 = bbox
    hit = features.filter((F.col("max_lng") >= x0) & (F.col("min_lng") <= x1) & (F.col("max_lat") >= y0) & (F.col("min_lat") <= y1))
    n = hit.agg(F.count(F.lit(1)).alias("matched_count"))
    rows = hit if page is None else hit.orderBy(seq).limit(page)
    return rows.join(F.broadcast(n), how="inner").withColumn("truncated", F.lit(False) if page is None else F.col("matched_count") > page)  # one row


def rounded(df: DataFrame, cols, dp: int = 6) -> DataFrame:
    return df.withColumns({c: js_round(c, dp) for c in cols})
