"""Geometry as Columns: distances, rings, tiles, projections."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .formulas import COMPASS, R_EARTH
from .numeric import c, js_round
from .text import let


def haversine_m(lng1, lat1, lng2, lat2, radius: float = R_EARTH) -> Column:
    lng1, lat1, lng2, lat2 = map(c, (lng1, lat1, lng2, lat2))
    k, h = F.lit(math.pi / 180.0), F.lit(math.pi / 360.0)
    a = F.pow(F.sin((lat2 - lat1) * h), 2) + F.cos(lat1 * k) * F.cos(lat2 * k) * F.pow(F.sin((lng2 - lng1) * h), 2)
    return F.lit(2.0 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def bearing_deg(lng1, lat1, lng2, lat2) -> Column:
    """Initial great-circle bearing, -180..180."""
    lng1, lat1, lng2, lat2 = (F.radians(c(x)) for x in (lng1, lat1, lng2, lat2))
    d = lng2 - lng1
    return F.degrees(F.atan2(F.sin(d) * F.cos(lat2), F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(d)))


def compass(bearing) -> Column:
    b = F.pmod(c(bearing), F.lit(360.0))
    return F.get(F.array(*[F.lit(x) for x in COMPASS]), (js_round(b / F.lit(45.0)).cast("int") % 8))


def point_in_ring(lng, lat, ring) -> Column:
    """Ray casting over the ring's edges, inside one row (no UDF)."""
    args = F.struct(c(lng).alias("x"), c(lat).alias("y"), c(ring).alias("r"))

    def test(v):
        size = F.size(v["r"])

        def edge(acc, i):
            a, b = F.get(v["r"], i), F.get(v["r"], F.pmod(i - 1 + size, size))
            cross = (a["lat"] > v["y"]) != (b["lat"] > v["y"])
            at = (b["lng"] - a["lng"]) * (v["y"] - a["lat"]) / (b["lat"] - a["lat"] + F.lit(1e-15)) + a["lng"]
            return acc != (cross & (v["x"] < at))

        return F.when(size > 0, F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(False), edge)).otherwise(F.lit(False))

    return let(args, test)


def ring_bbox(ring) -> dict[str, Column]:
    r = c(ring)
    return {f"{m}_{a}": f(F.transform(r, lambda p: p[a])) for m, f in (("min", F.array_min), ("max", F.array_max)) for a in ("lng", "lat")}


def _mean(ring, n, a):
    return F.aggregate(F.slice(ring, 1, n), F.lit(0.0), lambda s, p: s + p[a]) / n


def ring_centroid(ring) -> Column:
    """Vertex mean without the closing point."""
    return let(c(ring), lambda r: let(F.when(F.size(r) > 1, F.size(r) - 1).otherwise(F.size(r)), lambda n: F.struct(_mean(r, n, "lng").alias("lng"), _mean(r, n, "lat").alias("lat"))))


def ring_moments(ring) -> Column:
    """Shoelace sums of a closed planar ring: struct<a2, cx, cy, perimeter> (a2 = twice the signed area)."""
    def edges(r):
        return F.transform(F.sequence(F.lit(0), F.size(r) - 2), lambda i: F.struct(
            F.get(r, i)["x"].alias("x0"), F.get(r, i)["y"].alias("y0"), F.get(r, i + 1)["x"].alias("x1"), F.get(r, i + 1)["y"].alias("y1")))

    def fold(es):
        def step(acc, e):
            cr = e["x0"] * e["y1"] - e["x1"] * e["y0"]
            return F.struct((acc["a2"] + cr).alias("a2"), (acc["cx"] + (e["x0"] + e["x1"]) * cr).alias("cx"), (acc["cy"] + (e["y0"] + e["y1"]) * cr).alias("cy"),
                            (acc["perimeter"] + F.sqrt(F.pow(e["x1"] - e["x0"], 2) + F.pow(e["y1"] - e["y0"], 2))).alias("perimeter"))

        zero = F.struct(*[F.lit(0.0).alias(k) for k in ("a2", "cx", "cy", "perimeter")])
        return F.aggregate(es, zero, step)

    return let(let(c(ring), edges), fold)


def shoelace_area(ring) -> Column:
    return F.abs(ring_moments(ring)["a2"]) / F.lit(2.0)


def ring_perimeter(ring) -> Column:
    return ring_moments(ring)["perimeter"]


def area_centroid(ring) -> Column:
    return let(ring_moments(ring), lambda m: F.struct(F.try_divide(m["cx"], m["a2"] * 3.0).alias("x"), F.try_divide(m["cy"], m["a2"] * 3.0).alias("y")))


def principal_axis_deg(ring) -> Column:
    """Direction of the longest spread of the vertices, 0..180 degrees."""
    def axis(r):
        n = F.size(r) - 1
        pts = F.slice(r, 1, n)
        mx = F.aggregate(pts, F.lit(0.0), lambda s, p: s + p["x"]) / n
        my = F.aggregate(pts, F.lit(0.0), lambda s, p: s + p["y"]) / n
        return let(F.struct(mx.alias("mx"), my.alias("my"), pts.alias("p")), lambda v: let(
            F.aggregate(v["p"], F.struct(F.lit(0.0).alias("xx"), F.lit(0.0).alias("yy"), F.lit(0.0).alias("xy")), lambda s, p: F.struct(
                (s["xx"] + F.pow(p["x"] - v["mx"], 2)).alias("xx"), (s["yy"] + F.pow(p["y"] - v["my"], 2)).alias("yy"),
                (s["xy"] + (p["x"] - v["mx"]) * (p["y"] - v["my"])).alias("xy"))),
            lambda m: F.pmod(F.degrees(F.lit(0.5) * F.atan2(F.lit(2.0) * m["xy"], m["xx"] - m["yy"])), F.lit(180.0))))

    return let(c(ring), axis)


def to_utm(lng, lat, central_meridian: float = 57.0):
    """WGS84 to UTM north (series form), metres rounded to 2 decimals: (easting, northing)."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996  # fixed values: ellipsoid and scale
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi, lam = F.radians(c(lat)), F.radians(c(lng))
    s, co, t = F.sin(phi), F.cos(phi), F.tan(phi)
    nn = F.lit(a) / F.sqrt(F.lit(1.0) - F.lit(e2) * s * s)
    tt, cc, aa = t * t, F.lit(ep2) * co * co, co * (lam - F.lit(math.radians(central_meridian)))
    m = F.lit(a) * (F.lit(1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - F.lit(3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(phi * 2.0)
                    + F.lit(15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(phi * 4.0) - F.lit(35 * e2**3 / 3072) * F.sin(phi * 6.0))
    east = F.lit(k0) * nn * (aa + (F.lit(1.0) - tt + cc) * F.pow(aa, 3) / 6.0
                             + (F.lit(5.0) - tt * 18.0 + tt * tt + cc * 72.0 - F.lit(58 * ep2)) * F.pow(aa, 5) / 120.0) + 500000.0
    north = F.lit(k0) * (m + nn * t * (aa * aa / 2.0 + (F.lit(5.0) - tt + cc * 9.0 + cc * cc * 4.0) * F.pow(aa, 4) / 24.0
                                       + (F.lit(61.0) - tt * 58.0 + tt * tt + cc * 600.0 - F.lit(330 * ep2)) * F.pow(aa, 6) / 720.0))
    return js_round(east, 2), js_round(north, 2)


def tile(x, size: float) -> Column:
    return F.floor(c(x) / F.lit(size)).cast("long")


def segment_distance(px, py, ax, ay, bx, by) -> Column:
    """Planar distance from a point to a segment."""
    px, py, ax, ay, bx, by = map(c, (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    l2 = dx * dx + dy * dy
    t = F.when(l2 == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / l2)))
    return F.sqrt(F.pow(px - (ax + t * dx), 2) + F.pow(py - (ay + t * dy), 2))
