"""Adaptive nearest search: crowded spots, lone queries, ties, lines, areas without targets."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sylvan.operators import quadtree as qt, spatial as sp


def metres(a, b, c, d):
    h = math.pi / 360
    x = math.sin((d - b) * h) ** 2 + math.cos(b * 2 * h) * math.cos(d * 2 * h) * math.sin((c - a) * h) ** 2
    return 2 * 6371008.8 * math.asin(min(1, math.sqrt(x)))


@pytest.fixture(scope="module")
def crowd():
    rnd = random.Random(6)
    # half of all points within a few metres, copies among them, the rest over a country and beyond the date line
    t = [(0, f"c{i}", 10 + rnd.random() * 1e-4, 50 + rnd.random() * 1e-4) for i in range(400)] + [(0, f"d{i}", 10.00005, 50.00005) for i in range(60)]
    t += [(0, f"w{i}", rnd.uniform(5, 15), rnd.uniform(45, 55)) for i in range(400)] + [(1, "only", 179.9, 0.5), (3, "x", -179.5, 10.0), (3, "y", 170.0, 10.0)]
    q = [(0, f"q{i}", rnd.uniform(4, 16), rnd.uniform(44, 56)) for i in range(150)] + [(0, f"n{i}", 10 + rnd.random() * 1e-4, 50 + rnd.random() * 1e-4) for i in range(150)]
    return q + [(0, "far", -60.0, -40.0), (0, "same", 10.00005, 50.00005), (1, "e", -179.9, 0.5), (2, "none", 1.0, 1.0), (3, "z", 179.9, 10.0)], t


def test_points_against_brute_force(spark, crowd):
    q, t = crowd
    qd = spark.createDataFrame(q, "park_id int, h3_id string, lng double, lat double")
    td = spark.createDataFrame(t, "park_id int, feature_id string, lng double, lat double")
    got = {r.h3_id: (r.distance, r.feature_id) for r in sp.nearest_point(qd, td).collect()}
    assert len(got) == len(q)
    for park, i, x, y in q:
        near = [(metres(x, y, a, b), f) for p, f, a, b in t if p == park]
        if not near:
            assert got[i] == (None, None)
            continue
        assert got[i][0] == pytest.approx(min(near)[0], abs=1e-6)
    assert got["same"][1] == "d0"


def test_no_node_of_a_crowded_area_is_large_and_few_are_looked_at(spark, crowd):
    _, t = crowd
    td = spark.createDataFrame(t, "park_id int, feature_id string, _px double, _py double").withColumns({"_x0": F.col("_px"), "_x1": F.col("_px"), "_y0": F.col("_py"), "_y1": F.col("_py")})
    cells, members = qt.tree(td, ["park_id"], ["_px", "_py"], "feature_id", "feature_id")
    # 460 of 860 points share one cell of the first level; only what the finest grid cannot part stays together
    sizes = members.groupBy("park_id", "id4").count()
    fine = cells.groupBy("park_id", "id4").count().withColumnRenamed("count", "cells")
    assert sizes.join(fine, ["park_id", "id4"]).filter("count > 16 and cells > 1").isEmpty()
    assert members.count() == 804


def test_segments_against_brute_force(spark):
    rnd = random.Random(7)
    seg = [(0, i, *[rnd.uniform(0, 1000) for _ in range(4)]) for i in range(60)] + [(0, 100 + i, x := rnd.uniform(0, 9), y := rnd.uniform(0, 9), x + 1, y) for i in range(120)] + [(0, 999, 5.0, 5.0, 5.0, 5.0)]
    q = [(0, i, rnd.uniform(-200, 1200), rnd.uniform(-200, 1200)) for i in range(120)]

    def d(px, py, ax, ay, bx, by):
        dx, dy = bx - ax, by - ay
        l2 = dx * dx + dy * dy
        k = 0 if l2 == 0 else max(0, min(1, ((px - ax) * dx + (py - ay) * dy) / l2))
        return math.hypot(px - ax - k * dx, py - ay - k * dy)

    got = {r.qid: r.distance for r in sp.nearest_segment(spark.createDataFrame(q, "park_id int, qid int, x double, y double"), spark.createDataFrame(seg, "park_id int, sid int, ax double, ay double, bx double, by double"), "qid", "sid").collect()}
    for _, i, x, y in q:
        assert got[i] == pytest.approx(min(d(x, y, *s[2:]) for s in seg))
