"""Features counted once whatever tiles they share with a candidate, and a search that shuffles no children it has ruled out."""

import math
import random

from sylvan.operators import access as ac
from sylvan.operators import spatial as sp


def test_long_features_count_once(spark):
    rnd = random.Random(5)
    cands = [(0, 0, f"c{i}", rnd.uniform(-500, 500), rnd.uniform(-500, 500)) for i in range(60)]
    segs = []
    for f in range(25):
        x, y = rnd.uniform(-600, 600), rnd.uniform(-600, 600)
        for _ in range(rnd.choice([1, 4])):
            nx, ny = x + rnd.uniform(-350, 350), y + rnd.uniform(-350, 350)
            segs.append((0, f, x, y, nx, ny))
            x, y = nx, ny
    c = spark.createDataFrame(cands, "park_id long, site_id long, candidate_id string, x double, y double")
    s = spark.createDataFrame(segs, "park_id long, feature_id long, ax double, ay double, bx double, by double")

    def dist(px, py, ax, ay, bx, by):
        dx, dy = bx - ax, by - ay
        t = max(0.0, min(1.0, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy)))
        return math.hypot(px - ax - t * dx, py - ay - t * dy)

    want = {}
    for _, _, i, x, y in cands:
        n = len({f for _, f, *e in segs if dist(x, y, *e) <= 100.0})
        if n:
            want[i] = n
    got = ac.features_within(c, s, "feature_id", 100.0, "n")
    assert {r["candidate_id"]: r["n"] for r in got.collect()} == want
    # pairs are not made distinct any more: nothing but (park, candidate) is grouped after the join
    assert "keys=[park_id#" in got._jdf.queryExecution().executedPlan().toString()


def test_search_shuffles_survivors_only(spark):
    """400 queries over a lattice of 64 top nodes: the first level shuffled 64 rows a query before, now a handful."""
    rnd = random.Random(6)
    q = spark.createDataFrame([(0, i, rnd.uniform(0, 1000), rnd.uniform(0, 1000)) for i in range(400)], "park_id long, qid long, x double, y double")
    pts = [(0, i, rnd.uniform(0, 1000), rnd.uniform(0, 1000)) for i in range(1500)]
    t = spark.createDataFrame([(*p, p[2], p[3]) for p in pts], "park_id long, fid long, ax double, ay double, bx double, by double")
    near = sp.nearest_segment(q, t, "qid", "fid")
    got = {r["qid"]: (r["fid"], r["distance"]) for r in near.collect()}
    for _, i, x, y in [tuple(r) for r in q.collect()]:
        d, f = min((math.hypot(x - px, y - py), f) for _, f, px, py in pts)
        assert got[i][0] == f and abs(got[i][1] - d) < 1e-9
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    before = {stages.apply(i).stageId() for i in range(stages.size())}
    near.select("*").write.format("noop").mode("overwrite").save()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    most = max(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()) if stages.apply(i).stageId() not in before)
    assert most < 400 * 32
