"""Spatial joins, ranks and graph operators against small brute-force checkers."""

import heapq
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sylvan.functions import geo
from sylvan.operators import cells as cl
from sylvan.operators import graph as gr
from sylvan.operators import opportunity as op
from sylvan.operators import ranking as rk
from sylvan.operators import spatial as sp

RING = "array<struct<lng:double,lat:double>>"


def box(x0, y0, x1, y1):
    return [(float(x), float(y)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]


def polygons(spark, items):
    return spark.createDataFrame([(0, n, s, r, min(p[0] for p in r), min(p[1] for p in r), max(p[0] for p in r), max(p[1] for p in r)) for n, s, r in items],
                                 f"park_id int, h3_id string, seq int, ring {RING}, min_lng double, min_lat double, max_lng double, max_lat double")


def test_first_polygon_wins_and_edges_are_half_open(spark):
    pol = polygons(spark, [("a", 0, box(0, 0, 1, 1)), ("b", 1, box(0.5, 0, 2, 1))])
    pts = spark.createDataFrame([(0, 1, 0.7, 0.5), (0, 2, 1.0, 0.5), (0, 3, 0.0, 0.0), (0, 4, 2.0, 0.5), (0, 5, 0.2, 1.0)], "park_id int, feature_id int, lng double, lat double")
    got = {r.feature_id: r.h3_id for r in sp.assign_points_to_polygons(pts, pol, tile=0.3).collect()}
    assert got == {1: "a", 2: "b", 3: "a"}


def test_hot_tile_gives_the_same_result(spark):
    pol = polygons(spark, [(f"c{i}", i, box(i, 0, i + 1, 1)) for i in range(5)])
    pts = spark.range(3000).select(F.lit(0).alias("park_id"), F.col("id").alias("feature_id"), F.when(F.col("id") % 3 < 2, F.lit(2.5)).otherwise(F.col("id") % 5 + F.lit(0.5)).alias("lng"), F.lit(0.5).alias("lat"))
    a = sp.assign_points_to_polygons(pts, pol, tile=10.0, salt=1)
    b = sp.assign_points_to_polygons(pts, pol, tile=0.5, salt=8)
    assert a.count() == 3000 and a.exceptAll(b.select(a.columns)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_matches_brute_force(spark, seed):
    rnd = random.Random(seed)
    q = [(0, f"q{i}", rnd.uniform(0, 1), rnd.uniform(0, 1)) for i in range(30)]
    t = [(0, i, rnd.uniform(0, 0.2), rnd.uniform(0, 0.2)) for i in range(20)]
    qd = spark.createDataFrame(q, "park_id int, h3_id string, lng double, lat double")
    td = spark.createDataFrame(t, "park_id int, feature_id int, lng double, lat double")
    got = {r.h3_id: r.distance for r in sp.nearest_point(qd, td).collect()}
    want = {r.h3_id: r.d for r in qd.crossJoin(td.select(F.col("lng").alias("x"), F.col("lat").alias("y"))).groupBy("h3_id").agg(F.min(geo.haversine_m("lng", "lat", "x", "y")).alias("d")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_clip_area(spark):
    tri = spark.createDataFrame([([(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)],)], "p array<struct<x:double,y:double>>")
    z = F.lit
    assert tri.select(sp.open_area(sp.clip_to_box(F.col("p"), z(0.0), z(0.0), z(2.0), z(2.0)))).first()[0] == pytest.approx(4.0)
    assert tri.select(sp.open_area(sp.clip_to_box(F.col("p"), z(1.0), z(1.0), z(3.0), z(3.0)))).first()[0] == pytest.approx(2.0)
    assert tri.select(sp.open_area(sp.clip_to_box(F.col("p"), z(5.0), z(5.0), z(6.0), z(6.0)))).first()[0] == 0.0


def test_grid_over_slanted_park_never_exceeds_it(spark):
    r = [(0.0, 0.0), (0.002, 0.0), (0.001, 0.001), (0.0, 0.001), (0.0, 0.0)]
    park = spark.createDataFrame([(0, 1, r, 0.0, 0.0, 0.002, 0.001)], f"park_id int, site_id int, ring {RING}, min_lng double, min_lat double, max_lng double, max_lat double")
    cell = polygons(spark, [("a", 0, box(-1, -1, 1, 1))]).withColumn("pop_density_km2", F.lit(1000.0))
    g = sp.square_grid_cells(park, cell)
    full = 0.0015 * 0.001 * (geo.R_EARTH * 3.141592653589793 / 180) ** 2
    total, partial = g.agg(F.sum("area_m2"), F.min("area_m2")).first()
    assert total <= full + 1e-6 and total > 0.9 * full and 5.0 <= partial < 90.0


def test_rank_percentile_histogram(spark):
    d = spark.createDataFrame([("g", float(i % 10), i) for i in range(100)] + [("h", 5.0, 1)], "g string, v double, seq int")
    r = rk.exact_rank(d, ["g"], [F.desc("v"), F.asc("seq")])
    assert r.filter("g = 'g'").select(F.countDistinct("rank"), F.max("rank")).first() == (100, 100) and r.filter("rank = 1 AND g = 'g'").first().seq == 9
    p = {(x.g, x.percentile): x.value for x in rk.percentiles(d, "v", [10, 50, 99], ["g"]).collect()}
    assert p == {("g", 10): 1.0, ("g", 50): 5.0, ("g", 99): 9.0, ("h", 10): 5.0, ("h", 50): 5.0, ("h", 99): 5.0}
    h = rk.histogram(d.filter("g = 'h'"), "v", 4).orderBy("bucket_index").collect()
    assert [(x.bucket, x.n) for x in h] == [(5.0, 1), (6.0, 0), (7.0, 0), (8.0, 0)]


def edges_of(spark, es):
    return gr.routing_edges(spark.createDataFrame([(0, u, v, w, "residential") for u, v, w in es], "park_id int, u long, v long, length double, highway string"))


def dijkstra(adj, s):
    dist, heap = {s: 0.0}, [(0.0, s)]
    while heap:
        d, u = heapq.heappop(heap)
        if d > dist[u]:
            continue
        for v, w in adj[u]:
            if d + w < dist.get(v, 1e18):
                dist[v] = d + w
                heapq.heappush(heap, (d + w, v))
    return dist


def graph_fixture():
    es = [(1, 2, 2.0), (2, 1, 1.0), (2, 3, 1.0), (1, 3, 2.0), (3, 4, 3.0), (4, 4, 1.0), (4, 5, None), (10, 11, 4.0), (2, 4, 4.0)]
    adj = defaultdict(list)
    best = {}
    for u, v, w in es:
        if u != v:
            k = (min(u, v), max(u, v))
            best[k] = min(best.get(k, 1e18), w or 1.0)
    for (u, v), w in best.items():
        adj[u].append((v, w))
        adj[v].append((u, w))
    return es, adj


def test_paths_closeness_betweenness(spark):
    es, adj = graph_fixture()
    e = edges_of(spark, es)
    nodes = sorted(adj)
    src = spark.createDataFrame([(0, n) for n in nodes], "park_id int, src long")
    got = {(r.src, r.node): r.distance for r in gr.shortest_paths(e, src).collect()}
    want = {(s, n): d for s in nodes for n, d in dijkstra(adj, s).items()}
    assert got == want
    near = gr.shortest_paths(e, src.filter("src = 1"), max_distance=2.0)
    assert {r.node for r in near.collect()} == {n for n, d in dijkstra(adj, 1).items() if d <= 2.0}
    close = {r.node: r.closeness for r in gr.closeness(e, src).collect()}
    for s in nodes:
        d = dijkstra(adj, s)
        r = len(d) - 1
        assert close[s] == pytest.approx(r / sum(d.values()) * r / (len(nodes) - 1))
    # path-counting betweenness over all ordered pairs
    between = defaultdict(float)
    for s in nodes:
        d = dijkstra(adj, s)
        sigma = defaultdict(float, {s: 1.0})
        order = sorted(d, key=lambda n: d[n])
        for v in order:
            for u, w in adj[v]:
                if u in d and d[u] + w == d[v]:
                    sigma[v] += sigma[u]
        delta = defaultdict(float)
        for v in reversed(order):
            for u, w in adj[v]:
                if d[u] + w == d[v]:
                    delta[u] += sigma[u] / sigma[v] * (1 + delta[v])
            if v != s:
                between[v] += delta[v]
    n = len(nodes)
    got = {r.node: r.betweenness for r in gr.betweenness(e, src).collect()}
    for v in nodes:
        assert got[v] == pytest.approx(between[v] / ((n - 1) * (n - 2)))


def test_betweenness_query_uses_all_nodes_of_small_networks(spark, monkeypatch):
    from sylvan.plans import QUERIES, spatial_queries

    es, _ = graph_fixture()
    e = edges_of(spark, es)
    src = gr.graph_nodes(e).select("park_id", F.col("node").alias("src"))
    assert src.count() > 5
    want = {r.node: r.betweenness for r in gr.betweenness(e, src).collect()}
    monkeypatch.setattr(spatial_queries.ad, "roads", lambda *_: None)
    monkeypatch.setattr(spatial_queries.gr, "routing_edges", lambda _: e)
    got = {r.node: r.betweenness for r in QUERIES["betweenness"](spark, None).collect()}
    assert got == pytest.approx(want, abs=1e-9) and gr.pivots(e, n=5).count() == 5


def test_bfs_takes_first_discoverer(spark):
    adj = spark.createDataFrame([("a", "b", 1), ("a", "c", 2), ("b", "d", 3), ("c", "d", 4), ("d", "e", 5)], "source string, target string, seq int")
    pairs = spark.createDataFrame([("a", "e"), ("e", "a"), ("a", "z"), ("a", "a")], "start string, end string")
    got = {(r.start, r.end): r.path for r in gr.bfs_paths(adj, pairs).collect()}
    assert got == {("a", "e"): ["a", "b", "d", "e"], ("e", "a"): ["e", "d", "b", "a"], ("a", "z"): ["a", "z"], ("a", "a"): ["a"]}
    long = spark.createDataFrame([(list("abcdef"),)], "p array<string>")
    assert long.select(gr.capped_path(F.col("p"), 3)).first()[0] == list("abcdf")


def test_od_demand_example(spark):
    steps = [("k", "A", "p1", 0.4, i, s) for i, s in enumerate("XYZ")] + [("k", "B", "p2", 0.6, i, s) for i, s in enumerate("XY")]
    d = spark.createDataFrame(steps, "package_id string, journey_id string, persona_id string, weight double, position int, space string")
    got = {(r.origin, r.destination): (r.weight, r.journeys, r.personas) for r in gr.od_demand(d).collect()}
    assert got == {("X", "Y"): (1.0, 2, ["p1", "p2"]), ("Y", "Z"): (0.4, 1, ["p1"])}


def test_bands_are_cumulative(spark):
    c = spark.createDataFrame([(0, "a", 100.0, 4.0), (0, "b", 50.0, 12.0), (0, "c", 70.0, None)], "park_id int, h3_id string, population double, walking_time_to_park_minutes double")
    for f in ("hex_area_km2", "school_count", "bus_stop_count", "clinic_count", "mosque_count", "restaurant_count", "cafe_count", "shop_count", "network_distance_to_park_m", "route_directness_ratio"):
        c = c.withColumn(f, F.lit(1.0))
    got = [(r.minutes, r.population, r.hex_count) for r in cl.walking_catchments(c).orderBy("minutes").collect()]
    assert got == [(5, 100.0, 1), (10, 100.0, 1), (15, 150.0, 2), (20, 150.0, 2)]


def greedy(c, want, band, loop):
    """Plain-Python route selection over dicts with id, x, y, o."""
    import math
    if len(c) <= want:
        return {p["id"] for p in c}
    rmax = max(max(math.hypot(p["x"], p["y"]) for p in c), 1e-9)
    lo, hi = min(p["o"] for p in c), max(p["o"] for p in c)
    opp = lambda p: (p["o"] - lo) / max(1, hi - lo)
    fit = lambda p, w: 1 - min(1, abs(math.hypot(p["x"], p["y"]) / rmax - band) / w)
    sel, rest = [], list(c)
    if loop:
        for s in range(want):
            cand = [p for p in rest if math.floor((math.atan2(p["y"], p["x"]) + 2 * math.pi) % (2 * math.pi) / (2 * math.pi) * want) == s]
            if cand:
                b = min(cand, key=lambda p: (-(0.55 * opp(p) + 0.45 * fit(p, 0.3)), p["id"]))
                sel.append(b)
                rest.remove(b)
    while len(sel) < want and rest:
        def rank(p):
            spread = 0.5 if not sel else min(1, min(math.hypot(p["x"] - q["x"], p["y"] - q["y"]) for q in sel) / (rmax * 0.55))
            return 0.5 * opp(p) + 0.25 * fit(p, 0.45) + 0.25 * spread
        b = min(rest, key=lambda p: (-rank(p), p["id"]))
        sel.append(b)
        rest.remove(b)
    return {p["id"] for p in sel}


@pytest.mark.parametrize("loop", [True, False])
def test_movement_selection_matches_brute_force(spark, loop):
    rnd = random.Random(5)
    pts = [{"id": f"c{i:02d}", "x": rnd.uniform(-1, 1), "y": rnd.uniform(-1, 1), "o": float(rnd.randrange(100))} for i in range(40)]
    d = spark.createDataFrame([(0, "r", p["id"], p["x"], p["y"], 0.0, 0.0, p["o"], False) for p in pts], "park_id int, program string, h3_id string, lng double, lat double, center_lng double, center_lat double, opportunity double, avoided boolean")
    got = {r.h3_id for r in op.movement_cell_selection(d, routes=[("r", 0.7, loop, 6)]).collect()}
    assert got == greedy(pts, 6, 0.7, loop)
