"""Partitioned shortest paths against a plain search on lattices and odd networks."""

import heapq
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sylvan.operators import graph as gr, overlay as ov

SCHEMA = "park_id long, a long, b long, length double"


def lattice(park, rows, cols, length):
    out = []
    for i in range(rows):
        for j in range(cols):
            if i + 1 < rows:
                out.append((park, i * cols + j, (i + 1) * cols + j, length()))
            if j + 1 < cols:
                out.append((park, i * cols + j, i * cols + j + 1, length()))
    return out


def brute(edges):
    """Distances and summed dependencies from every node."""
    adj, dist, dep = defaultdict(list), {}, defaultdict(float)
    for p, a, b, w in edges:
        w = round(w * 1e6)
        adj[p, a].append(((p, b), w))
        adj[p, b].append(((p, a), w))
    for s in adj:
        d, num, before, order, heap = {s: 0}, {s: 1}, {s: []}, [], [(0, s)]
        while heap:
            x_d, x = heapq.heappop(heap)
            if x in order:
                continue
            order.append(x)
            for y, w in adj[x]:
                if y not in d or x_d + w < d[y]:
                    d[y], num[y], before[y] = x_d + w, num[x], [x]
                    heapq.heappush(heap, (d[y], y))
                elif x_d + w == d[y] and y not in order:
                    num[y] += num[x]
                    before[y].append(x)
        delta = defaultdict(float)
        for x in reversed(order):
            for q in before[x]:
                delta[q] += num[q] / num[x] * (1 + delta[x])
            if x != s:
                dep[x] += delta[x]
        dist.update({(s[0], s[1], x[1]): v / 1e6 for x, v in d.items()})
    return dist, dep


@pytest.fixture(scope="module")
def town():
    rnd = random.Random(1)
    edges = lattice(1, 7, 8, lambda: 1.0) + lattice(2, 6, 6, lambda: float(rnd.randint(1, 3))) + lattice(3, 3, 4, rnd.random)
    # a pair, two components, a star that is larger than a part
    return edges + [(4, 1, 2, 2.5), (5, 10, 11, 1.0), (5, 20, 21, 1.0)] + [(6, 0, i, 1.0 + i % 3) for i in range(1, 30)]


def test_parts_are_bounded_and_cover(spark, town):
    edges = spark.createDataFrame(town, SCHEMA)
    parts = ov.parts(edges, ["park_id"], 12).collect()
    assert len(parts) == len({(r.park_id, r.node) for r in parts}) == edges.select("park_id", F.explode(F.array("a", "b"))).distinct().count()
    size = defaultdict(int)
    for r in parts:
        size[r.park_id, r.part] += 1
    assert max(size.values()) <= 12 and sum(k[0] == 1 for k in size) < 20


def test_everything_over_parts_equals_a_plain_search(spark, town):
    dist, dep = brute(town)
    net = ov.network(spark.createDataFrame(town, SCHEMA), most=12)
    assert net.crossed
    src = net.nodes.select("park_id", F.col("node").alias("src"))
    assert {(r.park_id, r.src, r.node): r.distance for r in ov.distances(net, src).collect()} == dist
    got = {(r.park_id, r.node): r.dependency for r in ov.dependencies(net, src).collect()}
    assert got == pytest.approx({k: v for k, v in dep.items() if v})


def test_bounded_search_and_sources_outside_the_network(spark, town):
    dist, _ = brute(town)
    net = ov.network(spark.createDataFrame(town, SCHEMA), most=12)
    src = spark.createDataFrame([(1, 0), (1, 0), (2, 35), (9, 7), (1, 999)], "park_id long, src long")
    got = {(r.park_id, r.src, r.node): r.distance for r in ov.distances(net, src, 4.0).collect()}
    want = {k: v for k, v in dist.items() if k[:2] in {(1, 0), (2, 35)} and v <= 4.0}
    assert got == {**want, (9, 7, 7): 0.0, (1, 999, 999): 0.0}


def test_space_syntax_is_scaled(spark, town):
    edges = spark.createDataFrame([e for e in town if e[0] in (2, 4)], SCHEMA)
    pos = spark.createDataFrame([(2, i, i / 10, i / 20) for i in range(35)] + [(4, 1, 0.0, 0.0)], "park_id long, node long, lng double, lat double")
    rows = gr.space_syntax(edges, pos).collect()
    two = [r for r in rows if r.park_id == 2]
    assert len(two) == 35 and len(rows) == 36
    assert all(0 <= r.integration <= 100 and 0 <= r.choice <= 100 and 2 <= r.degree <= 4 for r in two)
    assert max(r.choice for r in two) == 100.0 and next(r for r in rows if r.park_id == 4).choice == 0.0


def test_names_as_nodes_and_networks(spark):
    edges = spark.createDataFrame([("x", f"n{i:02d}", f"n{i + 1:02d}", 1.0) for i in range(20)], "town string, a string, b string, length double")
    net = ov.network(edges, ["town"], most=6)
    src = spark.createDataFrame([("x", "n00")], "town string, src string")
    assert {r.node: r.distance for r in ov.distances(net, src).collect()} == {f"n{i:02d}": float(i) for i in range(21)}
    assert {r.node: r.dependency for r in ov.dependencies(net, src).collect()} == {f"n{i:02d}": 20.0 - i for i in range(1, 20)}
