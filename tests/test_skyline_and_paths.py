"""Pareto fronts, service choices and breadth-first paths against brute force."""

import random
from collections import deque

import numpy as np
from pyspark.sql import functions as F

from sylvan.operators import access as ac, graph as gr, skyline as sk


def brute(rows):
    a = np.array([r[2:] for r in rows], float)
    return {r[:2] for i, r in enumerate(rows) if not any((a[j] <= a[i]).all() and (a[j] < a[i]).any() and rows[j][0] == r[0] for j in range(len(rows)))}


def test_front_over_chunks_and_blocks(spark):
    rnd = random.Random(4)
    rows = [("hot", i, *[float(rnd.randint(0, 6)) for _ in range(4)]) for i in range(500)] + [("few", i, 1.0, -0.0 if i % 2 else 0.0, 2.0, float(i % 3)) for i in range(9)]
    rows += [("line", i, float(i), float(-i), 0.0, 0.0) for i in range(150)]
    df = spark.createDataFrame(rows, "site string, id int, a double, b double, c double, d double")
    for block in (16, 5000):
        got = {(r.site, r.id) for r in sk.non_dominated(df, ["site"], ["a", "b", "c", "d"], block).collect()}
        assert got == brute(rows)


def test_front_keeps_incomparable_rows_and_empty_tables(spark):
    schema = "site string, id int, a double, b double"
    df = spark.createDataFrame([("s", 1, 0.0, 0.0), ("s", 2, None, 5.0), ("s", 3, 1.0, 1.0), ("s", 4, 0.0, 0.0)], schema)
    assert {r.id for r in sk.non_dominated(df, ["site"], ["a", "b"]).collect()} == {1, 2, 4}
    assert sk.non_dominated(spark.createDataFrame([], schema), ["site"], ["a", "b"]).collect() == []


def test_service_choices_lose_no_front(spark):
    rnd = random.Random(8)
    ids = [f"c{i}" for i in range(14)]
    c = spark.createDataFrame([(1, 1, i, True, *[rnd.randint(0, 4) / 4 for _ in range(4)]) for i in ids], "park_id int, site_id int, candidate_id string, eligible boolean, transit_norm double, intersection_norm double, road_norm double, barrier_norm double")
    pairs = spark.createDataFrame([(1, 1, a, b, rnd.random(), rnd.random(), rnd.random(), rnd.random(), rnd.random()) for i, a in enumerate(ids) for b in ids[i + 1:]],
                                  "park_id int, site_id int, candidate_a string, candidate_b string, distance_m double, overlap_ratio double, additional_a double, additional_b double, combined_population double")
    key = lambda df: {(r.main, r.secondary, r.service) for r in df.collect()}
    every = ac.evaluate_combinations(pairs, c)
    assert every.count() == 14 * 13 * 12
    few = ac.evaluate_combinations(pairs, c, services=ac.service_choices(pairs, c, margin=1e-6))
    assert few.count() < every.count() and key(ac.non_dominated(few)) == key(ac.non_dominated(every))


def plain_path(adj, a, b):
    before, queue = {a: None}, deque([a])
    while queue:
        x = queue.popleft()
        for _, y in sorted(adj.get(x, [])):
            if y not in before:
                before[y] = x
                queue.append(y)
    if b not in before:
        return [a, b]
    out = [b]
    while before[out[-1]] is not None:
        out.append(before[out[-1]])
    return out[::-1]


def test_paths_by_doubling(spark):
    rnd = random.Random(2)
    edges = [("chain", f"n{i}", f"n{i + 1}", i) for i in range(37)] + [("mesh", f"m{rnd.randint(0, 25)}", f"m{rnd.randint(0, 25)}", 100 + i) for i in range(60)]
    adj = {}
    for g, a, b, q in edges:
        if a != b:
            for x, y in ((a, b), (b, a)):
                old = adj.setdefault(g, {}).setdefault(x, [])
                if y not in [z for _, z in old]:
                    old.append((q, y))
    pairs = [("chain", "n0", "n37"), ("chain", "n20", "n3"), ("chain", "n5", "n5"), ("chain", "n1", "away")] + [("mesh", f"m{i}", f"m{j}") for i in (0, 3, 7) for j in range(26)]
    got = gr.bfs_paths(spark.createDataFrame(edges, "g string, source string, target string, seq int"), spark.createDataFrame(pairs + pairs[:2], "g string, start string, end string"), ["g"]).collect()
    assert len(got) == len(pairs) + 2
    for r in got:
        assert r.path == plain_path(adj[r.g], r.start, r.end), (r.g, r.start, r.end)


def test_depth_counts_levels(spark):
    tree, levels = gr.bfs_tree(spark.createDataFrame([(i, i + 1, i) for i in range(6)], "source int, target int, seq int"), spark.createDataFrame([(0,), (99,)], "start int"))
    assert levels == 7 and tree.filter(F.col("start") == 99).count() == 1
