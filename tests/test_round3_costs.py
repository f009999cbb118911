"""Steps whose cost grew faster than their input: plans and arrays before and after."""

import os
import random

import numpy as np
import pytest

from sylvan.operators import access as ac
from sylvan.operators import overlay as ov
from sylvan.operators import spatial as sp
from sylvan.plans import QUERIES

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_candidates_never_go_through_the_driver(spark):
    """Candidates are many times the sites they come from, so no small estimate may make them a broadcast table."""
    sites = spark.createDataFrame([(0, i, 50.0 * i) for i in range(5)], "park_id long, site_id long, o double").selectExpr(
        "park_id", "site_id", "array(struct(o as x, o as y), struct(o + 90 as x, o as y), struct(o + 90 as x, o + 70 as y), struct(o as x, o as y)) as ring")
    c = ac.boundary_candidates(sites, 40.0)
    cells = spark.createDataFrame([(0, "h", 60.0, 60.0, 5.0, 1.0, 2.0)], "park_id long, h3_id string, x double, y double, population double, intersection_count_hex double, barrier_score_hex double")
    seg = spark.createDataFrame([(0, 1, 0.0, 0.0, 30.0, 30.0)], "park_id long, feature_id long, ax double, ay double, bx double, by double")
    members = ac.catchment(c, cells, 600.0)
    for df in (members, ac.features_within(c, seg, "feature_id", 600.0, "n"), sp.nearest_segment(c, seg, "candidate_id", "feature_id")):
        assert "strategy=merge" in optimized(df)
    assert "BroadcastExchange" not in members._jdf.queryExecution().executedPlan().toString()
    assert members.count() == c.count()


@pytest.mark.parametrize("seed", range(3))
def test_detours_are_left_out(seed):
    """A dense part keeps its distances, its path numbers and its shares with a fraction of the arcs."""
    rnd = random.Random(seed)
    n, arcs = 60, []
    for a in range(n - 8):
        for b in range(a):
            if rnd.random() < 0.7:
                w = rnd.randint(1, 50)
                arcs += [(b, a, w), (a, b, w)]
    # a second component and two nodes alone
    arcs += [(n - 3, n - 4, 9), (n - 4, n - 3, 9)]
    arcs.sort()
    whole = ov.Piece(n, [a[1] for a in arcs], [a[0] for a in arcs], [a[2] for a in arcs])
    less = whole.without_detours()
    assert len(less.u) < len(whole.u) / 3
    dist = np.full((n, n), ov.FAR)
    dist[np.arange(n), np.arange(n)] = 0
    a, b = whole.relax(dist.copy()), less.relax(dist.copy())
    assert (a == b).all() and a[0, n - 3] == ov.FAR and a[n - 4, n - 3] == 9
    one = np.eye(n)
    na, nb = whole.counts(whole.tight(a), one), less.counts(less.tight(b), one)
    assert (na == nb).all()
    zero = np.zeros((n, n))
    assert np.allclose(whole.shares(whole.tight(a), na, zero), less.shares(less.tight(b), nb, zero))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", ["spatial_conflicts", "opportunity_evidence"])
def test_programs_read_the_reviews_once(spark, name):
    """The scores are used several times; the shares of the topics behind them are there once, without the texts."""
    assert "doc_id" not in optimized(QUERIES[name](spark, SF))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_written_reviews_carry_no_keywords(spark):
    from sylvan.plans import site_queries as sq

    t = sq.review_parks_table(spark, SF)
    assert "keywords" not in t.columns and {"sentiment", "issue_category", "review_text"} <= set(t.columns) and t.count() > 0


@pytest.fixture(params=["10m", "-1"])
def dealt_steps(spark, monkeypatch, request):
    """Few steps to a task, with orders broadcast and merged; gives the steps that are not dealt out."""
    from pyspark.sql import functions as F

    from sylvan.plans import spatial_queries as sq

    monkeypatch.setattr(sq.ad, "STEPS_PER_TASK", 100)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield sq.ad.journeys(spark, SF).withColumn("position", F.struct("position", "part_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_demand_sorts_few_steps_a_task(spark, dealt_steps):
    """The steps are dealt out once, by journey, into a number of partitions that is kept; the rows stay the same."""
    from pyspark.sql import functions as F

    from sylvan.operators import graph as gr

    od, want = QUERIES["od_demand"](spark, SF), gr.od_demand(dealt_steps).withColumn("personas", F.array_join("personas", "|"))
    plan = od._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.count("Exchange hashpartitioning(l_orderkey") == 1 and plan.count("Exchange hashpartitioning(package_id") == 1
    assert od.count() == want.count() and od.exceptAll(want).isEmpty()


def test_demand_journeys_keep_few_steps_a_task(spark, dealt_steps):
    """A task sorts a bounded number of steps, however small they are compressed; the rows stay the same."""
    from pyspark.sql import functions as F

    from sylvan.operators import graph as gr

    legs, want = QUERIES["od_demand_journeys"](spark, SF), gr.od_journeys(dealt_steps)
    per = [r["count"] for r in legs.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert max(per) <= 200 and sum(per) == want.count() and legs.exceptAll(want).isEmpty()
