"""Entrance candidates on a site boundary, their metrics, pairs and combinations.

All geometry is planar (metres).  Candidates of many sites are processed together; every
distance comes from a tile join, every catchment from an equi-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.numeric import count_where
from . import skyline
from .spatial import _cover, nearest_segment

SITE = ("park_id", "site_id")


def boundary_candidates(sites: DataFrame, spacing: float, group_cols=SITE) -> DataFrame:
    """ceil(length / spacing) mid-cell points per boundary edge; ``ring``: closed array<struct<x,y>>."""
    r = F.col("ring")
    edges = F.transform(F.sequence(F.lit(0), F.size(r) - 2), lambda i: F.struct(
        (i + 1).alias("edge"), F.get(r, i)["x"].alias("ax"), F.get(r, i)["y"].alias("ay"), F.get(r, i + 1)["x"].alias("bx"), F.get(r, i + 1)["y"].alias("by")))
    e = sites.select(*group_cols, F.inline(edges))
    ln = F.sqrt(F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by") - F.col("ay"), 2))
    e = e.withColumn("_n", F.greatest(F.lit(1), F.ceil(ln / spacing)).cast("int")).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    t = (F.col("_i") - F.lit(0.5)) / F.col("_n")
    return e.select(*group_cols, "edge", F.col("_i").alias("index"), t.alias("t"), (F.col("ax") + (F.col("bx") - F.col("ax")) * t).alias("x"), (F.col("ay") + (F.col("by") - F.col("ay")) * t).alias("y"),
                    F.concat_ws("-", F.lit("access-edge"), F.col("site_id").cast("string"), F.col("edge").cast("string"), F.col("_i").cast("string")).alias("candidate_id"))


def _around(cands: DataFrame, radius: float, park: str) -> DataFrame:
    """Candidates in their tile and the eight around it; one shape, so that several joins share one shuffle.

    Sites are few and candidates many times as many, which the planner's estimate leaves out: without
    the hint it takes these rows for a small table and sends them all through the driver.
    """
    near = F.array(*[F.struct((geo.tile("x", radius) + dx).alias("_tx"), (geo.tile("y", radius) + dy).alias("_ty")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    return cands.select(park, "site_id", "candidate_id", "x", "y", F.inline(near)).hint("merge")


def features_within(cands: DataFrame, segments: DataFrame, feature: str, radius: float, out: str, park: str = "park_id") -> DataFrame:
    """Features with any segment within ``radius`` of each candidate.

    A feature is one row with its segments.  It meets a candidate in every tile they share; the
    lowest of these keeps the pair, so pairs need no distinct and counts combine before the shuffle.
    """
    s = segments.groupBy(park, feature).agg(
        F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("_segments"), F.min(F.least("ax", "bx")).alias("_x0"), F.min(F.least("ay", "by")).alias("_y0"),
        F.max(F.greatest("ax", "bx")).alias("_x1"), F.max(F.greatest("ay", "by")).alias("_y1"))
    j = _around(cands, radius, park).join(_cover(s, radius, "_x0", "_y0", "_x1", "_y1"), [park, "_tx", "_ty"])
    j = j.filter((F.col("_tx") == F.greatest(geo.tile("x", radius) - 1, geo.tile("_x0", radius))) & (F.col("_ty") == F.greatest(geo.tile("y", radius) - 1, geo.tile("_y0", radius))))
    near_box = (F.col("x") >= F.col("_x0") - radius * 1.000001) & (F.col("x") <= F.col("_x1") + radius * 1.000001) & (F.col("y") >= F.col("_y0") - radius * 1.000001) & (F.col("y") <= F.col("_y1") + radius * 1.000001)
    j = j.filter(near_box).filter(F.exists("_segments", lambda g: geo.segment_distance("x", "y", g["ax"], g["ay"], g["bx"], g["by"]) <= radius))
    return j.groupBy(park, "candidate_id").agg(F.count(F.lit(1)).alias(out))


def catchment(cands: DataFrame, cells: DataFrame, radius: float, park: str = "park_id") -> DataFrame:
    """Candidate x cell membership within ``radius`` with the distance."""
    c = cells.select(park, "h3_id", F.col("x").alias("_cx"), F.col("y").alias("_cy"), "population", "intersection_count_hex", "barrier_score_hex").withColumns({"_tx": geo.tile("_cx", radius), "_ty": geo.tile("_cy", radius)})
    d = F.sqrt(F.pow(F.col("x") - F.col("_cx"), 2) + F.pow(F.col("y") - F.col("_cy"), 2))
    j = _around(cands, radius, park).join(c, [park, "_tx", "_ty"]).withColumn("d", d).filter(F.col("d") <= radius)
    return j.select(park, "site_id", "candidate_id", "h3_id", "d", F.coalesce("population", F.lit(0.0)).alias("population"), "intersection_count_hex", "barrier_score_hex")


def candidate_metrics(cands: DataFrame, members: DataFrame, roads: DataFrame, schools: DataFrame, buildings: DataFrame, bus: DataFrame, radius: float, park: str = "park_id") -> DataFrame:
    """Nearest distances, catchment sums and generator counts; layers are segment tables with an id column."""
    out = cands
    for name, layer, fid in (("nearest_road_m", roads, "segment_id"), ("nearest_school_m", schools, "feature_id"), ("nearest_building_m", buildings, "building_id"), ("nearest_bus_m", bus, "feature_id")):
        n = nearest_segment(cands, layer, "candidate_id", fid, group_cols=(park,)).select(park, "candidate_id", F.col("distance").alias(name))
        out = out.join(n, [park, "candidate_id"], "left")
    m = members.groupBy(park, "candidate_id").agg(
        F.sum(F.col("population") * F.greatest(F.lit(0.0), F.lit(1.0) - F.col("d") / radius)).alias("population_pull"), F.sum("population").alias("population_within"),
        F.sum(F.coalesce("intersection_count_hex", F.lit(0.0))).alias("intersections"), F.avg("barrier_score_hex").alias("avg_barrier"))
    out = out.join(m, [park, "candidate_id"], "left")
    for name, layer, fid in (("schools_within", schools, "feature_id"), ("buildings_within", buildings, "building_id")):
        out = out.join(features_within(cands, layer, fid, radius, name, park), [park, "candidate_id"], "left")
    return out.fillna(0, ["population_pull", "population_within", "intersections", "schools_within", "buildings_within"])


def candidate_exclusions(c: DataFrame, road_max: float) -> DataFrame:
    """Ordered exclusion reasons and the eligibility that follows from them."""
    road = F.col("nearest_road_m")
    facing = lambda x: F.col(x).isNotNull() & (road.isNull() | (F.col(x) < road))
    reasons = F.array_compact(F.array(
        F.when(road.isNull() | (road > road_max), F.lit("not_within_approved_road_edge_distance")),
        F.when(facing("nearest_school_m"), F.lit("school_facing_edge")), F.when(facing("nearest_building_m"), F.lit("building_facing_edge"))))
    return c.withColumn("hard_exclusions", reasons).withColumn("eligible", F.size("hard_exclusions") == 0)


NORMALISED = [("population_pull", "population_norm", False), ("nearest_bus_m", "transit_norm", True), ("intersections", "intersection_norm", False), ("nearest_road_m", "road_norm", True), ("avg_barrier", "barrier_norm", True)]


def candidate_normalise(c: DataFrame, group_cols=SITE) -> DataFrame:
    """Five metrics on 0-1 within the site: 1 when flat (0 when inverse), 0 when missing."""
    keys = list(group_cols)
    agg = []
    for m, _, _ in NORMALISED:
        agg += [F.min(m).alias(f"_lo_{m}"), F.max(m).alias(f"_hi_{m}")]
    j = c.join(c.groupBy(*keys).agg(*agg), keys)
    for m, out, inv in NORMALISED:
        lo, hi = F.col(f"_lo_{m}"), F.col(f"_hi_{m}")
        x = F.when(hi == lo, F.lit(1.0)).otherwise((F.col(m) - lo) / (hi - lo))
        j = j.withColumn(out, F.when(F.col(m).isNull(), F.lit(0.0)).otherwise((F.lit(1.0) - x) if inv else x))
    return j.drop(*[f"_lo_{m}" for m, _, _ in NORMALISED], *[f"_hi_{m}" for m, _, _ in NORMALISED])


def candidate_pairs(c: DataFrame, members: DataFrame, group_cols=SITE) -> DataFrame:
    """All eligible pairs of a site: distance, same edge, catchment overlap, marginal and union population.

    The overlap comes from joining the memberships on the cell, so no catchment set is built;
    union and margins follow by inclusion and exclusion.
    """
    keys = list(group_cols)
    e = c.filter("eligible").select(*keys, "candidate_id", "edge", "index", "x", "y", "population_within")
    a = e.select(*keys, *[F.col(x).alias(f"a_{x}") for x in ("candidate_id", "edge", "index", "x", "y", "population_within")])
    b = e.select(*keys, *[F.col(x).alias(f"b_{x}") for x in ("candidate_id", "edge", "index", "x", "y", "population_within")])
    before = (F.col("a_edge") < F.col("b_edge")) | ((F.col("a_edge") == F.col("b_edge")) & (F.col("a_index") < F.col("b_index")))
    p = a.join(b, keys).filter(before)
    m = members.join(e.select(*keys, "candidate_id"), [*keys, "candidate_id"], "left_semi")
    s = m.select(*keys, "h3_id", F.col("candidate_id").alias("a_candidate_id"), "population").join(m.select(*keys, "h3_id", F.col("candidate_id").alias("b_candidate_id")), [*keys, "h3_id"])
    s = s.filter(F.col("a_candidate_id") != F.col("b_candidate_id")).groupBy(*keys, "a_candidate_id", "b_candidate_id").agg(F.sum("population").alias("shared"))
    p = p.join(s, [*keys, "a_candidate_id", "b_candidate_id"], "left").withColumn("shared", F.coalesce("shared", F.lit(0.0)))
    union = F.col("a_population_within") + F.col("b_population_within") - F.col("shared")
    return p.select(*keys, F.col("a_candidate_id").alias("candidate_a"), F.col("b_candidate_id").alias("candidate_b"),
                    F.sqrt(F.pow(F.col("a_x") - F.col("b_x"), 2) + F.pow(F.col("a_y") - F.col("b_y"), 2)).alias("distance_m"), (F.col("a_edge") == F.col("b_edge")).alias("same_edge"),
                    F.when(union > 0, F.col("shared") / union).otherwise(F.lit(0.0)).alias("overlap_ratio"), (F.col("a_population_within") - F.col("shared")).alias("additional_a"),
                    (F.col("b_population_within") - F.col("shared")).alias("additional_b"), union.alias("combined_population"))


def candidate_summary(c: DataFrame, pairs: DataFrame, group_cols=SITE) -> DataFrame:
    keys = list(group_cols)
    g = c.groupBy(*keys).agg(F.count(F.lit(1)).alias("candidates"), count_where(F.col("eligible")).alias("eligible"),
                             count_where(F.array_contains("hard_exclusions", "school_facing_edge")).alias("school_facing"), count_where(F.array_contains("hard_exclusions", "building_facing_edge")).alias("building_facing"))
    return g.join(pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs")), keys, "left").fillna(0, ["pairs"])


OBJECTIVES = ["o_combined", "o_additional", "o_overlap", "o_separation", "o_transit", "o_intersections", "o_service_road", "o_low_barrier"]


def service_choices(pairs: DataFrame, c: DataFrame, group_cols=SITE, margin: float = 0.0) -> DataFrame:
    """Candidates worth trying as service entrance beside any pair: fewer than three others beat them on road and barrier.

    A pair rules out two candidates at most, so whatever three others beat is beaten beside every
    pair.  ``margin``: half a unit or more of the rounding that objectives get afterwards.
    """
    e = c.filter("eligible").select(*group_cols, "candidate_id", "road_norm", "barrier_norm")
    return skyline.band(e, group_cols, "candidate_id", ["road_norm", "barrier_norm"], 3, pairs, ("candidate_a", "candidate_b"), [2 * margin, 6 * margin])


def evaluate_combinations(pairs: DataFrame, c: DataFrame, group_cols=SITE, services: DataFrame | None = None, salt: int = 16) -> DataFrame:
    """Main x secondary x service choices of three different eligible candidates with their 8 minimised objectives.

    All candidates are tried as service entrance, or those in ``services`` (group, candidate_id).
    Pairs are dealt by site and main entrance, so one site fills ``salt`` tasks.
    """
    keys = list(group_cols)
    both = pairs.select(*keys, F.inline(F.array(
        F.struct(F.col("candidate_a").alias("main"), F.col("candidate_b").alias("secondary"), F.col("additional_b").alias("_add"), "distance_m", "overlap_ratio", "combined_population"),
        F.struct(F.col("candidate_b").alias("main"), F.col("candidate_a").alias("secondary"), F.col("additional_a").alias("_add"), "distance_m", "overlap_ratio", "combined_population"))))
    n = c.filter("eligible").select(*keys, "candidate_id", "transit_norm", "intersection_norm", "road_norm", "barrier_norm")
    ren = lambda who: n.select(*keys, F.col("candidate_id").alias(who), *[F.col(x).alias(f"{who}_{x}") for x in ("transit_norm", "intersection_norm", "road_norm", "barrier_norm")])
    third = ren("service")
    if services is not None:
        third = third.join(services.withColumnRenamed("candidate_id", "service"), [*keys, "service"], "left_semi")
    third = third.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    t = both.join(ren("main"), [*keys, "main"]).join(ren("secondary"), [*keys, "secondary"]).withColumn("_s", F.pmod(F.hash("main"), F.lit(salt)))
    t = t.join(third, [*keys, "_s"]).filter((F.col("service") != F.col("main")) & (F.col("service") != F.col("secondary")))
    return t.select(*keys, "main", "secondary", "service", (-F.col("combined_population")).alias("o_combined"), (-F.col("_add")).alias("o_additional"), F.col("overlap_ratio").alias("o_overlap"), (-F.col("distance_m")).alias("o_separation"),
                    (-(F.col("main_transit_norm") + F.col("secondary_transit_norm"))).alias("o_transit"), (-(F.col("main_intersection_norm") + F.col("secondary_intersection_norm"))).alias("o_intersections"),
                    (-F.col("service_road_norm")).alias("o_service_road"), (-(F.col("main_barrier_norm") + F.col("secondary_barrier_norm") + F.col("service_barrier_norm")) / 3.0).alias("o_low_barrier"))


def non_dominated(t: DataFrame, group_cols=SITE, objectives=None) -> DataFrame:
    """Combinations that no other combination of the same site beats in one objective without losing in another."""
    return skyline.non_dominated(t, group_cols, objectives or OBJECTIVES)
