"""Program opportunities: 44 programs scored on every site cell, summaries, conflicts, evidence.

All cell signals are computed once per cell; the programs are then fanned out with one
generator (44 rows per cell), so the formula table is never cross-joined.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import programs as pg
from ..functions.numeric import clamp, count_where, js_round, norm
from ..functions.session import cut_lineage, fixed_table
from .filters import park_site_filter
from .ranking import exact_rank

PARK = ("park_id",)
TOPICS = list(dict.fromkeys(p["topic"] for p in pg.PROGRAMS if p["topic"]))


def clamp100(x):
    return clamp(js_round(x), F.lit(0.0), F.lit(100.0))


def _opportunity(d, s, f):
    return clamp100(d * F.lit(0.4) + s * F.lit(0.35) + f * F.lit(0.25))


def topic_rates(impact: DataFrame, group_cols=PARK) -> DataFrame:
    """One row per area: map topic -> share of mentions, and topic -> mentions (at most one entry per category)."""
    return impact.groupBy(*group_cols).agg(
        F.map_from_entries(F.collect_list(F.struct("issue_category", "mention_share"))).alias("topic_share"),
        F.map_from_entries(F.collect_list(F.struct("issue_category", "mentions"))).alias("topic_mentions"))


def demand_sql(p) -> str:
    return re.sub(r"\bnl\b", f"nl_{TOPICS.index(p['topic'])}" if p["topic"] else "0e0", p["demand"])


def score_programs(cells: DataFrame, rates: DataFrame, group_cols=PARK) -> DataFrame:
    """Long table program x cell with demand, suitability, feasibility, opportunity, avoid reason.

    ``cells`` are scored cells; only those with park area count, and the review signal is
    spread over exactly these.
    """
    keys = list(group_cols)
    site = park_site_filter(cells)
    tot = site.groupBy(*keys).agg(F.sum(F.coalesce("population", F.lit(0.0))).alias("_p"), F.count(F.lit(1)).alias("_n"))
    site = site.join(tot, keys).join(rates.select(*keys, "topic_share"), keys, "left")
    share = F.coalesce("population", F.lit(0.0)) / F.when(F.col("_p") == 0, F.lit(1.0)).otherwise(F.col("_p"))
    nl = [js_round(norm(share * F.coalesce(F.try_element_at("topic_share", F.lit(t)), F.lit(0.0)) * 100.0 * F.col("_n"), 100)).alias(f"nl_{i}") for i, t in enumerate(TOPICS)]
    base = site.select(*keys, "h3_id", "seq", "lng", "lat", "center_lng", "center_lat", F.coalesce("population", F.lit(0.0)).alias("population"), *nl,
                       *[F.expr(e).alias(k) for k, e in pg.SIGNALS.items()])

    def row(i, p):
        avoid = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r in p["avoid"]) + " END" if p["avoid"] else "CAST(NULL AS STRING)"
        return F.struct(F.lit(i).alias("program_order"), F.lit(p["type"]).alias("program"), F.expr(demand_sql(p)).alias("_d"), F.expr(p["suitability"]).alias("_s"),
                        F.expr(p["feasibility"]).alias("_f"), F.expr(avoid).alias("avoid_reason"))

    long = base.select(*keys, "h3_id", "seq", "lng", "lat", "center_lng", "center_lat", "population", F.inline(F.array(*[row(i, p) for i, p in enumerate(pg.PROGRAMS)])))
    long = long.withColumns({"demand": clamp100(F.col("_d")), "suitability": clamp100(F.col("_s")), "avoided": F.col("avoid_reason").isNotNull(),
                             "feasibility": F.when(F.col("avoid_reason").isNotNull(), F.lit(0.0)).otherwise(clamp100(F.col("_f")))}).drop("_d", "_s", "_f")
    return long.withColumn("opportunity", _opportunity(F.col("demand"), F.col("suitability"), F.col("feasibility")))


def program_catalogue(spark) -> DataFrame:
    """Fixed descriptive columns of the 44 programs."""
    rows = []
    for i, p in enumerate(pg.PROGRAMS):
        a = pg.area_of(p) or (None, None, None)
        rows.append((i, p["type"], p["name"], p["category"], p["geometry"], p["scale"], p["topic"], p["sources"], pg.users_of(p), *a, pg.readiness_of(p), p["preferred"], p["avoided"], p["service"], p["movement"]))
    return fixed_table(spark, rows, "program_order int, program string, name string, category string, geometry_type string, scale string, topic string, sources array<string>, users array<string>,"
                       "min_area double, target_area double, max_area double, readiness double, preferred array<string>, avoid_adjacent array<string>, service array<string>, movement array<string>")


def program_summary(scored: DataFrame, rates: DataFrame, group_cols=PARK, roads_known: bool = True) -> DataFrame:
    """Per area and program: population-weighted scores over eligible cells, confidence, priority, areas."""
    keys = list(group_cols)
    ok = ~F.col("avoided")
    agg = [F.count(F.lit(1)).alias("cells"), count_where(ok).alias("eligible"), F.sum(F.when(ok, F.col("population")).otherwise(0.0)).alias("_pop")]
    for c in ("demand", "suitability", "feasibility"):
        agg += [F.sum(F.when(ok, F.col(c) * F.col("population")).otherwise(0.0)).alias(f"_w_{c}"), F.avg(F.when(ok, F.col(c))).alias(f"_a_{c}")]
    agg.append(F.sort_array(F.collect_set("avoid_reason")).alias("avoid_reasons"))  # at most two texts per program
    g = scored.groupBy(*keys, "program").agg(*agg)
    for c in ("demand", "suitability", "feasibility"):
        g = g.withColumn(c, F.when(F.col("eligible") == 0, F.lit(0.0)).when(F.col("_pop") <= 1, js_round(f"_a_{c}")).otherwise(js_round(F.col(f"_w_{c}") / F.col("_pop"))))
    g = g.withColumn("opportunity", _opportunity(F.col("demand"), F.col("suitability"), F.col("feasibility")))
    g = g.join(program_catalogue(scored.sparkSession), "program").join(rates.select(*keys, "topic_mentions"), keys, "left")
    g = g.withColumn("mentions", F.when(F.col("topic").isNotNull(), F.coalesce(F.try_element_at("topic_mentions", F.col("topic")), F.lit(0))).otherwise(F.lit(0)).cast("long"))
    conf = F.lit(60.0 + (10.0 if roads_known else 0.0)) + F.least(F.lit(20), F.col("mentions") * 2) + F.when(F.col("eligible") > F.col("cells") * 0.3, 10.0).otherwise(0.0)
    g = g.withColumns({"confidence": clamp100(conf), "priority": F.when(F.col("opportunity") >= 75, "Critical").when(F.col("opportunity") >= 55, "High").when(F.col("opportunity") >= 30, "Medium").otherwise("Low")})
    return g.select(*keys, "program", "program_order", "name", "category", "geometry_type", "scale", "sources", "users", "opportunity", "demand", "suitability", "feasibility", "confidence", "readiness", "priority",
                    "min_area", "target_area", "max_area", "cells", "eligible", "mentions", "topic", "avoid_reasons", "preferred", "avoid_adjacent", "service", "movement")


def top_program_cells(scored: DataFrame, n: int = 15, group_cols=PARK) -> DataFrame:
    """Best cells per program; the ranked filter is applied before the shuffle as well."""
    w = W.partitionBy(*group_cols, "program").orderBy(F.desc("opportunity"), F.asc("seq"))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def spatial_conflicts(scored: DataFrame, group_cols=PARK) -> DataFrame:
    """Cells with the penalty of attractor cores applied.

    Core = the best 10 % of all cells by suitability among those not avoided.  The ranking
    is split over tasks, so a large park is not sorted in one.
    """
    keys = list(group_cols)
    attractors = [a for a, _ in pg.CONFLICTS]
    tot = scored.filter(F.col("program") == attractors[0]).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    cand = scored.filter(F.col("program").isin(attractors) & ~F.col("avoided")).select(*keys, "program", "h3_id", "suitability", "seq")
    ranked = exact_rank(cand, [*keys, "program"], [F.desc("suitability"), F.asc("seq")], "_r").join(tot, keys)
    core = ranked.filter(F.col("_r") <= F.greatest(F.lit(1.0), js_round(F.col("_n") * pg.CONFLICT_SHARE)))
    pairs = fixed_table(scored.sparkSession, [(a, r) for a, rs in pg.CONFLICTS for r in rs], "attractor string, repelled string")
    hit = core.join(pairs, F.col("program") == F.col("attractor")).select(*keys, "h3_id", F.col("repelled").alias("program")).distinct().withColumn("_hit", F.lit(True))
    j = scored.join(hit, [*keys, "h3_id", "program"], "left")
    on = F.coalesce("_hit", F.lit(False)) & ~F.col("avoided")
    s = F.when(on, clamp100(F.col("suitability") - pg.CONFLICT_PENALTY)).otherwise(F.col("suitability"))
    j = j.withColumns({"in_core": on, "suitability": s})
    return j.withColumn("opportunity", F.when(F.col("in_core"), _opportunity(F.col("demand"), F.col("suitability"), F.col("feasibility"))).otherwise(F.col("opportunity"))).drop("_hit")


def opportunity_evidence(summary: DataFrame, impact: DataFrame, group_cols=PARK) -> DataFrame:
    """What each program's scores rest on, one row per item: position, code, score, n, total, topic, note.

    Codes: demand (score over n cells), reviews (n mentions of the topic, score = negative percent),
    no_mentions, no_topic, note (the program's published remark on its topic), suitability,
    feasibility (n of total cells eligible), constraint (one per triggered reason, in ``note``).
    """
    keys = list(group_cols)
    i = impact.select(*keys, F.col("issue_category").alias("topic"), js_round(F.col("negative_share") * 100.0).alias("_neg"))
    j = summary.join(i, [*keys, "topic"], "left")
    kind = "struct<position:int,code:string,score:double,n:bigint,total:bigint,topic:string,note:string>"

    def item(position, code, score=None, n=None, total=None, topic=None, note=None):
        return F.struct(*[x if x is not None else F.lit(None) for x in (F.lit(position), code, score, n, total, topic, note)]).cast(kind)

    topic, seen = F.col("topic"), F.col("mentions") > 0
    review = (F.when(topic.isNull(), item(2, F.lit("no_topic"))).when(seen, item(2, F.lit("reviews"), F.coalesce("_neg", F.lit(0.0)), F.col("mentions"), topic=topic))
              .otherwise(item(2, F.lit("no_mentions"), topic=topic)))
    remark = F.try_element_at(F.create_map(*[F.lit(x) for kv in pg.TOPIC_NOTES.items() for x in kv]), F.col("program"))
    items = F.array(item(1, F.lit("demand"), F.col("demand"), F.col("cells")), review, F.when(remark.isNotNull(), item(3, F.lit("note"), topic=topic, note=remark)),
                    item(4, F.lit("suitability"), F.col("suitability")), item(5, F.lit("feasibility"), F.col("feasibility"), F.col("eligible"), F.col("cells")))
    constraints = F.transform("avoid_reasons", lambda r, k: item(6, F.lit("constraint"), note=r).withField("position", (k + 6).cast("int")))
    return j.select(*keys, "program", F.inline(F.filter(F.concat(items, constraints), lambda x: x.isNotNull())))


def all_opportunities(summary: DataFrame, group_cols=PARK) -> DataFrame:
    """Summaries ranked by opportunity; ties keep catalogue order."""
    w = W.partitionBy(*group_cols).orderBy(F.desc("opportunity"), F.asc("program_order"))
    return summary.withColumn("rank", F.row_number().over(w))


def summary_opportunities(summary: DataFrame, group_cols=PARK) -> DataFrame:
    """The opportunity rows of the headline summary: every program of an area in rank order with scores, users, areas and adjacency lists."""
    cols = ["program", "name", "category", "geometry_type", "scale", "opportunity", "demand", "suitability", "feasibility", "confidence", "readiness", "priority", "users",
            "min_area", "target_area", "max_area", "preferred", "avoid_adjacent", "service", "movement"]
    return all_opportunities(summary, group_cols).select(*group_cols, "rank", *cols)


# Movement routes (program, radial band, closed loop?, cells to select).
ROUTES = [("walkingPromenade", 0.45, False, 12), ("joggingLoop", 0.76, True, 14), ("exerciseCyclingLoop", 0.96, True, 16), ("accessibleRoutes", 0.4, False, 10),
          ("shadedCirculation", 0.48, False, 10), ("serviceAccess", 1.0, False, 2)]


def movement_cell_selection(scored: DataFrame, group_cols=PARK, routes=None) -> DataFrame:
    """Cells that outline each route: the best per angular sector for loops, then the best by
    opportunity, band fit and distance to the cells chosen so far.

    Each step of the fill is one grouped maximum over all areas and routes at once; a
    candidate keeps only its distance to the nearest chosen cell, so no area is gathered
    in one task and no candidate is dropped.
    """
    keys = list(group_cols)
    gk = [*keys, "program"]
    rt = fixed_table(scored.sparkSession, [(a, float(b), c, int(d)) for a, b, c, d in routes or ROUTES], "program string, band double, loop boolean, want int")
    dx, dy = F.col("lng") - F.col("center_lng"), F.col("lat") - F.col("center_lat")
    c = scored.filter(~F.col("avoided")).join(rt, "program").select(*gk, "h3_id", "lng", "lat", "opportunity", "band", "loop", "want", F.sqrt(dx * dx + dy * dy).alias("_r"), F.atan2(dy, dx).alias("_ang"))
    st = c.groupBy(*gk).agg(F.greatest(F.max("_r"), F.lit(1e-9)).alias("_rmax"), F.min("opportunity").alias("_lo"), F.max("opportunity").alias("_hi"), F.count(F.lit(1)).alias("_cnt"))
    c = c.join(st, gk)
    opp = (F.col("opportunity") - F.col("_lo")) / F.greatest(F.lit(1.0), F.col("_hi") - F.col("_lo"))
    gap = F.abs(F.col("_r") / F.col("_rmax") - F.col("band"))
    two_pi = F.lit(6.283185307179586)
    c = c.withColumns({"_opp": opp, "_fit1": F.lit(1.0) - F.least(F.lit(1.0), gap / 0.3), "_fit2": F.lit(1.0) - F.least(F.lit(1.0), gap / 0.45),
                       "_sector": F.floor(F.pmod(F.col("_ang") + two_pi, two_pi) / two_pi * F.col("want"))})
    c = cut_lineage(c.select(*gk, "h3_id", "lng", "lat", "loop", "want", "_rmax", "_cnt", "_opp", "_fit1", "_fit2", "_sector"))
    everything = c.filter(F.col("_cnt") <= F.col("want")).select(*gk, "h3_id", F.lit(0).alias("step"))
    pool = c.filter(F.col("_cnt") > F.col("want"))

    def best(df, by, score):
        # highest score, ties by the smaller cell id
        return df.groupBy(*by).agg(F.min(F.struct((-score).alias("s"), "h3_id", "lng", "lat")).alias("_b"))

    first = best(pool.filter("loop"), [*gk, "_sector"], F.col("_opp") * 0.55 + F.col("_fit1") * 0.45)
    chosen = cut_lineage(first.select(*gk, F.col("_b.h3_id").alias("h3_id"), F.col("_b.lng").alias("_clng"), F.col("_b.lat").alias("_clat")))
    selected = chosen.select(*gk, "h3_id", F.lit(0).alias("step"))
    n_chosen = chosen.groupBy(*gk).agg(F.count(F.lit(1)).alias("_k"))
    # At most 16 chosen cells per route: a short array travels with each candidate once.
    arr = chosen.groupBy(*gk).agg(F.collect_list(F.struct("_clng", "_clat")).alias("_ch"))
    state = pool.join(selected.select(*gk, "h3_id"), [*gk, "h3_id"], "left_anti").join(arr, gk, "left").join(n_chosen, gk, "left")
    near = F.array_min(F.transform("_ch", lambda p: F.sqrt(F.pow(p["_clng"] - F.col("lng"), 2) + F.pow(p["_clat"] - F.col("lat"), 2))))
    state = cut_lineage(state.withColumns({"_near": near, "_k": F.coalesce("_k", F.lit(0))}).drop("_ch"))
    for step in range(1, max(w for _, _, _, w in routes or ROUTES) + 1):
        spread = F.when(F.col("_near").isNull(), F.lit(0.5)).otherwise(F.least(F.lit(1.0), F.col("_near") / (F.col("_rmax") * 0.55)))
        pick = best(state.filter(F.col("_k") < F.col("want")), gk, F.col("_opp") * 0.5 + F.col("_fit2") * 0.25 + spread * 0.25)
        pick = cut_lineage(pick.select(*gk, F.col("_b.h3_id").alias("_pid"), F.col("_b.lng").alias("_plng"), F.col("_b.lat").alias("_plat")))
        if pick.isEmpty():
            break
        selected = selected.unionByName(pick.select(*gk, F.col("_pid").alias("h3_id"), F.lit(step).alias("step")))
        d = F.sqrt(F.pow(F.col("_plng") - F.col("lng"), 2) + F.pow(F.col("_plat") - F.col("lat"), 2))
        state = cut_lineage(state.join(pick, gk).filter(F.col("h3_id") != F.col("_pid")).withColumns({"_near": F.least(F.coalesce("_near", d), d), "_k": F.col("_k") + 1}).drop("_pid", "_plng", "_plat"))
    return everything.unionByName(selected)
