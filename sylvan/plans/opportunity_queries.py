"""Registered program-opportunity queries with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import programs as pg
from ..functions.session import cut_lineage
from ..operators import cells as cl
from ..operators import filters as fl
from ..operators import opportunity as op
from ..operators import reviews as rv
from ..sources import adapters as ad
from .cell_sql import CELL_SQL
from .registry import query
from .site_queries import WIDTH, review_parks
from .review_queries import IMP
from .sqlbase import ENRICHED, SITE, js, norm, q, values_list

P = ["park_id"]


def site_scored(spark, sf):
    return cl.score_cells(cl.with_road_width(ad.site_cells(spark, sf), ad.roads(spark, sf)))


def programs(spark, sf):
    # a row per area and category: cut, or every use of the scores reads all reviews again
    impact = cut_lineage(rv.issue_impact(review_parks(spark, sf), P))
    rates = op.topic_rates(impact)
    return op.score_programs(site_scored(spark, sf), rates), rates, impact


def c100(x):
    return f"greatest(0e0, least(100e0, {js(x)}))"


_nl = ", ".join(f"{js(norm(f'population / coalesce(nullif(tp_, 0e0), 1e0) * coalesce(ts_{i}, 0e0) * 100e0 * tn_', 100))} AS nl_{i}" for i in range(len(op.TOPICS)))
_ts = ", ".join(f"max(mention_share) FILTER (WHERE issue_category = {q(t)}) AS ts_{i}, max(mentions) FILTER (WHERE issue_category = {q(t)}) AS tm_{i}" for i, t in enumerate(op.TOPICS))


def _prog(i, p):
    avoid = "CASE " + " ".join(f"WHEN {c} THEN {q(r)}" for c, r in p["avoid"]) + " END" if p["avoid"] else "CAST(NULL AS VARCHAR)"
    return f"SELECT park_id, h3_id, seq, lng, lat, population, {i} AS program_order, {q(p['type'])} AS program, {op.demand_sql(p)} AS d_, {p['suitability']} AS s_, {p['feasibility']} AS f_, {avoid} AS avoid_reason FROM sg"


OPP = f"""{SITE}, {WIDTH}, wc AS (SELECT c.*, coalesce(w.road_width_m, 5e0) AS road_width_m FROM site c LEFT JOIN width w USING (park_id)),
ss AS (SELECT *, {', '.join(f'{e} AS {k}' for k, e in CELL_SQL.items())} FROM wc), {ENRICHED}, {IMP},
tr AS (SELECT CAST(substr(place_id, 4) AS BIGINT) AS park_id, {_ts} FROM impact GROUP BY place_id),
tt AS (SELECT park_id, sum(population) AS tp_, count(*) AS tn_ FROM ss GROUP BY park_id),
sj AS (SELECT ss.*, tt.tp_, tt.tn_, tr.* EXCLUDE (park_id) FROM ss JOIN tt USING (park_id) LEFT JOIN tr USING (park_id)),
sg AS (SELECT park_id, h3_id, seq, lng, lat, population, {_nl}, {', '.join(f'{e} AS {k}' for k, e in pg.SIGNALS.items())} FROM sj),
pl AS ({' UNION ALL '.join(_prog(i, p) for i, p in enumerate(pg.PROGRAMS))}),
pr0 AS (SELECT * EXCLUDE (d_, s_, f_), {c100('d_')} AS demand, {c100('s_')} AS suitability, avoid_reason IS NOT NULL AS avoided, CASE WHEN avoid_reason IS NOT NULL THEN 0e0 ELSE {c100('f_')} END AS feasibility FROM pl),
pr AS (SELECT *, {c100('demand * 0.4e0 + suitability * 0.35e0 + feasibility * 0.25e0')} AS opportunity FROM pr0)"""


@query("program_cell_scores", f"WITH {OPP} SELECT park_id, h3_id, program, demand, suitability, feasibility, opportunity, avoid_reason FROM pr")
def _(spark, sf):
    return programs(spark, sf)[0].select("park_id", "h3_id", "program", "demand", "suitability", "feasibility", "opportunity", "avoid_reason")


_cat = values_list([(i, p["type"], p["name"], p["category"], p["geometry"], p["scale"], p["topic"], *(pg.area_of(p) or (None, None, None)), pg.readiness_of(p), "|".join(pg.users_of(p)), "|".join(p["sources"])) for i, p in enumerate(pg.PROGRAMS)])
_ment = "CASE topic " + " ".join(f"WHEN {q(t)} THEN coalesce(tm_{i}, 0)" for i, t in enumerate(op.TOPICS)) + " ELSE 0 END"


def _wavg(c):
    return f"CASE WHEN eligible = 0 THEN 0e0 WHEN ep <= 1 THEN {js(f'a_{c}')} ELSE {js(f'w_{c} / ep')} END AS {c}"


SUMM = f"""cat AS (SELECT program_order, program, name, category, geometry_type, scale, topic, CAST(min_area AS DOUBLE) AS min_area, CAST(target_area AS DOUBLE) AS target_area, CAST(max_area AS DOUBLE) AS max_area, CAST(readiness AS DOUBLE) AS readiness, users, sources FROM (VALUES {_cat}) v(program_order, program, name, category, geometry_type, scale, topic, min_area, target_area, max_area, readiness, users, sources)),
su0 AS (SELECT park_id, program, count(*) AS cells, count(*) FILTER (WHERE NOT avoided) AS eligible, coalesce(sum(population) FILTER (WHERE NOT avoided), 0e0) AS ep, {', '.join(f'coalesce(sum({c} * population) FILTER (WHERE NOT avoided), 0e0) AS w_{c}, avg({c}) FILTER (WHERE NOT avoided) AS a_{c}' for c in ('demand', 'suitability', 'feasibility'))}, coalesce(string_agg(DISTINCT avoid_reason, '|' ORDER BY avoid_reason), '') AS avoid_reasons FROM pr GROUP BY ALL),
su1 AS (SELECT *, {', '.join(_wavg(c) for c in ('demand', 'suitability', 'feasibility'))} FROM su0),
su AS (SELECT su1.park_id, su1.program, program_order, name, category, geometry_type, scale, topic, min_area, target_area, max_area, readiness, users, sources, cells, eligible, demand, suitability, feasibility, avoid_reasons, {c100('demand * 0.4e0 + suitability * 0.35e0 + feasibility * 0.25e0')} AS opportunity, CAST({_ment} AS BIGINT) AS mentions FROM su1 JOIN cat USING (program) LEFT JOIN tr USING (park_id)),
summ AS (SELECT *, {c100('70e0 + least(20, mentions * 2) + CASE WHEN eligible > cells * 0.3e0 THEN 10e0 ELSE 0e0 END')} AS confidence, CASE WHEN opportunity >= 75 THEN 'Critical' WHEN opportunity >= 55 THEN 'High' WHEN opportunity >= 30 THEN 'Medium' ELSE 'Low' END AS priority FROM su)"""


def summary(spark, sf):
    s, r, i = programs(spark, sf)
    return op.program_summary(s, r), i


def _flat(df):
    return df.withColumns({c: F.array_join(c, "|") for c in ("users", "sources", "avoid_reasons")}).drop("preferred", "avoid_adjacent", "service", "movement")


@query("program_summary", f"WITH {OPP}, {SUMM} SELECT * FROM summ")
def _(spark, sf):
    return _flat(summary(spark, sf)[0])


@query("all_opportunities", f"WITH {OPP}, {SUMM} SELECT park_id, program, opportunity, priority, row_number() OVER (PARTITION BY park_id ORDER BY opportunity DESC, program_order) AS rank FROM summ")
def _(spark, sf):
    return op.all_opportunities(summary(spark, sf)[0]).select("park_id", "program", "opportunity", "priority", "rank")


_lists = values_list([(p["type"], *["|".join(p[k]) for k in ("preferred", "avoided", "service", "movement")]) for p in pg.PROGRAMS])


@query("summary_opportunities", f"WITH {OPP}, {SUMM}, al AS (SELECT * FROM (VALUES {_lists}) v(program, preferred, avoid_adjacent, service, movement)) SELECT park_id, row_number() OVER (PARTITION BY park_id ORDER BY opportunity DESC, program_order) AS rank, program, name, category, geometry_type, scale, "
       "opportunity, demand, suitability, feasibility, confidence, readiness, priority, users, min_area, target_area, max_area, preferred, avoid_adjacent, service, movement FROM summ JOIN al USING (program)")
def _(spark, sf):
    lists = ("users", "preferred", "avoid_adjacent", "service", "movement")
    return op.summary_opportunities(summary(spark, sf)[0]).withColumns({c: F.array_join(c, "|") for c in lists})


@query("opportunity_filter", f"WITH {OPP}, {SUMM} SELECT park_id, program, confidence FROM summ WHERE (contains(sources, 'review-driven') OR contains(sources, 'environment-driven')) AND priority IN ('High', 'Critical', 'Medium') AND geometry_type = 'area' AND contains(sources, 'brief-required') AND confidence >= 70")
def _(spark, sf):
    s = summary(spark, sf)[0]
    return fl.opportunity_filter(s, sources=["review-driven", "environment-driven"], priorities=["High", "Critical", "Medium"], geometry_types=["area"], brief="required", high_confidence=True).select("park_id", "program", "confidence")


@query("opportunity_sort", f"WITH {OPP}, {SUMM}, k AS (SELECT program, program_order, category, sum(opportunity) AS opportunity, min(target_area) AS target_area FROM summ GROUP BY ALL) SELECT program, opportunity, target_area FROM k ORDER BY coalesce(target_area, -1) DESC, program_order")
def _(spark, sf):
    k = summary(spark, sf)[0].groupBy("program", "program_order", "category").agg(F.sum("opportunity").alias("opportunity"), F.min("target_area").alias("target_area"))
    return fl.opportunity_sort(k, "recommendedArea").select("program", "opportunity", "target_area")


@query("top_program_cells", f"WITH {OPP}, r AS (SELECT park_id, program, h3_id, opportunity, row_number() OVER (PARTITION BY park_id, program ORDER BY opportunity DESC, seq) AS rank FROM pr) SELECT * FROM r WHERE rank <= 15")
def _(spark, sf):
    return op.top_program_cells(programs(spark, sf)[0]).select("park_id", "program", "h3_id", "opportunity", "rank")


@query("spatial_conflicts", f"""WITH {OPP}, tot AS (SELECT park_id, count(*) AS n FROM pr WHERE program = 'quietGarden' GROUP BY park_id),
co AS (SELECT * FROM (SELECT pr.park_id, program, h3_id, n, row_number() OVER (PARTITION BY pr.park_id, program ORDER BY suitability DESC, seq) AS r FROM pr JOIN tot USING (park_id) WHERE program IN ('quietGarden', 'sensoryGarden', 'sportsCourt') AND NOT avoided) WHERE r <= greatest(1e0, {js('n * 0.1e0')})),
cp AS (SELECT * FROM (VALUES {values_list([(a, r) for a, rs in pg.CONFLICTS for r in rs])}) v(attractor, repelled)), ht AS (SELECT DISTINCT park_id, h3_id, repelled AS program FROM co JOIN cp ON program = attractor),
x AS (SELECT pr.*, ht.program IS NOT NULL AND NOT avoided AS in_core FROM pr LEFT JOIN ht ON ht.park_id = pr.park_id AND ht.h3_id = pr.h3_id AND ht.program = pr.program),
y AS (SELECT park_id, h3_id, program, in_core, demand, feasibility, opportunity AS o0, CASE WHEN in_core THEN {c100('suitability - 25e0')} ELSE suitability END AS suitability FROM x)
SELECT park_id, h3_id, program, in_core, suitability, CASE WHEN in_core THEN {c100('demand * 0.4e0 + suitability * 0.35e0 + feasibility * 0.25e0')} ELSE o0 END AS opportunity FROM y""")
def _(spark, sf):
    return op.spatial_conflicts(programs(spark, sf)[0]).select("park_id", "h3_id", "program", "in_core", "suitability", "opportunity")


_none = "CAST(NULL AS DOUBLE)"


@query("opportunity_evidence", f"""WITH {OPP}, {SUMM}, notes(program, note) AS (VALUES {values_list(list(pg.TOPIC_NOTES.items()))}),
e AS (SELECT s.*, {js('negative_share * 100e0')} AS neg, notes.note FROM summ s LEFT JOIN impact i ON CAST(substr(i.place_id, 4) AS BIGINT) = s.park_id AND i.issue_category = s.topic LEFT JOIN notes ON notes.program = s.program),
c AS (SELECT park_id, program, unnest(string_split(avoid_reasons, '|')) AS note, generate_subscripts(string_split(avoid_reasons, '|'), 1) AS k FROM e WHERE avoid_reasons <> '')
SELECT park_id, program, 1 AS position, 'demand' AS code, demand AS score, cells AS n, CAST(NULL AS BIGINT) AS total, CAST(NULL AS VARCHAR) AS topic, CAST(NULL AS VARCHAR) AS note FROM e
UNION ALL SELECT park_id, program, 2, CASE WHEN topic IS NULL THEN 'no_topic' WHEN mentions > 0 THEN 'reviews' ELSE 'no_mentions' END, CASE WHEN mentions > 0 THEN coalesce(neg, 0e0) END, CASE WHEN mentions > 0 THEN mentions END, NULL, topic, NULL FROM e
UNION ALL SELECT park_id, program, 3, 'note', {_none}, NULL, NULL, topic, note FROM e WHERE note IS NOT NULL
UNION ALL SELECT park_id, program, 4, 'suitability', suitability, NULL, NULL, NULL, NULL FROM e
UNION ALL SELECT park_id, program, 5, 'feasibility', feasibility, eligible, cells, NULL, NULL FROM e
UNION ALL SELECT park_id, program, 5 + k, 'constraint', {_none}, NULL, NULL, NULL, note FROM c""")
def _(spark, sf):
    s, i = summary(spark, sf)
    return op.opportunity_evidence(s, i)


@query("movement_cells")
def _(spark, sf):
    return op.movement_cell_selection(programs(spark, sf)[0])
