"""Registered ontology, rule, package and journey queries with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formulas as fm
from ..functions import ontology as on
from ..functions import programs as pg
from ..functions.numeric import js_round
from ..functions.session import written_table
from ..functions.text import str_array
from ..operators import exports as xp
from ..operators import graph as gr
from ..operators import packages as pk
from ..operators import reviews as rv
from ..operators.spatial import rounded
from ..sources import adapters as ad
from .opportunity_queries import OPP, SUMM, summary
from .registry import query
from .review_queries import IMP
from .site_queries import SCORED, review_parks, review_parks_table, scored
from .spatial_queries import UTM
from .sqlbase import ENRICHED, js, norm, q, values_list

N = 40  # programs per package
NAMES = ["Inclusive playground", "Toddler Play", "caregiver seating", "playground", "sportsCourt", "Quiet  Garden", "restrooms", "unknown plaza", "Cafe / Kiosk", "Service Yard", "drinking fountain", "Main Entrance"]
KINDS = ["preferred_adjacency", "acoustic buffer", "service link", "movement", "visibility", "overlap", "near"]
TYPES = [p["type"] for p in pg.PROGRAMS]


def _lit(field):
    return F.get(F.expr(str_array([p[field] for p in pg.PROGRAMS])), F.col("program_order"))


def _lists(field):
    arr = "array(" + ", ".join(str_array(p[field]) if p[field] else "CAST(array() AS array<string>)" for p in pg.PROGRAMS) + ")"
    return F.get(F.expr(arr), F.col("program_order"))


def programs(spark, sf):
    """Package programs, one per part; catalogue columns by program type, areas from the part."""
    p = F.col("p_partkey")
    d = ad.table(spark, sf, "part").select(p.alias("_p"), "p_size").select(ad.idiv(F.col("_p"), N).alias("package_id"), F.concat(F.lit("p"), F.col("_p").cast("string")).alias("program_id"), ((F.col("_p") * 7) % 44).cast("int").alias("program_order"), F.col("_p").alias("k"), "p_size")
    users = "array(" + ", ".join(str_array(pg.users_of(x)) for x in pg.PROGRAMS) + ")"
    d = d.withColumns({"program_type": _lit("type"), "name": _lit("name"), "category": _lit("category"), "geometry_type": _lit("geometry"), "scale": _lit("scale"), "users": F.get(F.expr(users), F.col("program_order")),
                       "preferred": _lists("preferred"), "movement": _lists("movement"), "service": _lists("service"), "avoid_adjacent": _lists("avoided")})
    k = F.col("k")
    return d.withColumns({"priority": (k % 11) / F.lit(10.0), "min_area": F.when(k % 6 != 0, (k % 50 * 10).cast("double")), "target_area": F.when(k % 5 != 0, (F.col("p_size") * 20).cast("double")), "max_area": F.when(k % 7 != 0, (k % 90 * 15).cast("double"))})


_cat = values_list([(i, p["type"], p["name"], p["category"], p["geometry"], p["scale"], "|".join(pg.users_of(p)), "|".join(p["preferred"]), "|".join(p["movement"]), "|".join(p["service"]), "|".join(p["avoided"])) for i, p in enumerate(pg.PROGRAMS)])


def _split(c):
    return f"CASE WHEN {c} = '' THEN [] ELSE string_split({c}, '|') END AS {c}"


PROG = f"""pcat AS (SELECT program_order, program_type, name, category, geometry_type, scale, string_split(users, '|') AS users, {', '.join(_split(c) for c in ('preferred', 'movement', 'service', 'avoid_adjacent'))} FROM (VALUES {_cat}) v(program_order, program_type, name, category, geometry_type, scale, users, preferred, movement, service, avoid_adjacent)),
prg AS (SELECT p_partkey // {N} AS package_id, 'p' || p_partkey AS program_id, c.*, p_partkey AS k, (p_partkey % 11) / 10e0 AS priority, CASE WHEN p_partkey % 6 <> 0 THEN CAST(p_partkey % 50 * 10 AS DOUBLE) END AS min_area, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size * 20 AS DOUBLE) END AS target_area, CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_partkey % 90 * 15 AS DOUBLE) END AS max_area
 FROM part JOIN pcat c ON c.program_order = (p_partkey*7) % 44)"""


def relationships(spark, sf):
    """Package relationships, one per order line; some point outside the package."""
    li = ad.table(spark, sf, "lineitem")
    pkg = ad.idiv(F.col("l_partkey"), N)
    return li.select(pkg.alias("package_id"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("relationship_id"),
                     F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("source"), F.concat(F.lit("p"), (pkg * N + F.col("l_suppkey") % (N + 2)).cast("string")).alias("target"),
                     F.get(F.expr(str_array(KINDS)), F.col("l_linenumber") - 1).alias("type"), F.when((F.col("l_quantity") % 5 == 0) & (F.col("l_returnflag") == "A"), "accepted_rule").otherwise("catalogue").alias("authority"),
                     (F.col("l_quantity") % 7 == 0).alias("accepted"), (F.col("l_quantity") % 4 == 0).alias("mandatory"), (F.col("l_linestatus") == "F").alias("directed"), (F.col("l_discount") * 10.0).alias("confidence"),
                     (F.col("l_tax") * 13.0).alias("weight"), (F.col("l_quantity")).alias("minimum_distance"), F.when(F.col("l_orderkey") % 3 == 0, F.lit(40.0)).alias("maximum_distance"))


REL = f"""rel AS (SELECT l_partkey // {N} AS package_id, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS relationship_id, 'p' || l_partkey AS source, 'p' || ((l_partkey // {N}) * {N} + l_suppkey % {N + 2}) AS target, ([{', '.join(q(k) for k in KINDS)}])[l_linenumber] AS type,
 CASE WHEN l_quantity % 5 = 0 AND l_returnflag = 'A' THEN 'accepted_rule' ELSE 'catalogue' END AS authority, l_quantity % 7 = 0 AS accepted, l_quantity % 4 = 0 AS mandatory, l_linestatus = 'F' AS directed, l_discount * 10e0 AS confidence, l_tax * 13e0 AS weight, l_quantity AS minimum_distance, CASE WHEN l_orderkey % 3 = 0 THEN 40e0 END AS maximum_distance FROM lineitem)"""

_al = values_list([(g, a) for g, al, _, _ in on.USER_GROUPS for a in al])
GROUPS = f"""al AS (SELECT * FROM (VALUES {_al}) v(g, a)), uu AS (SELECT DISTINCT package_id, program_id, lower(trim(u)) AS u FROM (SELECT package_id, program_id, unnest(users) AS u FROM prg)),
ex AS (SELECT package_id, program_id, u, g FROM uu JOIN al ON a = u), lo AS (SELECT DISTINCT package_id, program_id, u, g FROM uu JOIN al ON length(a) >= 6 AND contains(u, a) WHERE NOT EXISTS (SELECT 1 FROM al x WHERE x.a = uu.u)),
rs_ AS (SELECT package_id, program_id, u, g FROM ex UNION SELECT * FROM lo), ug AS (SELECT DISTINCT package_id, program_id, g FROM (SELECT package_id, program_id, g FROM rs_ UNION ALL SELECT package_id, program_id, 'all_visitors' FROM uu WHERE NOT EXISTS (SELECT 1 FROM rs_ r WHERE r.package_id = uu.package_id AND r.program_id = uu.program_id AND r.u = uu.u)))"""


@query("user_groups", f"WITH {PROG}, {GROUPS} SELECT package_id, program_id, string_agg(g, '|' ORDER BY g) AS user_groups FROM ug GROUP BY ALL")
def _(spark, sf):
    return pk.normalise_user_groups(programs(spark, sf)).select("package_id", "program_id", F.array_join(F.sort_array("user_groups"), "|").alias("user_groups"))


ATTR = "attr0 AS (SELECT *, lower(name) AS nm FROM prg), attr AS (SELECT *, " + ", ".join(f"{e} AS {k}" for k, e in on.FORMULAS.items()) + " FROM attr0)"


@query("program_attributes", f"WITH {PROG}, {ATTR} SELECT package_id, program_id, {', '.join(on.FORMULAS)} FROM attr")
def _(spark, sf):
    return pk.program_attributes(programs(spark, sf)).select("package_id", "program_id", *on.FORMULAS)


def full(spark, sf):
    return pk.program_attributes(pk.normalise_user_groups(programs(spark, sf)))


_ugv = values_list([(g, *map(float, need), float(su)) for g, _, need, su in on.USER_GROUPS])


def c3(x, lo="0e0"):
    return f"greatest({lo}, least(1e0, {js(x, 3)}))"


@query("user_program_suitability", f"""WITH {PROG}, {ATTR}, {GROUPS}, gv AS (SELECT g, CAST(s AS DOUBLE) AS s, CAST(a AS DOUBLE) AS a, CAST(f AS DOUBLE) AS f, CAST(o AS DOUBLE) AS o, CAST(c AS DOUBLE) AS c, CAST(q AS DOUBLE) AS q, CAST(su AS DOUBLE) AS su FROM (VALUES {_ugv}) v(g, s, a, f, o, c, q, su)),
x AS (SELECT t.package_id, t.program_id, gv.g AS user_group, CASE WHEN EXISTS (SELECT 1 FROM ug u WHERE u.package_id = t.package_id AND u.program_id = t.program_id AND u.g = gv.g) THEN 1e0 WHEN EXISTS (SELECT 1 FROM ug u WHERE u.package_id = t.package_id AND u.program_id = t.program_id AND u.g = 'all_visitors') THEN 0.72e0 ELSE 0.25e0 END AS direct,
 (s * shade_demand + a * accessibility_demand + f * safety_sensitivity + o * social_intensity + c * activity_intensity + q * quiet_demand) / greatest(0.001e0, s + a + f + o + c + q) AS nf, 1e0 - abs(su - summer_fit) AS sf FROM attr t CROSS JOIN gv)
SELECT package_id, program_id, user_group, direct, {c3('nf')} AS need_fit, {c3('sf')} AS summer_match, {c3('0.55e0 * direct + 0.3e0 * nf + 0.15e0 * sf')} AS weight FROM x""")
def _(spark, sf):
    return pk.user_program_suitability(full(spark, sf))


@query("pairwise_relationships", f"""WITH {PROG}, {ATTR}, {GROUPS}, ul AS (SELECT package_id, program_id, list(g) AS gs FROM ug GROUP BY ALL), t AS (SELECT attr.*, gs FROM attr JOIN ul USING (package_id, program_id)),
p AS (SELECT a.package_id, a.program_id AS source, b.program_id AS target, {', '.join(f"CASE WHEN list_contains(a.{c}, b.program_type) OR list_contains(b.{c}, a.program_type) THEN {v}e0 ELSE 0e0 END AS {c}" for c, v in (('preferred', 1.0), ('movement', 0.8), ('service', 0.65), ('avoid_adjacent', 1.0)))},
 len(list_intersect(a.gs, b.gs)) / CAST(greatest(1, len(list_distinct(list_concat(a.gs, b.gs)))) AS DOUBLE) AS sh, abs(a.activity_intensity - b.activity_intensity) * least(a.quiet_demand, b.quiet_demand) AS cf FROM t a JOIN t b ON a.package_id = b.package_id AND a.program_order < b.program_order),
s AS (SELECT *, {c3('0.5e0 * preferred + 0.25e0 * movement + 0.15e0 * service + 0.25e0 * sh - 0.8e0 * avoid_adjacent - 0.35e0 * cf', '-1e0')} AS score FROM p)
SELECT package_id, source, target, score, CASE WHEN score > 0.15e0 THEN 'attract' WHEN score < -0.15e0 THEN 'repel' ELSE 'neutral' END AS type, {c3('sh')} AS shared_users, {c3('cf')} AS activity_conflict FROM s""")
def _(spark, sf):
    return pk.pairwise_relationships(full(spark, sf))


@query("overlap_edges", f"WITH {PROG}, ov AS (SELECT * FROM (VALUES {values_list([(a, b, float(s), m) for a, b, s, m in on.OVERLAPS])}) v(source, target, compatibility, mode)), k AS (SELECT DISTINCT package_id, program_type FROM prg) SELECT a.package_id, source, target, CAST(compatibility AS DOUBLE) AS compatibility, mode FROM k a JOIN ov ON ov.source = a.program_type JOIN k b ON b.package_id = a.package_id AND b.program_type = ov.target")
def _(spark, sf):
    return pk.overlap_edges(programs(spark, sf))


RULE = f"""rule AS (SELECT o_orderkey AS rule_id, CASE WHEN o_orderkey % 9 = 0 THEN 'draft' ELSE 'active' END AS status, ([{', '.join(q(n) for n in NAMES)}])[CAST(o_orderkey % 12 AS INTEGER) + 1] AS source_entity, ([{', '.join(q(n) for n in NAMES)}])[CAST((o_orderkey // 12) % 12 AS INTEGER) + 1] AS target_entity,
 (['must avoid', 'depends on', 'close to', 'connected by route', 'overlooks'])[CAST(o_orderkey % 5 AS INTEGER) + 1] AS relationship, (['functional', 'setback', 'supervision'])[CAST(o_orderkey % 3 AS INTEGER) + 1] AS rule_category, CASE WHEN o_orderkey % 2 = 0 THEN 'mandatory' ELSE 'advisory' END AS requirement_level,
 CASE WHEN o_orderkey % 4 = 0 THEN 'minimum distance' END AS numeric_parameter, CASE WHEN o_orderkey % 8 = 0 THEN 5e0 END AS numeric_value, 'm' AS numeric_unit, o_orderkey % 16 = 0 AS numeric_approved FROM orders)"""


def rules(spark, sf):
    o = F.col("o_orderkey")
    arr = lambda v, i: F.get(F.expr(str_array(v)), i.cast("int"))
    return ad.table(spark, sf, "orders").select(
        o.alias("rule_id"), F.when(o % 9 == 0, "draft").otherwise("active").alias("status"), arr(NAMES, o % 12).alias("source_entity"), arr(NAMES, ad.idiv(o, 12) % 12).alias("target_entity"),
        arr(["must avoid", "depends on", "close to", "connected by route", "overlooks"], o % 5).alias("relationship"), arr(["functional", "setback", "supervision"], o % 3).alias("rule_category"),
        F.when(o % 2 == 0, "mandatory").otherwise("advisory").alias("requirement_level"), F.when(o % 4 == 0, "minimum distance").alias("numeric_parameter"), F.when(o % 8 == 0, F.lit(5.0)).alias("numeric_value"), F.lit("m").alias("numeric_unit"), (o % 16 == 0).alias("numeric_approved"))


def ne(c):
    return f"trim(regexp_replace(replace(lower(regexp_replace({c}, '([a-z])([A-Z])', '\\1 \\2', 'g')), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


_ent = values_list([(p["type"], p["type"], 1, "exact_type") for p in pg.PROGRAMS] + [(p["name"], p["type"], 2, "exact_name") for p in pg.PROGRAMS] + [(a, p, 3, "approved_alias") for a, ps in on.ALIASES.items() for p in ps])


@query("compiled_rules", f"""WITH {RULE}, et AS (SELECT {ne('e')} AS e, p, r, m FROM (VALUES {_ent}) v(e, p, r, m)), em AS (SELECT e, list_sort(list(DISTINCT p)) AS c, min(m) AS m FROM et t WHERE r = (SELECT min(r) FROM et x WHERE x.e = t.e) GROUP BY e),
j AS (SELECT rule.*, a.c AS sc_, a.m AS source_method, b.c AS tc, b.m AS target_method, {ne("concat_ws(' ', rule_category, relationship, numeric_parameter)")} AS tx FROM rule LEFT JOIN em a ON a.e = {ne('source_entity')} LEFT JOIN em b ON b.e = {ne('target_entity')} WHERE status = 'active'),
k AS (SELECT *, CASE WHEN rule_id % 50 = 1 THEN 'active_conflict' WHEN numeric_parameter IS NOT NULL AND (numeric_value IS NULL OR numeric_unit IS NULL OR NOT numeric_approved) THEN 'invalid_numeric_provenance' WHEN sc_ IS NULL THEN 'source_unmapped' WHEN len(sc_) > 1 THEN 'source_ambiguous'
 WHEN tc IS NULL THEN 'target_unmapped' WHEN len(tc) > 1 THEN 'target_ambiguous' WHEN sc_[1] = tc[1] THEN 'self_relationship' END AS reason,
 CASE WHEN regexp_matches(tx, 'visibility|sightline|supervision|overlook') THEN 'visibility' WHEN regexp_matches(tx, 'distance|setback|separation|buffer|proximity') THEN 'distance' WHEN regexp_matches(tx, 'avoid|prohibit|constraint|exclusion') THEN 'constraints' WHEN regexp_matches(tx, 'movement|circulation|route|sequence|access|connectivity') THEN 'movement' ELSE 'functional' END AS layer FROM j)
SELECT rule_id, reason, CASE WHEN reason IS NULL THEN sc_[1] END AS source, CASE WHEN reason IS NULL THEN tc[1] END AS target, CASE WHEN reason IS NULL THEN layer END AS graph_layer, CASE WHEN reason IS NULL THEN layer IN ('visibility', 'movement') OR regexp_matches({ne('relationship')}, 'depends|serves|provides|leads|feeds|requires') END AS directed,
 requirement_level = 'mandatory' AS mandatory, source_method, target_method FROM k""")
def _(spark, sf):
    r = rules(spark, sf)
    return pk.compile_rules(r, r.filter(F.col("rule_id") % 50 == 1).select("rule_id"))


RT = "CASE WHEN contains(lower(type), 'overlap') THEN 'overlap_compatible' WHEN contains(lower(type), 'avoid') OR contains(lower(type), 'separat') OR contains(lower(type), 'buffer') THEN 'avoid' WHEN contains(lower(type), 'prefer') OR contains(lower(type), 'adjacent') OR contains(lower(type), 'near') THEN 'preferred' WHEN contains(lower(type), 'service') THEN 'service' WHEN contains(lower(type), 'movement') OR contains(lower(type), 'connect') THEN 'movement' WHEN contains(lower(type), 'visibility') OR contains(lower(type), 'sight') THEN 'visibility' ELSE lower(type) END"
RGRAPH = f"""{PROG}, {REL}, rv0 AS (SELECT rel.*, {RT} AS rt, a.priority AS pa, b.priority AS pb FROM rel LEFT JOIN prg a ON a.package_id = rel.package_id AND a.program_id = rel.source LEFT JOIN prg b ON b.package_id = rel.package_id AND b.program_id = rel.target),
rv1 AS (SELECT *, rt IN ('preferred', 'avoid', 'overlap_compatible') AS sym, rt IN ('preferred', 'avoid', 'overlap_compatible') AND source > target AS sw, CASE WHEN authority = 'accepted_rule' THEN 'accepted_rule' WHEN accepted THEN 'designer_approved' ELSE 'advisory' END AS au FROM rv0 WHERE pa IS NOT NULL AND pb IS NOT NULL),
rv2 AS (SELECT package_id, au AS authority, CASE WHEN sw THEN target ELSE source END AS source, CASE WHEN sw THEN source ELSE target END AS target, rt AS type, NOT sym AND directed AS directed, mandatory, confidence, relationship_id, CASE WHEN sw THEN pb ELSE pa END AS ps, CASE WHEN sw THEN pa ELSE pb END AS pt FROM rv1),
re0 AS (SELECT package_id, authority, source, target, type, directed, min(relationship_id) AS edge_id, bool_or(mandatory) AS m, avg(confidence) AS c, any_value(ps) AS ps, any_value(pt) AS pt, count(*) AS merged FROM rv2 GROUP BY package_id, authority, source, target, type, directed),
redge AS (SELECT package_id, authority, source, target, type, directed, edge_id, merged, CASE WHEN authority <> 'advisory' THEN 1e0 ELSE CASE type {' '.join(f"WHEN {q(k)} THEN {float(v)}e0" for k, v in on.BASE_STRENGTH.items())} ELSE 0.5e0 END * ps * (0.5e0 + 0.5e0 * pt) * (0.5e0 + 0.5e0 * least(1e0, greatest(0e0, c))) END AS weight, authority <> 'advisory' AND m AS mandatory FROM re0),
opp_ AS (SELECT package_id, source, target, CASE type WHEN 'avoid' THEN 'preferred' ELSE 'avoid' END AS type, type AS accepted_type FROM redge WHERE authority = 'accepted_rule' AND type IN ('avoid', 'preferred'))"""


def graph(spark, sf):
    return pk.compile_relationship_graph(relationships(spark, sf), programs(spark, sf))


@query("relationship_edges", f"WITH {RGRAPH} SELECT * REPLACE ({js('weight', 9)} AS weight) FROM redge e WHERE NOT (authority = 'advisory' AND EXISTS (SELECT 1 FROM opp_ o WHERE o.package_id = e.package_id AND o.source = e.source AND o.target = e.target AND o.type = e.type))")
def _(spark, sf):
    return rounded(graph(spark, sf)["edges"], ["weight"], 9)


@query("relationship_conflicts", f"WITH {RGRAPH} SELECT e.package_id, e.source, e.target, e.type AS advisory_type, accepted_type FROM redge e JOIN opp_ o ON o.package_id = e.package_id AND o.source = e.source AND o.target = e.target AND o.type = e.type WHERE authority = 'advisory'")
def _(spark, sf):
    return graph(spark, sf)["conflicts"]


@query("relationship_unknown_references", f"WITH {RGRAPH} SELECT package_id, relationship_id, CASE WHEN pa IS NULL THEN source ELSE target END AS unknown_program FROM rv0 WHERE pa IS NULL OR pb IS NULL")
def _(spark, sf):
    return graph(spark, sf)["unknown"]


def package_parts(spark, sf):
    p = full(spark, sf)
    k = F.col("k")
    p = p.withColumns({"required": k % 2 == 0, "spatial_mode": pk.spatial_mode(), "coverage_pct": F.when(k % 3 == 0, (k % 130).cast("double")), "suitability_field": F.when(k % 4 != 0, F.lit("f")), "n_constraints": (k % 3).cast("int"),
                       "aspect_min": (k % 4).cast("double"), "aspect_max": (k % 3).cast("double"), "compactness": (k % 13) / F.lit(10.0), "minimum_width": (k % 9 - 1).cast("double"), "has_geometry": k % 10 != 0})
    head = p.groupBy("package_id").agg(F.count(F.lit(1)).alias("n")).select("package_id", F.when(F.col("package_id") % 5 != 0, "1.0").alias("schema_version"), F.concat(F.lit("id"), F.col("package_id").cast("string")).alias("project_id"), F.lit("Project").alias("project_name"), F.lit("EPSG:32640").alias("crs"),
                                                                         F.when(F.col("package_id") % 7 != 0, "m").alias("units"), (F.col("package_id") % 6 * 4000).cast("double").alias("site_area"))
    li = ad.table(spark, sf, "lineitem")
    pkg = ad.idiv(F.col("l_partkey"), N)
    j = li.select(pkg.alias("package_id"), F.col("l_orderkey").alias("journey_id"), (F.col("l_quantity") / 45.0).alias("weight"), F.concat(F.lit("p"), (pkg * N + F.col("l_suppkey") % (N + 1)).cast("string")).alias("space"))
    d = li.select(pkg.alias("package_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("origin"), F.concat(F.lit("p"), (pkg * N + F.col("l_suppkey") % (N + 1)).cast("string")).alias("destination"), (F.col("l_quantity") - 2.0).alias("weight"))
    return head, p, relationships(spark, sf), j, d


@query("package_issues")
def _(spark, sf):
    return pk.validate_packages(*package_parts(spark, sf)).groupBy("package_id", "severity", "code").agg(F.count(F.lit(1)).alias("n"))


def site_settings(spark, sf):
    s = ad.table(spark, sf, "part").select(ad.idiv(F.col("p_partkey"), N).alias("package_id")).distinct()
    k = F.col("package_id")
    return s.withColumns({"brief_area": F.lit(15000.0), "measured_area": F.when(k % 9 != 0, F.lit(14736.99) - k), "leasable_pct": F.lit(15.0), "operations_area": F.when(k % 4 != 0, F.lit(300.0)), "dropoff_area": F.lit(200.0),
                          "circulation_area": F.when(k % 3 != 0, F.lit(2500.0)), "tree_pct": F.lit(40.0), "native_pct": F.when(k % 2 == 0, F.lit(25.0))})


RECON = f"""st_ AS (SELECT package_id, 15000e0 AS ba, CASE WHEN package_id % 9 <> 0 THEN 14736.99e0 - package_id END AS ma, CASE WHEN package_id % 4 <> 0 THEN 300e0 END AS oa, 200e0 AS da, CASE WHEN package_id % 3 <> 0 THEN 2500e0 END AS ca, 40e0 AS tp, CASE WHEN package_id % 2 = 0 THEN 25e0 END AS np FROM (SELECT DISTINCT package_id FROM prg)),
rc0 AS (SELECT p.package_id, program_type, CASE program_type WHEN 'operationsArea' THEN oa WHEN 'dropOffZone' THEN da ELSE target_area END AS t, CASE WHEN program_type IN ({', '.join(q(t) for t in on.OVERLAY_TYPES)}) THEN 'overlay' WHEN program_type IN ({', '.join(q(t) for t in on.SHARED_TYPES)}) THEN 'shared' ELSE 'exclusive' END AS m FROM prg p JOIN st_ USING (package_id) WHERE geometry_type = 'area'),
rc1 AS (SELECT package_id, coalesce(sum(t) FILTER (WHERE m = 'exclusive' AND program_type NOT IN ('operationsArea', 'dropOffZone')), 0e0) AS ex_, coalesce(sum(t) FILTER (WHERE m = 'shared'), 0e0) AS sh_, coalesce(sum(t) FILTER (WHERE m = 'overlay'), 0e0) AS ov_, count(*) FILTER (WHERE m = 'exclusive' AND t IS NULL) AS ux FROM rc0 GROUP BY package_id),
rc2 AS (SELECT *, ex_ + coalesce(oa, 0) + coalesce(da, 0) + coalesce(ca, 0) AS com, {js('ma - (ex_ + coalesce(oa, 0) + coalesce(da, 0) + coalesce(ca, 0))', 2)} AS rem FROM st_ JOIN rc1 USING (package_id))"""


@query("area_reconciliation", f"WITH {PROG}, {RECON} SELECT package_id, CASE WHEN rem < 0 THEN 'overallocated' WHEN ux > 0 OR ca IS NULL THEN 'incomplete' ELSE 'complete' END AS status, ba AS brief_area, {js('ma', 2)} AS measured_area, {js('ma - ba', 2)} AS variance, {js('ex_', 2)} AS exclusive_area, {js('com', 2)} AS committed_area, rem AS remaining_area, {js('sh_', 2)} AS shared_area, {js('ov_', 2)} AS overlay_area, {js('ba * 15e0 / 100e0', 2)} AS leasable_cap, ux AS unresolved_exclusive, {js('ma * tp / 100e0', 2)} AS tree_area, {js('ma * np / 100e0', 2)} AS native_area FROM rc2")
def _(spark, sf):
    return pk.area_reconciliation(programs(spark, sf), site_settings(spark, sf))


_in = lambda *ws: "(" + " OR ".join(f"contains(n, '{w}')" for w in ws) + ")"
_cost = lambda length, width: js(f"{js(f'{length} * {width}', 2)} * 650e0", 2)
#: The settings of the query below written out: widths, lengths, unit costs, 10 % contingency, a cap of nine million.
ESTIMATE = f"""sp_ AS (SELECT package_id, target_area, program_class = 'SPACE' AND geometry_type = 'area' AND program_type NOT IN ({', '.join(q(t) for t in [*on.OVERLAY_TYPES, *on.SHARED_TYPES])}) AS ex, lower(program_type || ' ' || name) AS n FROM attr),
se_ AS (SELECT package_id, count(*) FILTER (ex) AS exn, count(*) FILTER (ex AND target_area >= 0) AS kn, sum(CASE WHEN ex AND target_area >= 0 THEN target_area * CASE WHEN {_in('play', 'sensory')} THEN 950e0 WHEN {_in('plaza', 'court', 'fitness', 'event')} THEN 650e0 WHEN {_in('garden', 'planting', 'nature', 'habitat', 'bioswale')} THEN 280e0 ELSE 180e0 END ELSE 0e0 END) AS spaces FROM sp_ GROUP BY package_id),
rl_ AS (SELECT package_id, count(*) AS r, count(*) FILTER (weight >= 0) AS rw FROM rel GROUP BY package_id),
tr_ AS (SELECT package_id, {js('ma * tp / 100e0', 2)} AS tree_area, {js('ma * np / 100e0', 2)} AS native_area FROM rc2),
e0 AS (SELECT st_.package_id, coalesce(exn, 0) AS exn, coalesce(kn, 0) AS kn, coalesce(spaces, 0e0) AS spaces, coalesce(r, 0) AS r, coalesce(rw, 0) AS rw, tree_area, native_area, {_cost('CASE WHEN package_id % 3 <> 0 THEN 900e0 END', '3e0')} AS p1, {_cost('1000e0', '2e0')} AS p2, {_cost('(480e0 + package_id % 50)', '3.5e0')} AS p3, {_cost('120e0', '4e0')} AS p4,
  CASE WHEN package_id % 4 <> 0 THEN 1500e0 END AS tuc FROM st_ LEFT JOIN se_ USING (package_id) LEFT JOIN rl_ USING (package_id) LEFT JOIN tr_ USING (package_id)),
e1 AS (SELECT *, coalesce(p1, 0e0) + p2 + p3 + p4 AS paths, 3 + (p1 IS NOT NULL)::INT AS np, CAST(ceil(tree_area / 25e0) AS DOUBLE) AS tree_count, {js('ceil(tree_area / 25e0) * tuc', 2)} AS tree_cost, {js('native_area * 120e0', 2)} AS planting_cost_total,
  2 + (tree_area IS NOT NULL)::INT + (native_area IS NOT NULL)::INT + (tuc IS NOT NULL)::INT AS plants FROM e0),
e2 AS (SELECT *, CASE WHEN exn > 0 THEN {js('kn / CAST(exn AS DOUBLE) * 100e0', 2)} ELSE 0e0 END AS spaces_score, {js('np / 4e0 * 100e0', 2)} AS paths_score, CASE WHEN r > 0 THEN {js('rw / CAST(r AS DOUBLE) * 100e0', 2)} ELSE 0e0 END AS adjacency_score, {js('plants / 5e0 * 100e0', 2)} AS plants_score,
  {js('(spaces + paths + coalesce(tree_cost, 0e0) + coalesce(planting_cost_total, 0e0)) * (1e0 + 10e0 / 100e0)', 2)} AS total, np = 4 AND tree_cost IS NOT NULL AND planting_cost_total IS NOT NULL AS whole FROM e1)"""


@query("design_estimate", f"WITH {PROG}, {ATTR}, {REL}, {RECON}, {ESTIMATE} SELECT package_id, {js('spaces', 2)} AS spaces_cost, {js('paths', 2)} AS paths_cost, tree_count, tree_cost, planting_cost_total, spaces_score, paths_score, adjacency_score, plants_score, "
       f"{js('(spaces_score + paths_score + adjacency_score + plants_score) / 4e0', 2)} AS readiness, total AS cost_with_contingency, CASE WHEN whole THEN 'complete_approximation' ELSE 'partial_lower_bound' END AS estimate_status, "
       "CASE WHEN total > 9000000e0 THEN 'known_cost_exceeds_target' WHEN whole THEN 'within_target' ELSE 'known_cost_within_target_incomplete' END AS target_status FROM e2")
def _(spark, sf):
    s = site_settings(spark, sf)
    k = F.col("package_id")
    st = s.select("package_id", (F.lit(480.0) + k % 50).alias("perimeter_m"), F.when(k % 3 != 0, F.lit(900.0)).alias("walking_length"), F.lit(3.0).alias("walking_width"), F.lit(2.0).alias("jogging_width"), F.lit(3.5).alias("cycling_width"), F.lit(120.0).alias("service_length"), F.lit(4.0).alias("service_width"),
                  F.lit(25.0).alias("canopy_per_tree"), F.when(k % 4 != 0, F.lit(1500.0)).alias("tree_unit_cost"), F.lit(120.0).alias("planting_cost"), F.lit(10.0).alias("contingency_pct"), F.lit(None).cast("double").alias("budget_target"), F.lit(9000000.0).alias("budget_cap"))
    p = full(spark, sf)
    return pk.design_estimate(p, pk.area_reconciliation(p, s), relationships(spark, sf), st)


@query("anchor_rank", f"""WITH {PROG}, {REL}, dm AS (SELECT l_partkey // {N} AS package_id, 'p' || ((l_partkey // {N}) * {N} + l_suppkey % {N + 1}) AS program_id, sum(greatest(0e0, l_quantity - 2e0)) AS d FROM lineitem GROUP BY ALL), dg AS (SELECT package_id, program_id, count(*) AS g FROM (SELECT package_id, source AS program_id FROM rel WHERE accepted UNION ALL SELECT package_id, target FROM rel WHERE accepted) GROUP BY ALL),
md AS (SELECT package_id, max(d) AS md FROM dm GROUP BY package_id), mg AS (SELECT package_id, max(g) AS mg FROM dg GROUP BY package_id), ma_ AS (SELECT package_id, max(target_area) AS ma FROM prg GROUP BY package_id),
s AS (SELECT p.package_id, p.program_id, {js('0.35e0 * greatest(0e0, least(1e0, priority)) + 0.25e0 * coalesce(coalesce(target_area, 0e0) / nullif(coalesce(ma, 0e0), 0e0), 0e0) + 0.2e0 * coalesce(d, 0e0) / greatest(1e0, coalesce(md, 0e0)) + 0.2e0 * coalesce(g, 0) / greatest(1e0, coalesce(mg, 0))', 9)} AS score FROM prg p LEFT JOIN dm ON dm.package_id = p.package_id AND dm.program_id = p.program_id LEFT JOIN dg ON dg.package_id = p.package_id AND dg.program_id = p.program_id LEFT JOIN md ON md.package_id = p.package_id LEFT JOIN mg ON mg.package_id = p.package_id LEFT JOIN ma_ ON ma_.package_id = p.package_id)
SELECT package_id, program_id, score, row_number() OVER (PARTITION BY package_id ORDER BY score DESC, program_id) AS rank FROM s""")
def _(spark, sf):
    _, p, r, _, d = package_parts(spark, sf)
    return pk.anchor_rank(p, d, r)


def hasv(*ws):
    return "(" + " OR ".join(f"contains(v, '{w}')" for w in ws) + ")"


_pl = ("playground", "toddler", "children play", "inclusive play")
_walk = f"CASE WHEN {hasv('operation', 'maintenance')} THEN {{'p': 'forbidden', 'b': 0e0}} WHEN {hasv(*_pl)} THEN {{'p': 'allowed', 'b': 0.55e0}} WHEN {hasv('plaza', 'lawn', 'flexible', 'event')} THEN {{'p': 'preferred', 'b': 0.9e0}} ELSE {{'p': 'allowed', 'b': 0.65e0}} END"
_cyc = f"CASE WHEN {hasv('operation', 'maintenance', 'court', *_pl, 'sensory', 'quiet garden', 'drop-off', 'drop off')} THEN {{'p': 'forbidden', 'b': 0e0}} WHEN {hasv('main entrance', 'gateway', 'community plaza')} THEN {{'p': 'controlled_only', 'b': 0.85e0}} WHEN {hasv('lawn', 'flexible recreation')} THEN {{'p': 'controlled_only', 'b': 0.7e0}} ELSE {{'p': 'controlled_only', 'b': 0.35e0}} END"
_srv = f"CASE WHEN {hasv('operation', 'maintenance', 'service yard')} THEN {{'p': 'destination_only', 'b': 0.8e0}} ELSE {{'p': 'forbidden', 'b': 0e0}} END"


@query("crossing_scores", f"""WITH {PROG}, v0 AS (SELECT package_id, program_id, lower(program_id || ' ' || name || ' ' || category) AS v, CASE WHEN k % 3 <> 0 THEN (k % 14) / 2e0 END AS cm FROM prg),
m AS (SELECT package_id, program_id, cm, 'walking' AS mode, 1.5e0 AS w, {_walk} AS r FROM v0 UNION ALL SELECT package_id, program_id, cm, 'cycling', 2.5e0, {_cyc} FROM v0 UNION ALL SELECT package_id, program_id, cm, 'service', 3e0, {_srv} FROM v0), c AS (SELECT *, coalesce(cm, w * 2e0) AS cl FROM m),
a AS (SELECT *, r.p <> 'forbidden' AND cl + 1e-6 >= w AS allowed FROM c) SELECT package_id, program_id, mode, r.p AS policy, allowed, CASE WHEN allowed THEN round_even((r.b * 0.65e0 + greatest(0e0, least(1e0, (cl - w) / greatest(w * 3e0, 1e0))) * 0.35e0) * 100e0, 2) ELSE 0e0 END AS score FROM a""")
def _(spark, sf):
    k = F.col("k")
    return pk.crossing_scores(programs(spark, sf).withColumn("clear_m", F.when(k % 3 != 0, (k % 14) / F.lit(2.0))))


@query("package_profile", f"WITH {PROG}, {ATTR}, m AS (SELECT *, CASE WHEN program_type IN ({', '.join(q(t) for t in on.OVERLAY_TYPES)}) THEN 'overlay' WHEN program_type IN ({', '.join(q(t) for t in on.SHARED_TYPES)}) THEN 'shared' ELSE 'exclusive' END AS spatial_mode FROM attr) SELECT package_id, program_class, spatial_mode, count(*) AS programs, sum(min_area) AS min_area, sum(target_area) AS target_area, sum(max_area) AS max_area FROM m GROUP BY ALL")
def _(spark, sf):
    return pk.package_profile(full(spark, sf))


# --- journeys and synthesis -----------------------------------------------------

_aff = ", ".join(f"({q(k)}, {q(on.AGE_TIERS[k])}, {q(cats[0])}, {q(cats[1])}, [{', '.join(map(q, cats))}], [{', '.join(map(q, tokens))}])" for k, (cats, tokens) in on.AFFINITY.items())


def dest(weight: str) -> str:
    """Relevance of every area program for every age group."""
    return f"""aff AS (SELECT * FROM (VALUES {_aff}) v(age_group, tier, c0, c1, cats, tokens)),
ds AS (SELECT park_id, age_group, tier, program, program_order, name, category, opportunity, target_area, len(list_filter(tokens, lambda t: contains(lower(replace(users, '|', ' ')), t))) AS n, c0, c1, cats FROM summ, aff WHERE geometry_type = 'area' AND target_area IS NOT NULL),
dr AS (SELECT *, n * 25e0 + CASE WHEN category = c0 THEN 25e0 WHEN category = c1 THEN 12e0 ELSE 0e0 END + opportunity * {weight} AS relevance, n > 0 OR list_contains(cats, category) AS relevant FROM ds)"""


_adj = ", ".join(f"({q(p['type'])}, {q(t)}, {i * 100 + k})" for i, p in enumerate(pg.PROGRAMS) for k, t in enumerate(p["preferred"] + p["movement"] + p["service"]))
_best = lambda cat, out: f"(SELECT park_id, program AS {out} FROM summ WHERE category = {q(cat)} QUALIFY row_number() OVER (PARTITION BY park_id ORDER BY opportunity DESC, program_order) = 1)"
_cap = lambda p, n: f"CASE WHEN len({p}) <= {n + 2} THEN {p} ELSE list_concat({p}[1:{n + 1}], {p}[len({p}):len({p})]) END"
#: Paths as whole lists with the places of the neighbours taken, the smallest list of a node winning.
JRN = f"""{dest('0.3e0')}, d8 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY park_id, age_group ORDER BY relevance DESC, program_order) AS rank FROM dr WHERE relevant) WHERE rank <= 8),
dj AS (SELECT d8.*, entry, amenity FROM d8 LEFT JOIN {_best('Arrival / Access', 'entry')} e USING (park_id) LEFT JOIN {_best('Comfort / Amenities', 'amenity')} a USING (park_id)),
ad0 AS (SELECT * FROM (VALUES {_adj}) v(s, t, q)), adj AS (SELECT u, v, min(q) AS q FROM (SELECT s AS u, t AS v, q FROM ad0 UNION ALL SELECT t, s, q FROM ad0) WHERE u <> v GROUP BY u, v),
prs AS (SELECT DISTINCT entry AS a, program AS b FROM dj WHERE entry IS NOT NULL UNION SELECT DISTINCT program, amenity FROM dj WHERE amenity IS NOT NULL),
bfs(a, node, path, ord) USING KEY (a, node) AS (SELECT DISTINCT a, a, [a], [-1] FROM prs UNION SELECT b.a, j.v, arg_min(list_append(b.path, j.v), list_append(b.ord, j.q)), min(list_append(b.ord, j.q)) FROM bfs b JOIN adj j ON j.u = b.node LEFT JOIN recurring.bfs r ON r.a = b.a AND r.node = j.v WHERE r.node IS NULL GROUP BY b.a, j.v),
pth AS (SELECT prs.a, prs.b, coalesce(path, [prs.a, prs.b]) AS path FROM prs LEFT JOIN bfs ON bfs.a = prs.a AND bfs.node = prs.b),
jf AS (SELECT dj.*, list_concat(coalesce(CASE WHEN i.a = i.b THEN [i.a] ELSE {_cap('i.path', 3)} END, [program]), coalesce(CASE WHEN amenity IS NOT NULL AND amenity <> program THEN ({_cap('o.path', 2)})[2:] ELSE [] END, [])) AS full_ FROM dj LEFT JOIN pth i ON i.a = entry AND i.b = program LEFT JOIN pth o ON o.a = program AND o.b = amenity),
jrn AS (SELECT park_id, 'journey_' || age_group || '_' || program AS journey_id, age_group, tier, program AS destination, rank, pos - 1 AS position, space, CASE WHEN space = entry THEN 'entry' WHEN space = program THEN 'primary_activity' WHEN space = amenity THEN 'amenity' ELSE 'circulation' END AS role
  FROM (SELECT *, unnest(full_) AS space, generate_subscripts(full_, 1) AS pos FROM jf))"""


@query("journeys", f"WITH RECURSIVE {OPP}, {SUMM}, {JRN} SELECT * FROM jrn")
def _(spark, sf):
    return pk.journeys(written_table(summary(spark, sf)[0]))


@query("journey_traversals", f"WITH RECURSIVE {OPP}, {SUMM}, {JRN}, c AS (SELECT park_id, space, count(*) AS n FROM jrn GROUP BY ALL) SELECT park_id, space, n, greatest(1e0, least(10e0, {js('n / CAST(greatest(1, max(n) OVER (PARTITION BY park_id)) AS DOUBLE) * 10e0')})) AS priority FROM c")
def _(spark, sf):
    return gr.traversal_counts(pk.journeys(written_table(summary(spark, sf)[0])), ["park_id"])


def _named(*ws):
    return "(" + " OR ".join(f"contains(lower(name), '{w}')" for w in ws) + ")"


_rates = " ".join(f"WHEN {q(m)} THEN {r}e0" for m, r in on.MATERIAL_RATES.items())
MATRIX = f"""{dest('0.4e0')}, bst AS (SELECT * FROM dr QUALIFY row_number() OVER (PARTITION BY park_id, age_group ORDER BY relevance DESC, program_order) = 1),
mx0 AS (SELECT park_id, age_group, tier, program, name, category, target_area, CASE WHEN {_named('play', 'sensory')} THEN 'EPDM_RUBBER' WHEN {_named('plaza', 'court', 'fitness', 'loop', 'jog', 'event')} THEN 'HIGH_ALBEDO_PAVING' WHEN {_named('garden', 'planting', 'nature', 'habitat', 'bioswale')} THEN 'NATURAL_GRAVEL' ELSE 'TURF' END AS material,
  CASE WHEN tier IN ('Kids', 'Old') THEN 'GATEWAY_NODE' WHEN category IN ('Arrival / Access', 'Movement') THEN 'PERIMETER_LOOP' WHEN tier = 'Teens' THEN 'ACTIVE_EDGE' ELSE 'INNER_BUFFER' END AS zone, CASE tier WHEN 'Old' THEN 'MORNING' WHEN 'Kids' THEN 'MIDDAY' ELSE 'EVENING' END AS "window" FROM bst),
mx AS (SELECT *, CASE material {_rates} END AS cost_rate FROM mx0),
syn0 AS (SELECT park_id, program, count(*) AS n, any_value(target_area) AS area, any_value(cost_rate) AS rate, string_agg(DISTINCT age_group, '|' ORDER BY age_group) AS archetypes FROM mx GROUP BY ALL), synt AS (SELECT park_id, sum(area) AS t FROM syn0 GROUP BY park_id),
syn1 AS (SELECT syn0.*, CASE WHEN t > 15000e0 AND t > 0 THEN 15000e0 / t ELSE 1e0 END AS f FROM syn0 JOIN synt USING (park_id)),
syn2 AS (SELECT park_id, program, n, CASE WHEN f <> 1 THEN greatest(1e0, {js('area * f')}) ELSE area END AS area, rate, archetypes, CAST(CASE WHEN n = 1 THEN 3 ELSE least(10, 3 + n * 2) END AS DOUBLE) AS overlap_score FROM syn1),
syn AS (SELECT *, {js('(18e0 + overlap_score) / 4e0')} AS composite FROM syn2)"""


@query("experience_matrix", f"WITH {OPP}, {SUMM}, {MATRIX} SELECT * FROM mx")
def _(spark, sf):
    return pk.experience_matrix(summary(spark, sf)[0])


@query("synthesis_metadata", f"WITH {OPP}, {SUMM}, {MATRIX}, m AS (SELECT park_id, {js('sum(area)')} AS total_area, {js('sum(area * rate)')} AS total_cost FROM syn GROUP BY park_id) SELECT *, CASE WHEN total_cost <= 9000000e0 THEN 'WITHIN_BUDGET' ELSE 'EXCEEDS_BUDGET' END AS budget_status FROM m")
def _(spark, sf):
    return pk.finalise_synthesis(written_table(pk.experience_matrix(summary(spark, sf)[0])), 15000.0, 9000000.0)["metadata"]


@query("shared_spaces", f"WITH {OPP}, {SUMM}, {MATRIX} SELECT *, CASE WHEN composite >= 8 THEN 'High' WHEN composite >= 5 THEN 'Medium' ELSE 'Low' END AS band FROM syn WHERE n >= 2")
def _(spark, sf):
    return pk.finalise_synthesis(written_table(pk.experience_matrix(summary(spark, sf)[0])), 15000.0, 9000000.0)["shared"].withColumn("archetypes", F.array_join("archetypes", "|"))


# --- export cells ---------------------------------------------------------------

EXY = UTM.replace("{src}", "sc")


@query("environment_export_cells", f"WITH {SCORED}, {EXY} SELECT h3_id, x AS centroid_x, y AS centroid_y, {', '.join(f'{e} AS {k}' for k, e in xp.ENVIRONMENT.items())}, CAST(NULL AS DOUBLE) AS wind_score, park_area_m2 / hex_area_m2 >= 0.3e0 AS \"constraint\" FROM utm")
def _(spark, sf):
    return xp.environment_cells(scored(spark, sf)).drop("park_id")


@query("community_export_cells", f"WITH {SCORED}, {EXY} SELECT h3_id, x AS centroid_x, y AS centroid_y, {', '.join(f'{e} AS {k}' for k, e in xp.COMMUNITY.items())} FROM utm")
def _(spark, sf):
    return xp.community_cells(scored(spark, sf)).drop("park_id")


RATES = f"""{ENRICHED}, {IMP}, tr AS (SELECT CAST(substr(place_id, 4) AS BIGINT) AS park_id, issue_category, count(*) AS mentions, count(*) / CAST(sum(count(*)) OVER (PARTITION BY place_id) AS DOUBLE) AS ms, avg(CASE WHEN sentiment = 'NEGATIVE' THEN 1e0 ELSE 0e0 END) AS ns, avg(CASE WHEN sentiment = 'POSITIVE' THEN 1e0 ELSE 0e0 END) AS ps FROM enriched GROUP BY place_id, issue_category)"""


@query("review_export_cells", f"WITH {SCORED}, {RATES}, t AS (SELECT park_id, sum(population) AS p, count(*) AS n FROM sc GROUP BY park_id), w AS (SELECT sc.park_id, h3_id, least(1e0, population / coalesce(nullif(p, 0e0), 1e0) * n) AS w FROM sc JOIN t USING (park_id)), o AS (SELECT CAST(substr(place_id, 4) AS BIGINT) AS park_id, {js('(avg(CASE WHEN sentiment = ' + q('POSITIVE') + ' THEN 1e0 WHEN sentiment = ' + q('NEGATIVE') + ' THEN -1e0 ELSE 0e0 END) + 1e0) / 2e0 * 100e0')} AS sat FROM enriched GROUP BY place_id), "
       "r AS (SELECT park_id, " + ", ".join(f"max(CASE WHEN issue_category = {q(c)} THEN least(1e0, ms * 0.5e0 + ns * 0.5e0) END) AS r{i}, max(CASE WHEN issue_category = {q(c)} THEN ms END) AS m{i}, max(CASE WHEN issue_category = {q(c)} THEN ps END) AS p{i}" for i, c in enumerate(xp.REVIEW_TOPICS)) + " FROM tr GROUP BY park_id) "
       "SELECT w.park_id, h3_id, " + ", ".join(f"{js(f'coalesce(r{xp.REVIEW_TOPICS.index(c)}, 0e0) * w', 3)} AS {k}" for k, c in xp.REVIEW_FIELDS.items()) + f", {js('coalesce(m' + str(xp.REVIEW_TOPICS.index('crowding')) + ', 0e0) * w', 3)} AS event_space_demand, {js('w * coalesce(p' + str(xp.REVIEW_TOPICS.index('landscape / greenery')) + ', 0e0)', 3)} AS positive_identity_value, {js('sat / 100e0 * w', 3)} AS community_satisfaction FROM w JOIN r USING (park_id) JOIN o USING (park_id)")
def _(spark, sf):
    r = review_parks_table(spark, sf)
    return xp.review_cells(scored(spark, sf), xp.topic_rates(r, ["park_id"]), r)


@query("review_program_export", f"WITH {RATES}, pm AS (SELECT * FROM (VALUES {values_list([(k, xp.PROGRAM_TOPICS.get(k)) for k in [p['key'] for p in pg.PLANNING_PROGRAMS]])}) v(program, topic)), pk_ AS (SELECT DISTINCT park_id FROM tr), j AS (SELECT pk_.park_id, program, mentions, ms, ns FROM pk_ CROSS JOIN pm LEFT JOIN tr ON tr.park_id = pk_.park_id AND tr.issue_category = pm.topic), "
       f"s AS (SELECT *, CASE WHEN mentions IS NULL THEN 30e0 ELSE least(100e0, {js('least(1e0, ms * 3e0) * 50e0 + ns * 100e0 * 0.5e0')}) END AS d FROM j) SELECT park_id, program, d / 100e0 AS demand_score, coalesce(mentions, 0) AS evidence_count, CASE WHEN d >= 75 THEN 'very_high' WHEN d >= 50 THEN 'high' WHEN d >= 25 THEN 'medium' ELSE 'low' END AS priority, {js('least(95e0, 35e0 + coalesce(mentions, 0) * 3e0)')} / 100e0 AS confidence FROM s")
def _(spark, sf):
    return xp.review_programs(xp.topic_rates(review_parks(spark, sf), ["park_id"]), ["park_id"])
