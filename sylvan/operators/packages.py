"""Program ontology, relationships, rules, package quality, areas, estimates and journeys, over many packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import ontology as on
from ..functions import programs as pg
from ..functions.numeric import any_of, clamp, count_where, js_round
from ..functions.session import fixed_table
from .graph import bfs_paths, capped_path

PKG = ("package_id",)


def normalise_user_groups(programs: DataFrame, group_cols=PKG) -> DataFrame:
    """Distinct user-group ids per program: exact alias, else a long alias inside the text, else all visitors.

    ``programs``: program_id, users array<string>.  Every user text is resolved in its row
    against the fixed alias list.
    """
    groups = "array(" + ", ".join(f"named_struct('g', '{g}', 'a', array({', '.join(repr(a) for a in al)}))" for g, al, _, _ in on.USER_GROUPS) + ")"

    def resolve(u):
        v = F.lower(F.trim(u))
        exact = F.filter(F.expr(groups), lambda x: F.array_contains(x["a"], v))
        loose = F.filter(F.expr(groups), lambda x: F.exists(x["a"], lambda a: (F.length(a) >= 6) & F.contains(v, a)))
        ids = lambda s: F.transform(s, lambda x: x["g"])
        return F.when(F.size(exact) > 0, ids(exact)).when(F.size(loose) > 0, ids(loose)).otherwise(F.array(F.lit("all_visitors")))

    return programs.withColumn("user_groups", F.array_distinct(F.flatten(F.transform("users", resolve))))


def program_attributes(programs: DataFrame) -> DataFrame:
    """Class, behaviour, performance, seasonal, temporal, commercial and landform attributes (needs name, category, geometry_type, scale)."""
    return programs.withColumn("nm", F.lower("name")).selectExpr("*", *[f"{e} AS {k}" for k, e in on.FORMULAS.items()]).drop("nm")


def clamp3(x, lo=0.0):
    return clamp(js_round(x, 3), F.lit(lo), F.lit(1.0))


def user_program_suitability(programs: DataFrame, group_cols=PKG) -> DataFrame:
    """Suitability of every user group for every program; the 14 groups are fanned out in the row."""
    g = F.array(*[F.struct(F.lit(gid).alias("user_group"), *[F.lit(float(v)).alias(n) for n, v in zip(("s", "a", "f", "o", "c", "q"), need)], F.lit(float(su)).alias("summer")) for gid, _, need, su in on.USER_GROUPS])
    d = programs.select(*group_cols, "program_id", "user_groups", "summer_fit", "shade_demand", "accessibility_demand", "safety_sensitivity", "social_intensity", "activity_intensity", "quiet_demand", F.inline(g))
    direct = F.when(F.array_contains("user_groups", F.col("user_group")), 1.0).when(F.array_contains("user_groups", "all_visitors"), 0.72).otherwise(0.25)
    num = (F.col("s") * F.col("shade_demand") + F.col("a") * F.col("accessibility_demand") + F.col("f") * F.col("safety_sensitivity") + F.col("o") * F.col("social_intensity")
           + F.col("c") * F.col("activity_intensity") + F.col("q") * F.col("quiet_demand"))
    need = num / F.greatest(F.lit(0.001), F.col("s") + F.col("a") + F.col("f") + F.col("o") + F.col("c") + F.col("q"))
    summer = F.lit(1.0) - F.abs(F.col("summer") - F.col("summer_fit"))
    return d.select(*group_cols, "user_group", "program_id", direct.alias("direct"), clamp3(need).alias("need_fit"), clamp3(summer).alias("summer_match"),
                    clamp3(F.lit(0.55) * direct + F.lit(0.3) * need + F.lit(0.15) * summer).alias("weight"))


def pairwise_relationships(programs: DataFrame, group_cols=PKG) -> DataFrame:
    """Advisory score of every program pair of a package (a before b by ``program_order``).

    ``programs``: program_id, program_type, program_order, user_groups, activity_intensity,
    quiet_demand and the adjacency arrays preferred, movement, service, avoid_adjacent (of types).
    """
    keys = list(group_cols)
    cols = ["program_id", "program_type", "program_order", "user_groups", "activity_intensity", "quiet_demand", "preferred", "movement", "service", "avoid_adjacent"]
    a = programs.select(*keys, *[F.col(c).alias(f"a_{c}") for c in cols])
    b = programs.select(*keys, *[F.col(c).alias(f"b_{c}") for c in cols])
    p = a.join(b, keys).filter(F.col("a_program_order") < F.col("b_program_order"))
    has = lambda n: F.array_contains(F.col(f"a_{n}"), F.col("b_program_type")) | F.array_contains(F.col(f"b_{n}"), F.col("a_program_type"))
    val = lambda n, v: F.when(has(n), F.lit(v)).otherwise(F.lit(0.0))
    shared = F.size(F.array_intersect("a_user_groups", "b_user_groups")) / F.greatest(F.lit(1), F.size(F.array_union("a_user_groups", "b_user_groups")))
    conflict = F.abs(F.col("a_activity_intensity") - F.col("b_activity_intensity")) * F.least("a_quiet_demand", "b_quiet_demand")
    score = clamp3(F.lit(0.5) * val("preferred", 1.0) + F.lit(0.25) * val("movement", 0.8) + F.lit(0.15) * val("service", 0.65) + F.lit(0.25) * shared - F.lit(0.8) * val("avoid_adjacent", 1.0) - F.lit(0.35) * conflict, -1.0)
    return p.select(*keys, F.col("a_program_id").alias("source"), F.col("b_program_id").alias("target"), score.alias("score"),
                    F.when(score > 0.15, "attract").when(score < -0.15, "repel").otherwise("neutral").alias("type"), clamp3(shared).alias("shared_users"), clamp3(conflict).alias("activity_conflict"))


def overlap_edges(programs: DataFrame, group_cols=PKG) -> DataFrame:
    """Curated compatible pairs whose two programs are both in the package."""
    keys = list(group_cols)
    pairs = fixed_table(programs.sparkSession, [(a, b, float(s), m) for a, b, s, m in on.OVERLAPS], "source string, target string, compatibility double, mode string")
    known = programs.select(*keys, F.col("program_type").alias("t")).distinct()
    e = known.join(pairs, F.col("t") == F.col("source")).drop("t")
    return e.join(known.withColumnRenamed("t", "target"), [*keys, "target"], "left_semi")


def normalise_entity(c):
    c = F.regexp_replace(c, r"([a-z])([A-Z])", "$1 $2")
    c = F.replace(F.lower(c), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(c, r"[^a-z0-9]+", " "))


def map_entities(spark) -> DataFrame:
    """Name -> candidate programs with the best method (type, then name, then approved alias); a fixed table."""
    rows = [(p["type"], p["type"], 1, "exact_type") for p in pg.PROGRAMS] + [(p["name"], p["type"], 2, "exact_name") for p in pg.PROGRAMS] + [(a, p, 3, "approved_alias") for a, ps in on.ALIASES.items() for p in ps]
    t = spark.createDataFrame(rows, "entity string, program string, rank int, method string").withColumn("entity", normalise_entity(F.col("entity")))
    best = t.groupBy("entity").agg(F.min("rank").alias("rank"))
    g = t.join(best, ["entity", "rank"]).groupBy("entity").agg(F.sort_array(F.collect_set("program")).alias("candidates"), F.min("method").alias("method"))
    return F.broadcast(g)


def compile_rules(rules: DataFrame, blocked: DataFrame) -> DataFrame:
    """Active rules -> edges or an ordered rejection reason (column ``reason``, null for edges).

    ``rules``: rule_id, status, source_entity, relationship, target_entity, rule_category,
    requirement_level, numeric_parameter, numeric_value, numeric_unit, numeric_approved;
    ``blocked``: rule_id of rules in an open conflict.
    """
    m = map_entities(rules.sparkSession)
    side = lambda s: m.select(F.col("entity").alias(f"_{s}"), F.col("candidates").alias(f"{s}_candidates"), F.col("method").alias(f"{s}_method"))
    r = rules.filter(F.col("status") == "active").withColumns({"_source": normalise_entity(F.col("source_entity")), "_target": normalise_entity(F.col("target_entity"))})
    r = r.join(side("source"), "_source", "left").join(side("target"), "_target", "left").join(blocked.select("rule_id", F.lit(True).alias("_b")), "rule_id", "left")
    ns, nt = F.coalesce(F.size("source_candidates"), F.lit(0)), F.coalesce(F.size("target_candidates"), F.lit(0))
    ns, nt = F.greatest(ns, F.lit(0)), F.greatest(nt, F.lit(0))
    numeric_bad = F.col("numeric_parameter").isNotNull() & (F.col("numeric_value").isNull() | F.col("numeric_unit").isNull() | ~F.coalesce("numeric_approved", F.lit(False)))
    s0, t0 = F.get("source_candidates", F.lit(0)), F.get("target_candidates", F.lit(0))
    reason = (F.when(F.coalesce("_b", F.lit(False)), "active_conflict").when(numeric_bad, "invalid_numeric_provenance").when(ns == 0, "source_unmapped").when(ns > 1, "source_ambiguous")
              .when(nt == 0, "target_unmapped").when(nt > 1, "target_ambiguous").when(s0 == t0, "self_relationship"))
    text = normalise_entity(F.concat_ws(" ", "rule_category", "relationship", "numeric_parameter"))
    # Words of the graph layers and of directed relations.
    layer = (F.when(text.rlike("visibility|sightline|supervision|overlook"), "visibility").when(text.rlike("distance|setback|separation|buffer|proximity"), "distance")
             .when(text.rlike("avoid|prohibit|constraint|exclusion"), "constraints").when(text.rlike("movement|circulation|route|sequence|access|connectivity"), "movement").otherwise("functional"))
    directed = layer.isin("visibility", "movement") | normalise_entity(F.col("relationship")).rlike("depends|serves|provides|leads|feeds|requires")
    return r.select("rule_id", reason.alias("reason"), F.when(reason.isNull(), s0).alias("source"), F.when(reason.isNull(), t0).alias("target"), F.when(reason.isNull(), layer).alias("graph_layer"),
                    F.when(reason.isNull(), directed).alias("directed"), (F.col("requirement_level") == "mandatory").alias("mandatory"), "source_method", "target_method")


def relation_type(c):
    t = F.lower(c)
    has = lambda *ws: any_of([F.contains(t, F.lit(w)) for w in ws])
    # Words of the relation types.
    return (F.when(has("overlap"), "overlap_compatible").when(has("avoid", "separat", "buffer"), "avoid").when(has("prefer", "adjacent", "near"), "preferred").when(has("service"), "service")
            .when(has("movement", "connect"), "movement").when(has("visibility", "sight"), "visibility").when(has("distance"), "distance").otherwise(F.trim(t)))


def compile_relationship_graph(rel: DataFrame, programs: DataFrame, group_cols=PKG) -> dict[str, DataFrame]:
    """Merged edges, conflicts and unknown references of each package's relationships.

    ``rel``: relationship_id, source, target, type, authority, accepted, mandatory, directed,
    confidence; ``programs``: program_id, priority.
    """
    keys = list(group_cols)
    pr = programs.groupBy(*keys, "program_id").agg(F.min("priority").alias("priority"))
    ps = pr.select(*keys, F.col("program_id").alias("source"), F.col("priority").alias("_ps"))
    pt = pr.select(*keys, F.col("program_id").alias("target"), F.col("priority").alias("_pt"))
    j = rel.join(ps, [*keys, "source"], "left").join(pt, [*keys, "target"], "left")
    unknown = j.filter(F.col("_ps").isNull() | F.col("_pt").isNull()).select(*keys, "relationship_id", F.when(F.col("_ps").isNull(), F.col("source")).otherwise(F.col("target")).alias("unknown_program"))
    v = j.filter(F.col("_ps").isNotNull() & F.col("_pt").isNotNull()).withColumn("_type", relation_type(F.col("type")))
    sym = F.col("_type").isin("preferred", "avoid", "overlap_compatible")
    swap = sym & (F.col("source") > F.col("target"))
    auth = F.when(F.lower("authority") == "accepted_rule", "accepted_rule").when(F.col("accepted") | F.contains(F.lower("authority"), F.lit("designer_approved")), "designer_approved").otherwise("advisory")
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    v = v.select(*keys, auth.alias("authority"), pick("source", "target").alias("source"), pick("target", "source").alias("target"), pick("_ps", "_pt").alias("_ps"), pick("_pt", "_ps").alias("_pt"),
                 F.col("_type").alias("type"), (~sym & F.col("directed")).alias("directed"), "mandatory", "confidence", "relationship_id")
    e = v.groupBy(*keys, "authority", "source", "target", "type", "directed").agg(F.min("relationship_id").alias("edge_id"), F.max("mandatory").alias("_m"), F.avg("confidence").alias("_c"),
                                                                                  F.first("_ps").alias("_ps"), F.first("_pt").alias("_pt"), F.count(F.lit(1)).alias("merged"))
    base = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in on.BASE_STRENGTH.items() for x in kv]), F.col("type")), F.lit(0.5))
    u = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    w = u(base * u(F.col("_ps")) * (F.lit(0.5) + F.lit(0.5) * u(F.col("_pt"))) * (F.lit(0.5) + F.lit(0.5) * u(F.coalesce("_c", F.lit(0.5)))))
    acc = F.col("authority") != "advisory"
    e = e.withColumns({"weight": F.when(acc, F.lit(1.0)).otherwise(w), "mandatory": acc & F.col("_m")}).drop("_m", "_c", "_ps", "_pt")
    opp = e.filter((F.col("authority") == "accepted_rule") & F.col("type").isin("avoid", "preferred")).select(
        *keys, "source", "target", F.when(F.col("type") == "avoid", "preferred").otherwise("avoid").alias("type"), F.col("type").alias("accepted_type"), F.lit("advisory").alias("authority"))
    conflicts = e.join(opp, [*keys, "source", "target", "type", "authority"]).select(*keys, "source", "target", F.col("type").alias("advisory_type"), "accepted_type")
    edges = e.join(opp, [*keys, "source", "target", "type", "authority"], "left_anti")
    return {"edges": edges, "conflicts": conflicts, "unknown": unknown}


ATTRACT = ["adjacency", "preferred_adjacency", "preferred", "supervision", "shared_edge"]
REPEL = ["avoid", "avoidance", "acoustic_separation"]


def validate_packages(pk: DataFrame, programs: DataFrame, rel: DataFrame, journeys: DataFrame, demands: DataFrame) -> DataFrame:
    """Issue rows (package_id, severity, code, related_id).

    ``pk``: package_id, schema_version, project_id, project_name, crs, units, site_area;
    ``programs``: program_id, program_class, space_class, common_class, priority, min_area,
    target_area, max_area, geometry_type, required, spatial_mode, coverage_pct,
    suitability_field, n_constraints, aspect_min, aspect_max, compactness, minimum_width, has_geometry;
    ``rel``: relationship_id, source, target, type, weight, minimum_distance, maximum_distance, mandatory;
    ``journeys``: journey_id, weight, space (one row per step); ``demands``: origin, destination, weight.
    """
    def rows(df, cond, code, rid, severity="error"):
        return df.filter(F.coalesce(cond, F.lit(False))).select("package_id", F.lit(severity).alias("severity"), F.lit(code).alias("code"), rid.cast("string").alias("related_id"))

    def flags(df, specs, rid):
        """Several checks over one table in one pass."""
        arr = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(code).alias("code"))) for code, c, s in specs]))
        return df.select("package_id", rid.cast("string").alias("related_id"), F.inline(arr)).select("package_id", "severity", "code", "related_id")

    bad01 = lambda c: c.isNull() | F.isnan(c) | (c < 0) | (c > 1)
    neg = lambda c: c.isNotNull() & (F.isnan(c) | (c < 0))
    ok = lambda c: F.when((F.col(c) >= 0) & ~F.isnan(c), F.col(c))
    pos = lambda c: F.when(F.col(c) > 0, F.col(c))
    E, Wn = "error", "warning"
    space, pid = F.col("program_class") == "SPACE", F.col("program_id")
    mn, tg, mx = ok("min_area"), ok("target_area"), ok("max_area")
    need = space & (F.col("geometry_type") == "area") & F.col("required") & tg.isNull()
    overlay = F.coalesce("spatial_mode", F.lit("exclusive")) == "overlay"
    out = [flags(pk, [("SCHEMA_VERSION_MISSING", F.col("schema_version").isNull(), E), ("PROJECT_MISSING", F.col("project_id").isNull() | F.col("project_name").isNull(), E),
                      ("SITE_REFERENCE_MISSING", F.col("crs").isNull() | F.col("units").isNull(), E), ("SITE_AREA_MISSING", pos("site_area").isNull(), Wn)], F.lit(None))]
    out.append(flags(programs, [
        ("PROGRAM_CLASS_INVALID", ~F.coalesce(F.col("program_class").isin("PATH", "SPACE"), F.lit(False)), E), ("SPACE_CLASS_INVALID", space & ~F.coalesce(F.col("space_class").isin("USER_SPECIFIC", "COMMON", "UTILITY"), F.lit(False)), E),
        ("COMMON_CLASS_INVALID", (F.col("space_class") == "COMMON") & ~F.coalesce(F.col("common_class").isin("GENERAL", "COMMERCIAL", "EXPERIENCE"), F.lit(False)), E), ("PROGRAM_PRIORITY_INVALID", bad01(F.col("priority")), E),
        ("PROGRAM_AREA_INVALID", neg(F.col("min_area")) | neg(F.col("target_area")) | neg(F.col("max_area")), E), ("PROGRAM_COVERAGE_TARGET_MISSING", need & overlay & ok("coverage_pct").isNull(), Wn),
        ("PROGRAM_COVERAGE_TARGET_INVALID", need & overlay & (F.col("coverage_pct") > 100), E), ("PROGRAM_AREA_MISSING", need & ~overlay, Wn), ("PROGRAM_AREA_RANGE_INVALID", mn > mx, E),
        ("PROGRAM_TARGET_BELOW_MINIMUM", tg < mn, E), ("PROGRAM_TARGET_ABOVE_MAXIMUM", tg > mx, E), ("GEOMETRY_PREFERENCES_MISSING", ~F.col("has_geometry"), Wn),
        ("GEOMETRY_ASPECT_RATIO_INVALID", F.col("has_geometry") & (pos("aspect_min") > pos("aspect_max")), E), ("GEOMETRY_COMPACTNESS_INVALID", F.col("has_geometry") & F.col("compactness").isNotNull() & bad01(F.col("compactness")), E),
        ("GEOMETRY_MINIMUM_WIDTH_INVALID", F.col("has_geometry") & F.col("minimum_width").isNotNull() & pos("minimum_width").isNull(), E),
        ("PROGRAM_SPATIAL_RULES_MISSING", F.col("required") & F.col("suitability_field").isNull() & (F.col("n_constraints") == 0) & space, Wn)], pid))
    ids = programs.groupBy("package_id", "program_id").agg(F.count(F.lit(1)).alias("_n"), F.max("target_area").alias("_t"))
    out.append(rows(ids, (F.trim("program_id") == "") | (F.col("_n") > 1), "PROGRAM_ID_DUPLICATE", pid))
    known = ids.select("package_id", "program_id")

    def dangling(df, col, code, rid):
        return df.join(known.withColumnRenamed("program_id", col), ["package_id", col], "left_anti").select("package_id", F.lit(E).alias("severity"), F.lit(code).alias("code"), rid.cast("string").alias("related_id"))

    out += [dangling(rel, "source", "RELATIONSHIP_SOURCE_MISSING", F.col("relationship_id")), dangling(rel, "target", "RELATIONSHIP_TARGET_MISSING", F.col("relationship_id")),
            flags(rel, [("RELATIONSHIP_WEIGHT_INVALID", F.col("weight").isNotNull() & bad01(F.col("weight")), E), ("RELATIONSHIP_DISTANCE_CONFLICT", ok("minimum_distance") > ok("maximum_distance"), E)], F.col("relationship_id"))]
    t = F.lower("type")
    pairs = rel.filter("mandatory").groupBy("package_id", F.least("source", "target").alias("_a"), F.greatest("source", "target").alias("_b")).agg(F.max(t.isin(ATTRACT)).alias("_at"), F.max(t.isin(REPEL)).alias("_re"))
    out.append(rows(pairs, F.col("_at") & F.col("_re"), "RELATIONSHIP_CONSTRAINT_CONFLICT", F.concat_ws("|", "_a", "_b")))
    jw = journeys.groupBy("package_id", "journey_id").agg(F.max("weight").alias("weight"))
    out += [rows(jw, bad01(F.col("weight")), "JOURNEY_WEIGHT_INVALID", F.col("journey_id")), dangling(journeys, "space", "JOURNEY_PROGRAM_MISSING", F.col("journey_id"))]
    bad_d = demands.join(known.withColumnRenamed("program_id", "origin").withColumn("_o", F.lit(1)), ["package_id", "origin"], "left").join(known.withColumnRenamed("program_id", "destination").withColumn("_d", F.lit(1)), ["package_id", "destination"], "left")
    out += [rows(bad_d, F.col("_o").isNull() | F.col("_d").isNull(), "MOVEMENT_DEMAND_PROGRAM_MISSING", F.concat_ws("|", "origin", "destination")), rows(demands, neg(F.col("weight")) | F.col("weight").isNull(), "MOVEMENT_DEMAND_WEIGHT_INVALID", F.concat_ws("|", "origin", "destination"))]
    linked = rel.select("package_id", F.explode(F.array("source", "target")).alias("program_id")).unionByName(journeys.select("package_id", F.col("space").cast("string").alias("program_id"))).distinct()
    out.append(known.join(linked, ["package_id", "program_id"], "left_anti").groupBy("package_id").agg(F.count(F.lit(1)).alias("_n")).select("package_id", F.lit(Wn).alias("severity"), F.lit("ORPHAN_PROGRAMS").alias("code"), F.col("_n").cast("string").alias("related_id")))
    area = programs.filter(space & ~F.coalesce(F.col("spatial_mode").isin("shared", "overlay"), F.lit(False))).groupBy("package_id").agg(F.sum(tg).alias("_x"))
    out.append(rows(area.join(pk.select("package_id", "site_area"), "package_id"), F.col("_x") > pos("site_area"), "PROGRAM_AREA_EXCEEDS_SITE", F.lit(None)))
    res = out[0]
    for d in out[1:]:
        res = res.unionByName(d)
    return res


def spatial_mode(program_type="program_type"):
    t = F.col(program_type)
    return F.when(t.isin(on.OVERLAY_TYPES), "overlay").when(t.isin(on.SHARED_TYPES), "shared").otherwise("exclusive")


def area_reconciliation(programs: DataFrame, sites: DataFrame) -> DataFrame:
    """Exclusive, shared and overlay sums, remaining area and status per package.

    ``programs``: program_type, geometry_type, target_area; ``sites``: package_id, brief_area,
    measured_area, leasable_pct, operations_area, dropoff_area, circulation_area, tree_pct, native_pct.
    """
    p = programs.filter(F.col("geometry_type") == "area").join(sites.select("package_id", "operations_area", "dropoff_area"), "package_id")
    t = F.col("program_type")
    target = F.when(t == "operationsArea", F.col("operations_area")).when(t == "dropOffZone", F.col("dropoff_area")).otherwise(F.when(F.col("target_area") >= 0, F.col("target_area")))
    p = p.withColumns({"_t": target, "_m": spatial_mode()})
    special = t.isin("operationsArea", "dropOffZone")
    s = lambda c: F.sum(F.when(c, F.coalesce("_t", F.lit(0.0))).otherwise(0.0))
    g = p.groupBy("package_id").agg(s((F.col("_m") == "exclusive") & ~special).alias("_ex"), s(F.col("_m") == "shared").alias("_sh"), s(F.col("_m") == "overlay").alias("_ov"),
                                    count_where((F.col("_m") == "exclusive") & F.col("_t").isNull()).alias("unresolved_exclusive"))
    j = sites.join(g, "package_id", "left").fillna(0, ["_ex", "_sh", "_ov", "unresolved_exclusive"])
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    com = F.col("_ex") + z("operations_area") + z("dropoff_area") + z("circulation_area")
    j = j.withColumns({"_com": com, "remaining_area": js_round(F.col("measured_area") - com, 2)})
    status = F.when(F.col("remaining_area") < 0, "overallocated").when((F.col("unresolved_exclusive") > 0) | F.col("circulation_area").isNull(), "incomplete").otherwise("complete")
    cover = lambda c: js_round(F.col("measured_area") * F.when((F.col(c) >= 0) & (F.col(c) <= 100), F.col(c)) / 100.0, 2)
    return j.select("package_id", status.alias("status"), js_round("brief_area", 2).alias("brief_area"), js_round("measured_area", 2).alias("measured_area"), js_round(F.col("measured_area") - F.col("brief_area"), 2).alias("variance"),
                    js_round("_ex", 2).alias("exclusive_area"), js_round("_com", 2).alias("committed_area"), "remaining_area", js_round("_sh", 2).alias("shared_area"), js_round("_ov", 2).alias("overlay_area"),
                    js_round(F.col("brief_area") * F.col("leasable_pct") / 100.0, 2).alias("leasable_cap"), "unresolved_exclusive", cover("tree_pct").alias("tree_area"), cover("native_pct").alias("native_area"))


def materiality(name):
    n = F.lower(name)
    has = lambda *ws: any_of([F.contains(n, F.lit(w)) for w in ws])
    return (F.when(has("play", "sensory"), "EPDM_RUBBER").when(has("plaza", "court", "fitness", "event"), "HIGH_ALBEDO_PAVING")
            .when(has("garden", "planting", "nature", "habitat", "bioswale"), "NATURAL_GRAVEL").otherwise("TURF"))


def _rate(m):
    return F.element_at(F.create_map(*[F.lit(x) for kv in on.MATERIAL_RATES.items() for x in kv]), m)


def design_estimate(programs: DataFrame, recon: DataFrame, rel: DataFrame, settings: DataFrame) -> DataFrame:
    """Space, path, tree and planting cost, readiness scores and budget status; unknown inputs stay null.

    ``settings``: package_id, perimeter_m, walking_length, walking_width, jogging_width,
    cycling_width, service_length, service_width, canopy_per_tree, tree_unit_cost,
    planting_cost, contingency_pct, budget_target, budget_cap.
    """
    ex = (F.col("program_class") == "SPACE") & (F.col("geometry_type") == "area") & (spatial_mode() == "exclusive")
    known = ex & (F.col("target_area") >= 0)
    cost = F.col("target_area") * _rate(materiality(F.concat_ws(" ", "program_type", "name")))
    p = programs.groupBy("package_id").agg(count_where(ex).alias("_ex"), count_where(known).alias("_kn"), F.sum(F.when(known, cost).otherwise(0.0)).alias("_spaces"))
    r = rel.groupBy("package_id").agg(F.count(F.lit(1)).alias("_r"), count_where(F.col("weight") >= 0).alias("_rw"))
    j = settings.join(p, "package_id", "left").join(r, "package_id", "left").join(recon.select("package_id", "tree_area", "native_area"), "package_id", "left").fillna(0, ["_ex", "_kn", "_spaces", "_r", "_rw"])
    posv = lambda c: F.when(F.col(c) > 0, F.col(c))
    okv = lambda c: F.when(F.col(c) >= 0, F.col(c))
    rate = F.lit(on.MATERIAL_RATES["HIGH_ALBEDO_PAVING"])
    lengths = [(posv("walking_length"), posv("walking_width")), (F.lit(1000.0), posv("jogging_width")), (js_round("perimeter_m", 2), posv("cycling_width")), (posv("service_length"), posv("service_width"))]
    pc = [js_round(js_round(a * b, 2) * rate, 2) for a, b in lengths]
    n_known = sum([F.when(x.isNotNull(), 1).otherwise(0) for x in pc], F.lit(0))
    trees = F.ceil(F.col("tree_area") / posv("canopy_per_tree"))
    tree_cost, plant_cost = js_round(trees * okv("tree_unit_cost"), 2), js_round(F.col("native_area") * okv("planting_cost"), 2)
    j = j.withColumns({"_paths": sum([F.coalesce(x, F.lit(0.0)) for x in pc], F.lit(0.0)), "_np": n_known, "tree_count": trees.cast("double"), "tree_cost": tree_cost, "planting_cost_total": plant_cost})
    plants = sum([F.when(x.isNotNull(), 1).otherwise(0) for x in (F.col("tree_area"), F.col("native_area"), posv("canopy_per_tree"), okv("tree_unit_cost"), okv("planting_cost"))], F.lit(0))
    sc = {"spaces_score": F.when(F.col("_ex") > 0, js_round(F.col("_kn") / F.col("_ex") * 100.0, 2)).otherwise(0.0), "paths_score": js_round(F.col("_np") / 4.0 * 100.0, 2),
          "adjacency_score": F.when(F.col("_r") > 0, js_round(F.col("_rw") / F.col("_r") * 100.0, 2)).otherwise(0.0), "plants_score": js_round(plants / 5.0 * 100.0, 2)}
    j = j.withColumns(sc)
    base = F.col("_spaces") + F.col("_paths") + F.coalesce("tree_cost", F.lit(0.0)) + F.coalesce("planting_cost_total", F.lit(0.0))
    j = j.withColumns({"_all": js_round(base * (F.lit(1.0) + F.coalesce(okv("contingency_pct"), F.lit(0.0)) / 100.0), 2), "_target": F.least(F.coalesce(okv("budget_target"), F.col("budget_cap")), F.col("budget_cap")),
                       "_full": (F.col("_np") == 4) & F.col("tree_cost").isNotNull() & F.col("planting_cost_total").isNotNull()})
    return j.select("package_id", js_round("_spaces", 2).alias("spaces_cost"), F.when(F.col("_np") > 0, js_round("_paths", 2)).alias("paths_cost"), "tree_count", "tree_cost", "planting_cost_total", *sc,
                    js_round((F.col("spaces_score") + F.col("paths_score") + F.col("adjacency_score") + F.col("plants_score")) / 4.0, 2).alias("readiness"), F.col("_all").alias("cost_with_contingency"),
                    F.when(F.col("_full"), "complete_approximation").otherwise("partial_lower_bound").alias("estimate_status"),
                    F.when(F.col("_all") > F.col("_target"), "known_cost_exceeds_target").when(F.col("_full"), "within_target").otherwise("known_cost_within_target_incomplete").alias("target_status"))


def anchor_rank(programs: DataFrame, demands: DataFrame, rel: DataFrame) -> DataFrame:
    """Anchor score of each program: priority, area, incoming demand and accepted degree."""
    k = ["package_id"]
    d = demands.groupBy(*k, F.col("destination").alias("program_id")).agg(F.sum(F.greatest(F.lit(0.0), F.col("weight"))).alias("_d"))
    g = rel.filter("accepted").select(*k, F.explode(F.array("source", "target")).alias("program_id")).groupBy(*k, "program_id").agg(F.count(F.lit(1)).alias("_g"))
    top = lambda df, c, o: df.groupBy(*k).agg(F.max(c).alias(o))
    j = programs.select(*k, "program_id", "priority", "target_area").join(d, [*k, "program_id"], "left").join(g, [*k, "program_id"], "left")
    j = j.join(top(programs, "target_area", "_ma"), k, "left").join(top(d, "_d", "_md"), k, "left").join(top(g, "_g", "_mg"), k, "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    one = lambda c: F.greatest(F.lit(1.0), z(c))
    s = (F.lit(0.35) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("priority"))) + F.lit(0.25) * F.coalesce(F.try_divide(z("target_area"), z("_ma")), F.lit(0.0)) + F.lit(0.2) * z("_d") / one("_md") + F.lit(0.2) * z("_g") / one("_mg"))
    j = j.withColumn("score", js_round(s, 9))
    return j.select(*k, "program_id", "score", F.row_number().over(W.partitionBy(*k).orderBy(F.desc("score"), F.asc("program_id"))).alias("rank"))


def crossing_scores(programs: DataFrame) -> DataFrame:
    """Policy and score of walking, cycling and service crossings per program (three modes fanned out in the row).

    ``programs``: package_id, program_id, name, category; optional clear_m (the smaller side of its rectangle).
    """
    v = F.lower(F.concat_ws(" ", "program_id", "name", "category"))
    has = lambda *ws: any_of([F.contains(F.col("_v"), F.lit(w)) for w in ws])
    rule = lambda p, s: F.struct(F.lit(p).alias("policy"), F.lit(s).alias("base"))
    play = ("playground", "toddler", "children play", "inclusive play")
    service = F.when(has("operation", "maintenance", "service yard"), rule("destination_only", 0.8)).otherwise(rule("forbidden", 0.0))
    walking = (F.when(has("operation", "maintenance"), rule("forbidden", 0.0)).when(has(*play), rule("allowed", 0.55)).when(has("plaza", "lawn", "flexible", "event"), rule("preferred", 0.9)).otherwise(rule("allowed", 0.65)))
    cycling = (F.when(has("operation", "maintenance", "court", *play, "sensory", "quiet garden", "drop-off", "drop off"), rule("forbidden", 0.0)).when(has("main entrance", "gateway", "community plaza"), rule("controlled_only", 0.85))
               .when(has("lawn", "flexible recreation"), rule("controlled_only", 0.7)).otherwise(rule("controlled_only", 0.35)))
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(w).alias("width"), r.alias("r")) for m, w, r in (("walking", 1.5, walking), ("cycling", 2.5, cycling), ("service", 3.0, service))])
    d = programs.withColumn("_v", v)
    d = d if "clear_m" in d.columns else d.withColumn("clear_m", F.lit(None).cast("double"))
    d = d.select("package_id", "program_id", "clear_m", F.inline(modes))
    clear = F.coalesce(F.col("clear_m"), F.col("width") * 2.0)
    geo = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (clear - F.col("width")) / F.greatest(F.col("width") * 3.0, F.lit(1.0))))
    ok = (F.col("r.policy") != "forbidden") & (clear + 1e-6 >= F.col("width"))
    return d.select("package_id", "program_id", "mode", F.col("r.policy").alias("policy"), ok.alias("allowed"), F.when(ok, F.bround((F.col("r.base") * 0.65 + geo * 0.35) * 100.0, 2)).otherwise(0.0).alias("score"))


def package_profile(programs: DataFrame) -> DataFrame:
    """Counts by class and mode with area sums."""
    return programs.groupBy("package_id", "program_class", spatial_mode().alias("spatial_mode")).agg(F.count(F.lit(1)).alias("programs"), F.bround(F.sum("min_area"), 2).alias("min_area"), F.bround(F.sum("target_area"), 2).alias("target_area"),
                                                                                                     F.bround(F.sum("max_area"), 2).alias("max_area"))


def destination_scores(summary: DataFrame, weight: float, group_cols) -> DataFrame:
    """Age group x area program: matching user words x 25, category rank 25 or 12, and a part of the opportunity."""
    users = F.lower(F.array_join("users", " "))
    rows = []
    for key, (cats, tokens) in on.AFFINITY.items():
        n = sum([F.when(F.contains(F.col("_u"), F.lit(t)), 1).otherwise(0) for t in tokens], F.lit(0))
        rank = F.when(F.col("category") == cats[0], 25.0).when(F.col("category") == cats[1], 12.0).otherwise(0.0)
        rows.append(F.struct(F.lit(key).alias("age_group"), F.lit(on.AGE_TIERS[key]).alias("tier"), (n * 25.0 + rank + F.col("opportunity") * F.lit(weight)).alias("relevance"), ((n > 0) | F.col("category").isin(cats)).alias("relevant")))
    a = summary.filter((F.col("geometry_type") == "area") & F.col("target_area").isNotNull()).withColumn("_u", users)
    return a.select(*group_cols, "program", "program_order", "name", "category", "opportunity", "target_area", F.inline(F.array(*rows)))


def journeys(summary: DataFrame, group_cols=("park_id",), n: int = 8) -> DataFrame:
    """Journey steps per age group: entry -> destination -> amenity along the program graph, with roles.

    The path search runs on the catalogue's adjacency between the start and end pairs that
    occur; areas then join their paths.
    """
    keys = list(group_cols)
    first = lambda cat, out: summary.filter(F.col("category") == cat).groupBy(*keys).agg(F.max_by("program", F.struct("opportunity", -F.col("program_order"))).alias(out))
    d = destination_scores(summary, 0.3, keys).filter("relevant")
    w = W.partitionBy(*keys, "age_group").orderBy(F.desc("relevance"), F.asc("program_order"))
    d = d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    d = d.join(first("Arrival / Access", "entry"), keys, "left").join(first("Comfort / Amenities", "amenity"), keys, "left")
    adj = fixed_table(summary.sparkSession, [(p["type"], t, i * 100 + k) for i, p in enumerate(pg.PROGRAMS) for k, t in enumerate(p["preferred"] + p["movement"] + p["service"])], "source string, target string, seq int")
    pairs = d.select(F.inline(F.array(F.struct(F.col("entry").alias("start"), F.col("program").alias("end")), F.struct(F.col("program").alias("start"), F.col("amenity").alias("end"))))).filter(F.col("start").isNotNull() & F.col("end").isNotNull()).distinct()
    paths = bfs_paths(adj, pairs)
    to = paths.select(F.col("start").alias("entry"), F.col("end").alias("program"), F.when(F.col("start") == F.col("end"), F.array("start")).otherwise(capped_path(F.col("path"), 3)).alias("_in"))
    on_ = paths.select(F.col("start").alias("program"), F.col("end").alias("amenity"), capped_path(F.col("path"), 2).alias("_out"))
    d = d.join(to, ["entry", "program"], "left").join(on_, ["program", "amenity"], "left")
    tail = F.when(F.col("amenity").isNotNull() & (F.col("amenity") != F.col("program")), F.slice("_out", 2, F.size("_out"))).otherwise(F.array().cast("array<string>"))
    full = F.concat(F.coalesce("_in", F.array("program")), F.coalesce(tail, F.array().cast("array<string>")))
    s = d.select(*keys, "age_group", "tier", F.col("program").alias("destination"), "rank", "entry", "amenity", F.posexplode(full).alias("position", "space"))
    role = F.when(F.col("space") == F.col("entry"), "entry").when(F.col("space") == F.col("destination"), "primary_activity").when(F.col("space") == F.col("amenity"), "amenity").otherwise("circulation")
    return s.select(*keys, F.concat_ws("_", F.lit("journey"), "age_group", "destination").alias("journey_id"), "age_group", "tier", "destination", "rank", "position", "space", role.alias("role"))


def experience_matrix(summary: DataFrame, group_cols=("park_id",)) -> DataFrame:
    """Best space per age group with material, zone, usage window and cost rate."""
    keys = list(group_cols)
    d = destination_scores(summary, 0.4, keys)
    b = d.groupBy(*keys, "age_group", "tier").agg(F.max_by(F.struct("program", "name", "category", "target_area"), F.struct("relevance", -F.col("program_order"))).alias("_b"))
    b = b.select(*keys, "age_group", "tier", "_b.*")
    n, t = F.lower("name"), F.col("tier")
    has = lambda *ws: any_of([F.contains(n, F.lit(x)) for x in ws])
    mat = (F.when(has("play", "sensory"), "EPDM_RUBBER").when(has("plaza", "court", "fitness", "loop", "jog", "event"), "HIGH_ALBEDO_PAVING").when(has("garden", "planting", "nature", "habitat", "bioswale"), "NATURAL_GRAVEL").otherwise("TURF"))
    zone = F.when(t.isin("Kids", "Old"), "GATEWAY_NODE").when(F.col("category").isin("Arrival / Access", "Movement"), "PERIMETER_LOOP").when(t == "Teens", "ACTIVE_EDGE").otherwise("INNER_BUFFER")
    return b.withColumns({"material": mat, "zone": zone, "window": F.when(t == "Old", "MORNING").when(t == "Kids", "MIDDAY").otherwise("EVENING")}).withColumn("cost_rate", _rate(F.col("material")))


def finalise_synthesis(matrix: DataFrame, area_cap: float, budget_cap: float, active_shade: int = 8, passive_shade: int = 6, biodiversity: int = 4, group_cols=("park_id",)) -> dict[str, DataFrame]:
    """Scale areas to the cap (a shared space counts once), overlap and composite scores, shared spaces, cost and budget."""
    keys = list(group_cols)
    sp = matrix.groupBy(*keys, "program").agg(F.count(F.lit(1)).alias("n"), F.first("target_area").alias("area"), F.first("cost_rate").alias("rate"), F.sort_array(F.collect_set("age_group")).alias("archetypes"))
    tot = sp.groupBy(*keys).agg(F.sum("area").alias("_sum"))
    scale = F.when((F.col("_sum") > area_cap) & (F.col("_sum") > 0), F.lit(area_cap) / F.col("_sum")).otherwise(F.lit(1.0))
    sp = sp.join(tot, keys).withColumn("_f", scale)
    sp = sp.withColumn("area", F.when(F.col("_f") != 1, F.greatest(F.lit(1.0), js_round(F.col("area") * F.col("_f")))).otherwise(F.col("area")))
    sp = sp.withColumn("overlap_score", F.when(F.col("n") == 1, F.lit(3)).otherwise(F.least(F.lit(10), F.lit(3) + F.col("n") * 2)).cast("double"))
    comp = js_round((F.lit(float(active_shade + passive_shade + biodiversity)) + F.col("overlap_score")) / 4.0)
    sp = sp.withColumns({"composite": comp, "band": F.when(comp >= 8, "High").when(comp >= 5, "Medium").otherwise("Low")}).drop("_sum", "_f")
    rows = matrix.drop("target_area").join(sp.select(*keys, "program", F.col("area").alias("target_area"), "overlap_score", "composite", "band"), [*keys, "program"])
    meta = sp.groupBy(*keys).agg(js_round(F.sum("area")).alias("total_area"), js_round(F.sum(F.col("area") * F.col("rate"))).alias("total_cost"))
    meta = meta.withColumn("budget_status", F.when(F.col("total_cost") <= budget_cap, "WITHIN_BUDGET").otherwise("EXCEEDS_BUDGET"))
    return {"matrix": rows, "shared": sp.filter(F.col("n") >= 2), "metadata": meta}
