"""Registered weather, plant, terrain, catalogue and export queries with their DuckDB statements."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions.numeric import js_round
from ..functions.session import ensure_checkpoint_dir, written_table
from ..operators import catalog as ct
from ..operators import climate as cm
from ..operators import terrain as tr
from ..sources import adapters as ad
from ..sources import writers as wr
from ..streaming import status as stt
from .registry import query
from .review_queries import enriched
from .site_queries import SCORED, scored
from .sqlbase import CELLS, js, q, with_enriched

HOURLY = "hourly AS (SELECT event_type AS station, event_id AS seq, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day, CAST(hour(ts) AS INTEGER) AS hour, value % 50 AS dry_bulb_c, CAST((event_id*29) % 100 AS DOUBLE) AS rh_pct, CAST((event_id*31) % 900 AS DOUBLE) AS ghi_wh_m2, CAST((event_id*17) % 360 AS DOUBLE) AS wind_dir_deg, (event_id % 80) / 10e0 AS wind_ms FROM events)"


@query("monthly_climate", f"WITH {HOURLY} SELECT station, month, round_even(avg(dry_bulb_c), 1) AS mean_c, max(dry_bulb_c) AS max_c, round_even(avg(rh_pct), 1) AS rh_mean_pct, round_even(avg(wind_ms), 2) AS wind_mean_ms, round_even(sum(ghi_wh_m2) / 1000e0, 1) AS ghi_kwh_m2, count(*) AS hours FROM hourly GROUP BY ALL")
def _(spark, sf):
    return cm.monthly_climate(ad.hourly(spark, sf))


@query("wind_sectors", f"WITH {HOURLY} SELECT station, (['N','NE','E','SE','S','SW','W','NW'])[CAST(floor(((wind_dir_deg + 22.5e0) % 360e0) / 45e0) AS INTEGER) + 1] AS sector, count(*) AS hours FROM hourly WHERE wind_ms > 0.2e0 AND wind_dir_deg < 360 GROUP BY ALL")
def _(spark, sf):
    return cm.wind_sectors(ad.hourly(spark, sf))


@query("heat_hours", f"WITH {HOURLY} SELECT station, count(*) AS hours, count(*) FILTER (WHERE dry_bulb_c >= 35) AS over_35, count(*) FILTER (WHERE dry_bulb_c >= 40) AS over_40, count(*) FILTER (WHERE dry_bulb_c >= 35 AND hour BETWEEN 17 AND 23) AS evening_over_35 FROM hourly GROUP BY ALL")
def _(spark, sf):
    return cm.heat_hours(ad.hourly(spark, sf))


@query("extreme_hours", f"WITH {HOURLY}, r AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY dry_bulb_c DESC, seq) AS a, row_number() OVER (PARTITION BY station ORDER BY dry_bulb_c + rh_pct * 0.08e0 DESC, seq) AS b FROM hourly) SELECT station, 'hottest' AS kind, month, day, hour, dry_bulb_c, rh_pct, wind_dir_deg, wind_ms FROM r WHERE a = 1 UNION ALL SELECT station, 'hot_humid', month, day, hour, dry_bulb_c, rh_pct, wind_dir_deg, wind_ms FROM r WHERE b = 1")
def _(spark, sf):
    return cm.extreme_hours(ad.hourly(spark, sf))


@query("season_extremes", f"WITH {HOURLY}, s AS (SELECT station, CASE WHEN hour < 8 THEN 'night' WHEN hour < 16 THEN 'day' ELSE 'evening' END AS season, {js('avg(CASE WHEN dry_bulb_c < 30 THEN 100e0 ELSE 0e0 END)', 4)} AS comfort_pct, min(seq) AS seq FROM hourly GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY comfort_pct, seq) AS a, row_number() OVER (PARTITION BY station ORDER BY comfort_pct DESC, seq) AS b FROM s) SELECT station, max(season) FILTER (WHERE a = 1) AS worst_season, max(season) FILTER (WHERE b = 1) AS best_season FROM r GROUP BY station")
def _(spark, sf):
    part = F.when(F.col("hour") < 8, "night").when(F.col("hour") < 16, "day").otherwise("evening")
    s = ad.hourly(spark, sf).groupBy("station", part.alias("season")).agg(js_round(F.avg(F.when(F.col("dry_bulb_c") < 30, 100.0).otherwise(0.0)), 4).alias("comfort_pct"), F.min("seq").alias("seq"))
    return cm.season_extremes(s)


def _pick(vals, m):
    return "([" + ", ".join(q(v) for v in vals) + f"])[CAST((p_partkey*{m}) % {len(vals)} AS INTEGER) + 1]"


PLANTS = f"""plants AS (SELECT p_partkey AS plant_id, p_name || ' ' || (p_partkey % 700) AS scientific_name, {_pick(ad.PLANT_VALUES['native_status'], 5)} AS native_status, {_pick(ad.PLANT_VALUES['habit'], 7)} AS habit, {_pick(ad.PLANT_VALUES['water_demand'], 3)} AS water_demand,
 {_pick(ad.PLANT_VALUES['leaf_retention'], 4)} AS leaf_retention, {_pick(ad.PLANT_VALUES['foliage_density'], 2)} AS foliage_density, CASE WHEN p_partkey % 10 <> 0 THEN ((p_partkey*3) % 120) / 10e0 END AS height_m, CASE WHEN p_partkey % 9 <> 0 THEN ((p_partkey*7) % 90) / 10e0 END AS canopy_m,
 CASE WHEN p_partkey % 4 <> 0 THEN ((p_partkey*11) % 60) / 100e0 END AS dbh_m, CAST(p_size AS DOUBLE) AS clear_trunk_m FROM part)"""
PF = ["native_status", "habit", "water_demand", "leaf_retention", "foliage_density"]
PN = ["height_m", "canopy_m", "dbh_m", "clear_trunk_m"]


@query("plant_counts", f"WITH {PLANTS} " + " UNION ALL ".join(f"SELECT {q(f)} AS field, {f} AS value, count(*) AS n FROM plants GROUP BY {f}" for f in PF))
def _(spark, sf):
    return cm.plant_counts(ad.plants(spark, sf), PF)


@query("plant_numeric", f"WITH {PLANTS} " + " UNION ALL ".join(f"SELECT {q(f)} AS field, count({f}) AS n, min({f}) AS min, round_even(avg({f}), 2) AS mean, max({f}) AS max FROM plants" for f in PN))
def _(spark, sf):
    return cm.plant_numeric(ad.plants(spark, sf), PN)


@query("plant_quality", f"WITH {PLANTS} SELECT count(*) AS rows, CAST(sum(CASE WHEN water_demand = '' THEN 1 ELSE 0 END + CASE WHEN height_m IS NULL THEN 1 ELSE 0 END + CASE WHEN canopy_m IS NULL THEN 1 ELSE 0 END + CASE WHEN dbh_m IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS blank_cells, (SELECT count(*) FROM (SELECT scientific_name FROM plants GROUP BY 1 HAVING count(*) > 1)) AS duplicate_names FROM plants")
def _(spark, sf):
    return cm.plant_quality(ad.plants(spark, sf))


@query("plant_derivations", f"""WITH {PLANTS}, x AS (SELECT *, coalesce(canopy_m, 0e0) AS c, coalesce(dbh_m, 0e0) AS d, count(*) OVER (PARTITION BY scientific_name) AS cn FROM plants)
SELECT plant_id, CASE WHEN water_demand = 'Very Low' THEN 'HZ-CREST Desert Crest' WHEN water_demand = 'Low' THEN 'HZ-SLOPE Stabilized Slope' WHEN starts_with(water_demand, 'Moderate') THEN 'HZ-HOLLOW Shaded Hollow' ELSE 'HZ-WATER Specialized Water' END AS hydrozone,
 CASE WHEN contains(lower(habit), 'tree') THEN CASE WHEN foliage_density IN ('Dense', 'Very Dense', 'Extremely Dense') THEN 'Canopy / shaded hollow' ELSE 'Crest / structure tree' END WHEN contains(lower(habit), 'grass') THEN 'Slope stabilization / movement texture' WHEN contains(lower(habit), 'groundcover') THEN 'Groundcover / erosion control' ELSE 'Shrub / habitat layer' END AS role,
 {js('greatest(c / 2e0, d * 6e0)', 1)} AS root_radius_m, {js("pi() * pow(c / 2e0, 2) * CASE foliage_density WHEN 'Extremely Dense' THEN 1e0 WHEN 'Very Dense' THEN 0.9e0 WHEN 'Dense' THEN 0.75e0 WHEN 'Medium' THEN 0.55e0 WHEN 'Open' THEN 0.35e0 ELSE 0.2e0 END * CASE leaf_retention WHEN 'Evergreen' THEN 1e0 WHEN 'Semi-Evergreen' THEN 0.75e0 WHEN 'Deciduous' THEN 0.6e0 ELSE 0.8e0 END", 1)} AS shade_index,
 CASE WHEN cn > 1 THEN 'Duplicate scientific name' ELSE '' END AS duplicate_note FROM x""")
def _(spark, sf):
    return cm.plant_derivations(ad.plants(spark, sf)).select("plant_id", "hydrozone", "role", "root_radius_m", "shade_index", "duplicate_note")


SURF = "surf AS (SELECT p_partkey // 1600 AS surface_id, p_partkey % 40 AS ix, (p_partkey % 1600) // 40 AS iy, CAST(p_size AS DOUBLE) AS ze, CAST((p_partkey*3) % 50 AS DOUBLE) AS zp FROM part)"


@query("cut_fill", f"WITH {SURF}, d AS (SELECT surface_id, zp - ze AS d FROM surf), g AS (SELECT surface_id, count(*) AS samples, coalesce(sum(-d) FILTER (WHERE d < 0), 0e0) * 4e0 AS cut, coalesce(sum(d) FILTER (WHERE d > 0), 0e0) * 4e0 AS fill, count(*) FILTER (WHERE abs(d) > 0.001e0) * 4e0 AS disturbed_area, coalesce(max(-d) FILTER (WHERE d < 0), 0e0) AS max_cut, coalesce(max(d) FILTER (WHERE d > 0), 0e0) AS max_fill FROM d GROUP BY surface_id) SELECT *, fill - cut AS net, CASE WHEN cut + fill <= 1e-9 THEN 0e0 ELSE abs(fill - cut) / (cut + fill) END AS balance FROM g")
def _(spark, sf):
    s = ad.surfaces(spark, sf)
    return tr.cut_fill(s.withColumn("z", F.col("z_existing")), s.withColumn("z", F.col("z_proposed")), 2.0)


def _mesh(spark, sf):
    s = ad.surfaces(spark, sf)
    v = s.select("surface_id", (F.col("iy") * 40 + F.col("ix")).alias("vertex_id"), (F.col("ix") * 10.0).alias("x"), F.col("z_existing").alias("y"), (F.col("iy") * 10.0).alias("z"))
    i = F.col("vertex_id")
    f = v.filter(i % 40 < 39).select("surface_id", F.inline(F.array(F.struct((i * 2).alias("face_id"), i.alias("a"), (i + 1).alias("b"), (i + 40).alias("c")), F.struct((i * 2 + 1).alias("face_id"), (i + 1).alias("a"), (i + 41).alias("b"), (i + 40).alias("c")))))
    return v, f


SLOPES = f"""{SURF}, vx AS MATERIALIZED (SELECT surface_id AS sid, iy * 40 + ix AS i, ix * 10e0 AS x, ze AS y, iy * 10e0 AS z FROM surf),
fc AS MATERIALIZED (SELECT sid, i * 2 AS face_id, i AS v1, i + 1 AS v2, i + 40 AS v3 FROM vx WHERE i % 40 < 39 UNION ALL SELECT sid, i * 2 + 1, i + 1, i + 41, i + 40 FROM vx WHERE i % 40 < 39),
f1 AS MATERIALIZED (SELECT fc.*, x AS ax, y AS ay, z AS az FROM fc JOIN vx ON vx.sid = fc.sid AND vx.i = fc.v1),
f2 AS MATERIALIZED (SELECT f1.*, x AS px, y AS py, z AS pz FROM f1 JOIN vx ON vx.sid = f1.sid AND vx.i = f1.v2),
fj AS (SELECT f2.sid AS surface_id, face_id, px - ax AS bx, py - ay AS by_, pz - az AS bz, x - ax AS cx, y - ay AS cy, z - az AS cz FROM f2 JOIN vx ON vx.sid = f2.sid AND vx.i = f2.v3),
sl0 AS (SELECT surface_id, face_id, abs(bz * cx - bx * cz) AS v, sqrt((by_ * cz - bz * cy) * (by_ * cz - bz * cy) + (bx * cy - by_ * cx) * (bx * cy - by_ * cx)) AS h FROM fj), sl AS (SELECT surface_id, face_id, h / v * 100e0 AS slope_pct FROM sl0 WHERE v > 1e-9)"""


@query("triangle_slopes", f"WITH {SLOPES} SELECT surface_id, face_id, {js('slope_pct', 6)} AS slope_pct FROM sl")
def _(spark, sf):
    return tr.triangle_slopes(*_mesh(spark, sf)).withColumn("slope_pct", js_round("slope_pct", 6))


@query("slope_percentiles", f"WITH {SLOPES}, r AS (SELECT *, row_number() OVER (PARTITION BY surface_id ORDER BY slope_pct) - 1 AS i, count(*) OVER (PARTITION BY surface_id) AS n FROM sl) " + " UNION ALL ".join(
    f"SELECT surface_id, {p} AS percentile, {js('slope_pct', 2)} AS value FROM r WHERE i = CAST(floor({p} / 100e0 * (n - 1)) AS BIGINT)" for p in (50, 90, 95, 100)))
def _(spark, sf):
    return tr.slope_percentiles(tr.triangle_slopes(*_mesh(spark, sf)))


@query("route_profile", f"""WITH {SURF}, p AS (SELECT surface_id * 100 + iy AS route_id, ix AS i, ix * 5e0 AS x, (ix % 3) * 2e0 AS y, ze AS z FROM surf), d AS (SELECT route_id, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, z - lag(z) OVER w AS dz FROM p WINDOW w AS (PARTITION BY route_id ORDER BY i)),
h AS (SELECT route_id, dz, sqrt(dx * dx + dy * dy) AS h FROM d WHERE dx IS NOT NULL)
SELECT route_id, {js('sum(h)', 6)} AS horizontal_m, {js('sum(sqrt(h * h + dz * dz))', 6)} AS terrain_m, coalesce(sum(dz) FILTER (WHERE dz > 0), 0e0) AS gain_m, coalesce(sum(-dz) FILTER (WHERE dz < 0), 0e0) AS loss_m, {js('max(abs(dz) / h * 100e0)', 6)} AS max_slope_pct, {js('sum(abs(dz) / h * 100e0 * h) / sum(h)', 6)} AS avg_slope_pct, {js('coalesce(sum(h) FILTER (WHERE abs(dz) / h * 100e0 > 120), 0e0)', 6)} AS violation_m FROM h GROUP BY route_id""")
def _(spark, sf):
    s = ad.surfaces(spark, sf).select((F.col("surface_id") * 100 + F.col("iy")).alias("route_id"), F.col("ix").alias("i"), (F.col("ix") * 5.0).alias("x"), ((F.col("ix") % 3) * 2.0).alias("y"), F.col("z_existing").alias("z"))
    r = tr.route_profile(s, 120.0)
    return r.select("route_id", "gain_m", "loss_m", *[js_round(c, 6).alias(c) for c in ("horizontal_m", "terrain_m", "max_slope_pct", "avg_slope_pct", "violation_m")])


# --- catalogue ------------------------------------------------------------------

VERS = "vers AS (SELECT o_custkey AS dataset_id, o_orderkey AS version_id, o_orderdate AS created_at, o_orderstatus AS status FROM orders)"
CUR = "cur AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY dataset_id) AS versions, row_number() OVER (PARTITION BY dataset_id ORDER BY created_at DESC, version_id DESC) AS r FROM vers) WHERE r = 1)"


@query("current_version", f"WITH {VERS}, {CUR} SELECT dataset_id, version_id, strftime(created_at, '%Y-%m-%d') AS created, status, versions FROM cur")
def _(spark, sf):
    c = ct.current_version(ad.dataset_versions(spark, sf))
    return c.select("dataset_id", "version_id", F.date_format("created_at", "yyyy-MM-dd").alias("created"), "status", "versions")


def _runs(spark, sf):
    return ad.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("run_id"), F.col("s_nationkey").alias("project_id"), F.concat(F.lit("owner"), (F.col("s_suppkey") % 7).cast("string")).alias("owner_id"),
                                                  F.array(F.col("s_suppkey"), F.col("s_suppkey") + 1, F.col("s_suppkey") * 3 % 97).alias("input_dataset_ids"))


@query("pinned_run_inputs", f"WITH {VERS}, {CUR}, r AS (SELECT s_suppkey AS run_id, s_nationkey AS project_id, unnest([0, 1, 2]) AS position, unnest([s_suppkey, s_suppkey + 1, s_suppkey*3 % 97]) AS dataset_id FROM supplier) SELECT run_id, project_id, CAST(position AS INTEGER) AS position, r.dataset_id, c_mktsegment AS segment, version_id AS pinned_version_id FROM r JOIN customer ON c_custkey = r.dataset_id LEFT JOIN cur ON cur.dataset_id = r.dataset_id")
def _(spark, sf):
    ds = ad.table(spark, sf, "customer").select(F.col("c_custkey").alias("dataset_id"), F.col("c_mktsegment").alias("segment"))
    return ct.pin_run_inputs(_runs(spark, sf), ds, ct.current_version(ad.dataset_versions(spark, sf))).select("run_id", "project_id", "position", "dataset_id", "segment", "pinned_version_id")


@query("denormalised_outputs", "SELECT p_partkey AS output_id, coalesce(CASE WHEN p_partkey % 3 = 0 THEN 999 END, s_nationkey) AS project_id, 'owner' || (s_suppkey % 7) AS owner_id FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % 120")
def _(spark, sf):
    o = ad.table(spark, sf, "part").select(F.col("p_partkey").alias("output_id"), (F.col("p_partkey") % 120).alias("run_id"), F.when(F.col("p_partkey") % 3 == 0, 999).alias("project_id"), F.lit(None).cast("string").alias("owner_id"))
    return ct.denormalise_outputs(o, _runs(spark, sf)).select("output_id", "project_id", "owner_id")


@query("ingest_datasets", f"WITH {VERS}, vn AS (SELECT dataset_id, count(*) AS v FROM vers GROUP BY dataset_id), f AS (SELECT event_id % 500 AS dataset_id, CASE WHEN event_id % 997 = 0 THEN 'Surface' ELSE 'Point' END AS geom_type, 55.17e0 + (event_id % 1000) / 10000e0 AS lng, 25.11e0 + ((event_id*37) % 900) / 10000e0 AS lat FROM events), s AS (SELECT dataset_id, count(*) AS features, CAST(count(*) FILTER (WHERE geom_type = 'Surface') AS BIGINT) AS invalid, min(lng) AS min_lng, min(lat) AS min_lat, max(lng) AS max_lng, max(lat) AS max_lat FROM f GROUP BY dataset_id) "
       "SELECT s.*, CASE WHEN invalid > 0 THEN 'failed' ELSE 'processed' END AS status, coalesce(v, 0) AS parent_version, CASE WHEN invalid = 0 THEN coalesce(v, 0) + 1 END AS version_number FROM s LEFT JOIN vn USING (dataset_id)")
def _(spark, sf):
    p = ad.points(spark, sf)
    raw = p.select((F.col("feature_id") % 500).alias("dataset_id"), F.when(F.col("feature_id") % 997 == 0, "Surface").otherwise("Point").alias("geom_type"), "lng", "lat")
    v = ad.dataset_versions(spark, sf).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("version_number"))
    return ct.ingest_dataset(raw, v)


@query("metric_rows", f"WITH {SCORED} SELECT 'run-1' AS run_id, 'cell' AS unit_type, h3_id AS unit_id, 'heat_score' AS metric, heat_score AS value, 'score' AS unit FROM sc UNION ALL SELECT 'run-1', 'cell', h3_id, 'void_pct', void_pct, 'score' FROM sc")
def _(spark, sf):
    return ct.metric_table(scored(spark, sf), "run-1", "cell", "h3_id", ["heat_score", "void_pct"])


@query("appended_metrics", f"WITH {SCORED} SELECT run_id, unit_type, unit_id, metric, value, unit FROM (SELECT unnest(['run-1', 'run-2']) AS run_id, 'cell' AS unit_type, h3_id AS unit_id, 'heat_score' AS metric, heat_score AS value, 'score' AS unit FROM sc UNION ALL SELECT 'run-2', 'park', CAST(park_id AS VARCHAR), 'cells', CAST(count(*) AS DOUBLE), 'count' FROM sc GROUP BY park_id)")
def _(spark, sf):
    # three appends to one table: earlier rows stay as they are
    ensure_checkpoint_dir(spark)
    path = os.path.join(spark.sparkContext.getCheckpointDir(), "metrics", uuid.uuid4().hex)
    cells = written_table(scored(spark, sf).select("park_id", "h3_id", "heat_score"))
    for run in ("run-1", "run-2"):
        ct.append_metrics(ct.metric_table(cells, run, "cell", "h3_id", ["heat_score"]), path)
    parks = cells.groupBy("park_id").agg(F.count(F.lit(1)).alias("cells"))
    ct.append_metrics(ct.metric_table(parks, "run-2", "park", "park_id", ["cells"], "count"), path)
    return spark.read.parquet(path).select("run_id", "unit_type", "unit_id", "metric", "value", "unit")


@query("latest_status", f"WITH {VERS}, {CUR} SELECT dataset_id, status, version_id AS change_id FROM cur")
def _(spark, sf):
    ch = ad.dataset_versions(spark, sf).select("dataset_id", F.col("created_at").alias("changed_at"), F.col("version_id").alias("change_id"), "status")
    return stt.latest_status(ch).select("dataset_id", "status", "change_id")


# --- exports --------------------------------------------------------------------

@query("nlp_ready_export", with_enriched("SELECT park_name, md5(review_text) AS review_text, rating, sentiment AS sentiment_placeholder, topic AS topic_placeholder, issue_category AS issue_category_placeholder, design_requirement AS design_requirement_placeholder FROM enriched"))
def _(spark, sf):
    return wr.nlp_ready(enriched(spark, sf)).withColumn("review_text", F.md5("review_text"))


@query("workbook_summary", with_enriched("SELECT place_id, park_name, count(*) AS reviews, avg(CAST(rating AS DOUBLE)) AS avg_rating, CAST(count(*) FILTER (WHERE sentiment = 'NEGATIVE') AS BIGINT) AS negative FROM enriched GROUP BY ALL"))
def _(spark, sf):
    return wr.workbook_tables(enriched(spark, sf))["park_summary"]


@query("flat_reviews_export", with_enriched("SELECT review_id, array_to_string(categories, '|') AS categories, sentiment FROM enriched"))
def _(spark, sf):
    return wr.flat_table(enriched(spark, sf).select("review_id", "categories", "sentiment"))


@query("geojson_lines_export", f"WITH {CELLS} SELECT '{{\"type\":\"Feature\",\"geometry\":{{\"type\":\"Point\",\"coordinates\":[' || CAST(seq AS VARCHAR) || ',' || CAST(park_id AS VARCHAR) || ']}},\"properties\":{{\"h3_id\":\"' || h3_id || '\"}}}}' AS value FROM cells")
def _(spark, sf):
    return wr.geojson_lines(ad.cells(spark, sf), "Point", F.array("seq", "park_id"), ["h3_id"])


_RAW = "SELECT event_id % 500 AS dataset_id, event_id AS feature_id, CASE WHEN event_id % 997 = 0 THEN 'Surface' WHEN event_id % 13 <> 0 THEN 'Point' END AS geom_type, CASE WHEN event_id % 17 <> 0 THEN 55.17e0 + (event_id % 1000) / 10000e0 END AS lng FROM events"


def _features(spark, sf):
    k = F.col("feature_id")
    return ad.points(spark, sf).select((k % 500).alias("dataset_id"), "feature_id", F.when(k % 997 == 0, "Surface").when(k % 13 != 0, "Point").alias("geom_type"), F.when(k % 17 != 0, F.col("lng")).alias("lng"), "lat")


@query("quarantined_features", f"WITH r AS ({_RAW}) SELECT dataset_id, feature_id, CASE WHEN geom_type IS NULL THEN 'geometry missing' WHEN geom_type = 'Surface' THEN 'geometry type not supported' ELSE 'no coordinates' END AS reason FROM r WHERE geom_type IS NULL OR geom_type = 'Surface' OR lng IS NULL")
def _(spark, sf):
    return ct.validate_features(_features(spark, sf))[1]


@query("valid_features", f"WITH r AS ({_RAW}) SELECT dataset_id, count(*) AS features FROM r WHERE geom_type = 'Point' AND lng IS NOT NULL GROUP BY dataset_id")
def _(spark, sf):
    return ct.validate_features(_features(spark, sf))[0].groupBy("dataset_id").agg(F.count(F.lit(1)).alias("features"))
