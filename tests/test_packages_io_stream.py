"""Package checks, readers, writers, catalogue and the status stream."""

import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from sylvan.operators import catalog, packages, reports, terrain
from sylvan.sources import readers, writers
from sylvan.streaming import status


def test_area_reconciliation_example(spark):
    pr = spark.createDataFrame([("k", "inclusivePlayground", "area", 1600.0), ("k", "operationsArea", "area", 300.0), ("k", "dropOffZone", "area", 200.0), ("k", "multipurposeLawn", "area", 2000.0), ("k", "treePlanting", "area", None)],
                               "package_id string, program_type string, geometry_type string, target_area double")
    st = spark.createDataFrame([("k", 15000.0, 14736.99, 15.0, 300.0, 200.0, 2500.0, 40.0, None)], "package_id string, brief_area double, measured_area double, leasable_pct double, operations_area double, dropoff_area double, circulation_area double, tree_pct double, native_pct double")
    r = packages.area_reconciliation(pr, st).first()
    assert (r.status, r.exclusive_area, r.committed_area, r.remaining_area, r.shared_area, r.tree_area, r.leasable_cap) == ("complete", 1600.0, 4600.0, 10136.99, 2000.0, 5894.8, 2250.0)


def test_estimate_keeps_unknown_inputs_open(spark):
    pr = spark.createDataFrame([("k", "inclusivePlayground", "Inclusive Playground", "SPACE", "area", 1600.0), ("k", "communityPlaza", "Community Plaza", "SPACE", "area", None)], "package_id string, program_type string, name string, program_class string, geometry_type string, target_area double")
    rec = spark.createDataFrame([("k", 5894.8, None)], "package_id string, tree_area double, native_area double")
    rel = spark.createDataFrame([("k", 0.5), ("k", None)], "package_id string, weight double")
    st = spark.createDataFrame([("k", 500.0, None, 3.0, 2.0, 3.0, 100.0, 4.0, 25.0, 100.0, None, 10.0, None, 5e6)], "package_id string, perimeter_m double, walking_length double, walking_width double, jogging_width double, cycling_width double, service_length double, service_width double,"
                               "canopy_per_tree double, tree_unit_cost double, planting_cost double, contingency_pct double, budget_target double, budget_cap double")
    r = packages.design_estimate(pr, rec, rel, st).first()
    assert (r.spaces_cost, r.paths_cost, r.tree_count, r.tree_cost, r.planting_cost_total) == (1600 * 950.0, (2000 + 1500 + 400) * 650.0, 236.0, 23600.0, None)
    assert (r.spaces_score, r.paths_score, r.adjacency_score, r.plants_score) == (50.0, 75.0, 50.0, 60.0)
    assert r.estimate_status == "partial_lower_bound" and r.target_status == "known_cost_within_target_incomplete"


def package(spark, programs, rel, site=100.0):
    cols = "package_id string, program_id string, program_class string, space_class string, common_class string, priority double, min_area double, target_area double, max_area double, geometry_type string, required boolean, spatial_mode string, coverage_pct double, suitability_field string, n_constraints int, aspect_min double, aspect_max double, compactness double, minimum_width double, has_geometry boolean"
    p = spark.createDataFrame([("k", i, c, s, None, pr, a, t, m, "area", True, "exclusive", None, "f", 0, 1.0, 2.0, 0.5, 3.0, True) for i, c, s, pr, a, t, m in programs], cols)
    r = spark.createDataFrame([("k", i, s, t, ty, w, lo, hi, m) for i, s, t, ty, w, lo, hi, m in rel], "package_id string, relationship_id string, source string, target string, type string, weight double, minimum_distance double, maximum_distance double, mandatory boolean")
    h = spark.createDataFrame([("k", "1", "p", "n", "c", "m", site)], "package_id string, schema_version string, project_id string, project_name string, crs string, units string, site_area double")
    j = spark.createDataFrame([("k", "j1", 0.5, "a"), ("k", "j1", 0.5, "gone")], "package_id string, journey_id string, weight double, space string")
    d = spark.createDataFrame([("k", "a", "gone", -1.0)], "package_id string, origin string, destination string, weight double")
    return {r.code for r in packages.validate_packages(h, p, r, j, d).collect()}


def test_validator_codes(spark):
    got = package(spark, [("a", "SPACE", "COMMON", 1.2, 50.0, 40.0, 30.0), ("a", "SPACE", "UTILITY", 0.5, None, 90.0, None), ("b", "OTHER", None, 0.5, None, None, None)],
                  [("r1", "a", "gone", "preferred", 0.5, 9.0, 3.0, True), ("r2", "a", "b", "preferred", 2.0, None, None, True), ("r3", "b", "a", "avoid", 0.1, None, None, True)])
    assert {"PROGRAM_ID_DUPLICATE", "PROGRAM_CLASS_INVALID", "COMMON_CLASS_INVALID", "PROGRAM_PRIORITY_INVALID", "PROGRAM_AREA_RANGE_INVALID", "PROGRAM_TARGET_BELOW_MINIMUM", "PROGRAM_TARGET_ABOVE_MAXIMUM", "RELATIONSHIP_TARGET_MISSING", "RELATIONSHIP_DISTANCE_CONFLICT",
            "RELATIONSHIP_WEIGHT_INVALID", "RELATIONSHIP_CONSTRAINT_CONFLICT", "JOURNEY_PROGRAM_MISSING", "MOVEMENT_DEMAND_PROGRAM_MISSING", "MOVEMENT_DEMAND_WEIGHT_INVALID", "PROGRAM_AREA_EXCEEDS_SITE"} <= got


def test_valid_package_has_no_errors_of_its_own(spark):
    got = package(spark, [("a", "SPACE", "UTILITY", 0.5, 10.0, 20.0, 30.0), ("b", "PATH", None, 0.5, None, None, None)], [("r1", "a", "b", "preferred", 0.5, None, None, False)])
    assert got == {"JOURNEY_PROGRAM_MISSING", "MOVEMENT_DEMAND_PROGRAM_MISSING", "MOVEMENT_DEMAND_WEIGHT_INVALID"}


def test_accepted_rule_beats_opposing_advice(spark):
    pr = spark.createDataFrame([("k", "a", 1.0), ("k", "b", 0.5)], "package_id string, program_id string, priority double")
    rel = spark.createDataFrame([("k", "1", "b", "a", "preferred", "catalogue", False, False, False, 1.0), ("k", "2", "a", "b", "avoid", "accepted_rule", False, True, False, None), ("k", "3", "a", "zz", "near", "catalogue", False, False, False, None), ("k", "4", "a", "b", "service", "catalogue", False, False, True, 0.0)],
                                "package_id string, relationship_id string, source string, target string, type string, authority string, accepted boolean, mandatory boolean, directed boolean, confidence double")
    g = packages.compile_relationship_graph(rel, pr)
    assert [(r.type, r.weight) for r in g["edges"].orderBy("type").collect()] == [("avoid", 1.0), ("service", pytest.approx(0.65 * 1.0 * 0.75 * 0.5))]
    assert g["conflicts"].count() == 1 and g["unknown"].first().unknown_program == "zz"


def test_entity_names(spark):
    d = spark.createDataFrame([("mainEntrancePlaza",), ("Cafe / Kiosk",), ("Drop-off & arrival",)], "e string")
    assert [r[0] for r in d.select(packages.normalise_entity(F.col("e"))).collect()] == ["main entrance plaza", "cafe kiosk", "drop off and arrival"]


def test_reviews_json(spark, scratch):
    with open(os.path.join(scratch, "park1.json"), "w") as f:
        json.dump([{"text": "gut", "textTranslated": "good", "stars": 5, "name": "Ann"}, {"text": " ", "stars": 1}, {"text": "ok", "textTranslated": None, "name": ""}], f)
    pm = spark.createDataFrame([("park1.json", "p1", "Park 1")], "file_name string, place_id string, park_name string")
    got = sorted((r.review_text, r.rating, r.author_name) for r in readers.read_reviews_json(spark, scratch, pm).collect())
    assert got == [("good", 5, "Ann"), ("ok", 0, "Anonymous")]


def test_places_json(spark, scratch):
    with open(os.path.join(scratch, "a.json"), "w") as f:
        json.dump([{"place_id": "x", "name": "X", "reviews": [{"author_name": "b", "rating": 4, "text": "t", "time": 0}]}, {"place_id": "y", "name": "Y"}], f)
    got = {r.place_id: r.published_at for r in readers.read_places_json(spark, scratch).collect()}
    assert got == {"x": "1970-01-01T00:00:00Z", "y": None}


def test_geojson_roots(spark, scratch):
    feats = [{"type": "Feature", "properties": {"name": "a", "x": None}, "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}}, {"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}},
             {"type": "Feature", "properties": {}, "geometry": None}]
    for name, doc in {"fc": {"type": "FeatureCollection", "features": feats}, "f": feats[0], "bad": {"type": "Topology"}}.items():
        with open(os.path.join(scratch, name + ".geojson"), "w") as f:
            json.dump(doc, f)
    d = readers.read_geojson(spark, scratch)
    assert d.count() == 4
    p = readers.project_layer(d, {"name": "title", "x": "x"})
    got = sorted((r.geom_type, len(r.points), json.dumps(r.properties)) for r in p.collect())
    assert got == [("Point", 1, '{"title": "a"}'), ("Point", 1, '{"title": "a"}'), ("Polygon", 4, "{}")]


def blob(body, flags=0):
    return b"GP\x00" + bytes([flags]) + b"\x00" * 4 + body


def test_geometry_blobs(spark):
    pt = struct.pack("<BIdd", 1, 1, 1.23456789, 2.0)
    ptz = struct.pack(">BIddd", 0, 1001, 3.0, 4.0, 9.0)
    line = struct.pack("<BII", 1, 2, 2) + struct.pack("<dddd", 0, 0, 1, 1)
    multi = struct.pack("<BII", 1, 5, 1) + line
    d = spark.createDataFrame([(1, bytearray(blob(pt))), (2, bytearray(blob(ptz))), (3, bytearray(blob(multi))), (4, bytearray(blob(pt, 0x10))), (5, None), (6, bytearray(b"XX000000"))], "i int, geom binary")
    got = {r.i: (r.geom_type, r.coordinates) for r in readers.geometry_from_wkb(d).collect()}
    errors = {r.i for r in readers.geometry_from_wkb(d).collect() if r.geom_error}
    assert errors == {6}
    assert got == {1: ("Point", "[1.234568, 2.0]"), 2: ("Point", "[3.0, 4.0]"), 3: ("MultiLineString", "[[[0.0, 0.0], [1.0, 1.0]]]"), 4: (None, None), 5: (None, None), 6: (None, None)}


def test_geometry_variants():
    ring = struct.pack("<II", 1, 3) + struct.pack("<6d", 0, 0, 1, 0, 1, 1)
    poly = struct.pack("<BI", 1, 3) + ring
    assert readers.decode_geometry(poly) == ("Polygon", [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]]])
    assert readers.decode_geometry(struct.pack("<BII", 1, 6, 2) + poly + poly)[1] == [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]]]] * 2
    ewkb = struct.pack("<BII", 1, 0xA0000001, 4326) + struct.pack("<3d", 5, 6, 7)
    assert readers.decode_geometry(ewkb) == ("Point", [5.0, 6.0])
    both = struct.pack("<BII", 1, 7, 2) + ewkb + struct.pack("<BII", 1, 4, 0)
    assert readers.decode_geometry(both) == ("GeometryCollection", [{"type": "Point", "coordinates": [5.0, 6.0]}, {"type": "MultiPoint", "coordinates": []}])
    for bad in (b"", b"\x01", poly[:-3], struct.pack("<BI", 1, 99)):
        try:
            readers.decode_geometry(bad)
            raise AssertionError(bad)
        except (ValueError, KeyError, IndexError):
            pass


def test_weather_and_register(spark, scratch):
    row = ["1999", "7", "2", "15", "0", "x", "41.5"] + ["0"] * 28
    with open(os.path.join(scratch, "st.epw"), "w") as f:
        f.write("LOCATION,a\n" * 8 + ",".join(row) + "\n" + "short,row\n")
    r = readers.read_epw(spark, os.path.join(scratch, "st.epw")).collect()
    assert len(r) == 1 and (r[0].month, r[0].hour, r[0].dry_bulb_c) == (7, 15, 41.5)
    with open(os.path.join(scratch, "p.csv"), "w", encoding="utf-8-sig") as f:
        f.write("name,h\nPalm,3\n")
    assert readers.read_csv_register(spark, os.path.join(scratch, "p.csv")).columns == ["name", "h"]


def test_exports(spark, scratch):
    d = spark.createDataFrame([("P", 'say "hi"', 5, "POSITIVE", "t", "c", "a", ["x", "y"])], "park_name string, review_text string, rating int, sentiment string, topic string, issue_category string, design_requirement string, keywords array<string>")
    writers.write_nlp_ready(d, scratch + "/csv")
    back = spark.read.option("header", True).option("escape", '"').csv(scratch + "/csv").first()
    assert back.review_text == 'say "hi"' and back.sentiment_placeholder == "POSITIVE"
    assert writers.flat_table(d).first().keywords == "x|y"
    line = writers.geojson_lines(d, "Point", F.array(F.lit(1.0), F.lit(2.0)), ["park_name"]).first().value
    assert json.loads(line) == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}, "properties": {"park_name": "P"}}


def test_ingest_records_failures(spark):
    raw = spark.createDataFrame([(1, "Point", 1.0, 2.0), (1, "Point", 3.0, 4.0), (2, "Blob", 1.0, 1.0), (3, "Point", None, None)], "dataset_id int, geom_type string, lng double, lat double")
    v = spark.createDataFrame([(1, 4)], "dataset_id int, version_number int")
    got = {r.dataset_id: (r.status, r.version_number) for r in catalog.ingest_dataset(raw, v).collect()}
    assert got == {1: ("processed", 5), 2: ("failed", None), 3: ("failed", None)}
    ok, bad = catalog.validate_features(raw.withColumn("feature_id", F.monotonically_increasing_id()))
    assert ok.count() == 2 and bad.count() == 2


def test_status_stream_ignores_late_rows(spark, scratch):
    schema = "dataset_id int, status string, changed_at timestamp, change_id long"
    src, table, ck = scratch + "/in", scratch + "/table", scratch + "/ck"
    mk = lambda rows: spark.createDataFrame(rows, "dataset_id int, status string, t string, change_id long").select("dataset_id", "status", F.to_timestamp("t").alias("changed_at"), "change_id")
    mk([(1, "processing", "2024-01-02", 2), (2, "processed", "2024-01-01", 1)]).coalesce(1).write.parquet(src + "/a")
    for _ in range(2):
        q = status.status_stream(spark.readStream.schema(schema).parquet(src + "/*"), table, ck, {"availableNow": True})
        q.awaitTermination(120)
        assert q.exception() is None
        if not os.path.exists(src + "/b"):
            mk([(1, "validating", "2024-01-01", 0), (2, "failed", "2024-01-03", 5)]).coalesce(1).write.parquet(src + "/b")
    assert {r.dataset_id: r.status for r in status.read_status(spark, table).collect()} == {1: "processing", 2: "failed"}


def test_flat_route_and_balance(spark):
    p = spark.createDataFrame([("r", 0, 0.0, 0.0, 0.0), ("r", 1, 3.0, 4.0, 0.0), ("r", 2, 3.0, 14.0, 1.0)], "route_id string, i int, x double, y double, z double")
    r = terrain.route_profile(p, 5.0).first()
    assert (r.horizontal_m, r.gain_m, r.max_slope_pct, r.violation_m) == (15.0, 1.0, 10.0, 10.0)


def test_unmapped_metrics_stay_null(spark):
    w = spark.createDataFrame([(0, 5.0)], "park_id int, v double")
    rows = reports.metric_rows(w, ["park_id"], [("a", F.col("v"), F.lit("good"), F.lit("Low")), ("b", None, F.lit("unavailable"), F.lit("Low"))]).collect()
    assert {(r.key, r.value) for r in rows} == {("a", 5.0), ("b", None)}
