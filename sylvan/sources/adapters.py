"""Adapters: the driver's star-schema tables seen as reviews, cells, roads, points and so on.

Each adapter is a plain projection of one or two tables (no actions, but for a row count from the
file footers in :func:`journeys`), so column pruning and filters reach the parquet scan, and every
output grows with its input.
Study areas (``park_id``) are blocks of consecutive keys, 900 cells each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import str_array

# One praising and one complaining phrase per issue category; appended to
# the synthetic texts so that every category, several personas and times occur.
PHRASES = [
    "The shade canopy kept us cool on a summer morning.", "Too hot and no shade at noon for the elderly.",
    "The restroom was spotless and the toilet is new.", "The toilet was dirty and the bathroom had a bad smell.",
    "Very clean paths and no litter on the weekend.", "Trash and garbage everywhere after the weekend.",
    "Easy parking for my car near the gate.", "No parking space and the drive was poor.",
    "The guard made us feel safe with the kids.", "Dark corners feel dangerous at night.",
    "My toddler loved playing on the slide and swing.", "The playground is broken and my kid was disappointed.",
    "Wheelchair ramp and wide walkway, great for the stroller.", "The slope is bad for disabled visitors.",
    "Bright lamp posts make the evening pleasant.", "Not a single lamp works at night.",
    "Quiet and peaceful in the early morning.", "So crowded and busy on Friday and Saturday.",
    "Good maintenance and care by the staff.", "Rusty and broken equipment, nobody will fix it.",
    "Nice bench and table for a picnic with friends.", "Nowhere to sit, not one chair or bench.",
    "I jog on the running track every week, excellent gym.", "The tennis court is closed and the football field is poor.",
    "My dog enjoyed the walk, a perfect pet park.", "Stray cat and dog bark all day, uncomfortable.",
    "Great coffee at the cafe and a good snack kiosk.", "Expensive food and a bad restaurant.",
    "The fountain and the lake are beautiful at sunset.", "The pond water is dirty and the pool smells.",
    "Green grass, tall trees and flowers, birds and butterflies.", "The plants are dead and the lawn is dry.",
    "No mosquito at all, wonderful evening.", "Mosquitoes and insects spoil the visit.",
    "Clear signage for a tourist visiting for the first time here.", "Confusing layout, no map, we lost my way.",
    "Calm place, the youth and teens skate elsewhere.", "Too loud, blasting music and traffic noise.",
    "Opening hours are published and long, a festival event was amazing.", "It closed early and was not open on our holiday.",
]

LNG0, LAT0 = 55.17, 25.11          # south-west corner of a study area
CENTER = (55.2201, 25.1552)        # park centre
CELLS_PER_PARK = 900               # a 30 x 30 lattice
POINTS_PER_PARK = 6000
STEPS_PER_TASK = 1_250_000         # journey steps that one task joins, sorts and reduces
EDGES_PER_NETWORK = 4000           # order keys per road network
POI_FIELDS = [  # fixed values: cell count field and the multiplier that derives it
    ("school_count", 2), ("hospital_count", 4), ("clinic_count", 5), ("mosque_count", 7), ("restaurant_count", 8),
    ("cafe_count", 10), ("playground_count", 11), ("sports_count", 13), ("bus_stop_count", 14), ("parking_count", 16),
    ("toilet_count", 17), ("drinking_water_count", 19), ("shop_count", 20),
]
HIGHWAYS = ["primary", "secondary", "residential", "service", "footway", "track", "tertiary"]  # by line number - 1
LAYERS = {"view": "bus_stops", "signup": "schools", "error": "clinics", "click": "cafes", "purchase": "playgrounds"}
LEVELS = "abcdefgh"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows out to as many partitions as the session setting ``spark.sylvan.inputPartitions`` names.

    Unset by default: large inputs split by row group on their own.  It is for a table kept as one
    row group, which no scan can split.
    """
    n = df.sparkSession.conf.get("spark.sylvan.inputPartitions", None)
    return df.repartition(int(n)) if n else df


def idiv(x, n):
    """Integer quotient of non-negative integers."""
    return F.floor(x / F.lit(n)).cast("long")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text", "lang"))
    i = F.col("doc_id")
    phrase = F.get(F.expr(str_array(PHRASES)), ((i * 3) % 40).cast("int"))
    ts = F.timestamp_add("HOUR", (i * 5) % 24, F.timestamp_add("DAY", (i * 13) % 1400, F.lit("2023-01-01").cast("timestamp")))
    return d.select(
        i.alias("review_id"),
        F.col("source").alias("place_id"),
        F.concat(F.lit("Place "), F.col("source")).alias("park_name"),
        F.concat(F.lit("a"), (i % 97).cast("string")).alias("author_name"),
        (F.lit(1) + (i * 7 + idiv(i, 40)) % 5).cast("int").alias("rating"),
        F.concat(F.col("text"), F.lit(" "), phrase).alias("review_text"),
        F.when(i % 11 != 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("published_at"),
        F.col("lang").alias("language"),
        F.lit("documents").alias("source"),
    )


def chat_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternative review source: user turns of conversations."""
    d = spread(table(spark, sf_dir, "conversations").filter(F.col("role") == "user"))
    return d.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("review_id"),
        F.concat(F.lit("c"), (F.col("conv_id") % 7).cast("string")).alias("place_id"),
        F.concat(F.lit("Place c"), (F.col("conv_id") % 7).cast("string")).alias("park_name"),
        F.concat(F.lit("u"), F.col("conv_id").cast("string")).alias("author_name"),
        (F.lit(1) + (F.col("conv_id") * 3 + F.col("turn")) % 5).cast("int").alias("rating"),
        F.col("text").alias("review_text"),
        F.lit("conversations").alias("source"),
    )


def external_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "labels")
    return d.select(
        F.col("doc_id").alias("review_id"),
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit("POSITIVE"))
        .when(F.col("toxic") == 1, F.lit("NEGATIVE")).alias("sentiment"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("seating")).when(F.col("doc_id") % 3 == 1, F.lit("safety")).alias("issue_category"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square cells of 30 x 30 lattices, one per customer."""
    k = F.col("c_custkey")
    d = table(spark, sf_dir, "customer").select("c_custkey")
    slot = k % CELLS_PER_PARK
    area = (F.lit(100000) + (k * 17) % 10000).cast("double")
    d = d.select(
        idiv(k, CELLS_PER_PARK).alias("park_id"),
        k.alias("seq"),
        F.concat(F.lit("cell"), F.lpad(k.cast("string"), 9, "0")).alias("h3_id"),
        (F.lit(LNG0) + (slot % 30) / F.lit(300.0)).alias("min_lng"),
        (F.lit(LAT0) + idiv(slot, 30) / F.lit(1000.0) * F.lit(3.0)).alias("min_lat"),
        (F.lit(LNG0) + (slot % 30 + 1) / F.lit(300.0)).alias("max_lng"),
        (F.lit(LAT0) + (idiv(slot, 30) + 1) / F.lit(1000.0) * F.lit(3.0)).alias("max_lat"),
        ((k * 31) % 4000).cast("double").alias("population"),
        area.alias("hex_area_m2"),
        (area / F.lit(1000000.0)).alias("hex_area_km2"),
        ((k * 11) % 80).cast("double").alias("building_coverage_pct"),
        ((k * 7) % 40).cast("double").alias("green_coverage_pct"),
        ((k * 13) % 300).cast("double").alias("building_count"),
        F.when(k % 5 == 0, area * ((k * 23) % 60) / F.lit(100.0)).otherwise(F.lit(0.0)).alias("park_area_m2"),
        ((k * 29) % 6000).cast("double").alias("road_length_m"),
        ((k * 37) % 9000).cast("double").alias("real_road_length_m"),
        *[((k * m + idiv(k, 7)) % 3).cast("double").alias(f) for f, m in POI_FIELDS],
        ((k * 53) % 12).cast("double").alias("intersection_count_hex"),
        ((k * 59) % 8).cast("double").alias("barrier_score_hex"),
        F.when(k % 7 != 0, ((k * 41) % 600) / F.lit(10.0)).alias("walking_time_to_park_minutes"),
        F.when(k % 7 != 0, ((k * 41) % 600) * F.lit(8.0)).alias("network_distance_to_park_m"),
        F.when((k % 7 != 0) & (k % 13 != 0), F.lit(0.5) + ((k * 43) % 50) / F.lit(100.0)).alias("route_directness_ratio"),
        F.when(k % 9 != 0, ((k * 47) % 1200).cast("double")).alias("nearest_bus_stop_distance_m"),
    )
    poi = [f for f, _ in POI_FIELDS]
    total = F.col(poi[0])
    for f in poi[1:]:
        total = total + F.col(f)
    km2 = F.col("hex_area_km2")
    return d.withColumns({
        "amenity_total": total,
        "building_area_m2": F.col("building_coverage_pct") / F.lit(100.0) * F.col("hex_area_m2"),
        "pop_density_km2": F.col("population") / km2,
        "road_density_m_per_km2": F.col("road_length_m") / km2,
        "real_road_density_m_per_km2": F.col("real_road_length_m") / km2,
        "center_lng": F.lit(CENTER[0]), "center_lat": F.lit(CENTER[1]),
        "lng": (F.col("min_lng") + F.col("max_lng")) / F.lit(2.0),
        "lat": (F.col("min_lat") + F.col("max_lat")) / F.lit(2.0),
    })


def site_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells rescaled to small squares inside a park, as the program scores expect them."""
    area = (F.lit(50) + (F.col("seq") * 17) % 51).cast("double")
    d = cells(spark, sf_dir).withColumns({"hex_area_m2": area, "hex_area_km2": area / F.lit(1000000.0), "park_area_m2": area})
    return d.withColumn("building_area_m2", F.col("building_coverage_pct") / F.lit(100.0) * F.col("hex_area_m2"))


def cell_ring():
    """Closed ring of a cell as array<struct<lng,lat>>."""
    pts = [("min_lng", "min_lat"), ("max_lng", "min_lat"), ("max_lng", "max_lat"), ("min_lng", "max_lat"), ("min_lng", "min_lat")]
    return F.array(*[F.struct(F.col(a).alias("lng"), F.col(b).alias("lat")) for a, b in pts])


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facility points, one per event."""
    e = F.col("event_id")
    layer = F.create_map(*[F.lit(x) for kv in LAYERS.items() for x in kv])
    return table(spark, sf_dir, "events").select(
        idiv(e, POINTS_PER_PARK).alias("park_id"),
        e.alias("feature_id"),
        F.element_at(layer, F.col("event_type")).alias("layer"),
        (F.lit(LNG0) + (e % 1000) / F.lit(10000.0)).alias("lng"),
        (F.lit(LAT0) + ((e * 37) % 900) / F.lit(10000.0)).alias("lat"),
        F.col("props"),
    )


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Road segments between numbered nodes; nodes sit on a 25-wide lattice of the study area."""
    li = table(spark, sf_dir, "lineitem")
    u, v = F.col("l_partkey") % 500, (F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 500
    hw = F.get(F.array(*[F.lit(h) for h in HIGHWAYS]), F.col("l_linenumber") - 1)
    d = li.select(
        idiv(F.col("l_orderkey"), EDGES_PER_NETWORK).alias("park_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("segment_id"),
        u.alias("u"), v.alias("v"), F.col("l_quantity").alias("length"), hw.alias("highway"),
    )
    return d.filter(F.col("u") != F.col("v"))


def node_lng(n):
    return F.lit(LNG0) + (c_(n) % 25) / F.lit(250.0)


def node_lat(n):
    return F.lit(LAT0) + idiv(c_(n), 25) / F.lit(250.0)


def c_(x):
    return F.col(x) if isinstance(x, str) else x


def road_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Road segments with their end points."""
    return roads(spark, sf_dir).withColumns({
        "u_lng": node_lng("u"), "u_lat": node_lat("u"), "v_lng": node_lng("v"), "v_lat": node_lat("v"),
    })


def journeys(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Visits in order: one row per journey step.

    ``dealt``: all steps of a journey in one partition, about ``STEPS_PER_TASK`` to a partition, for
    use by journey.  A number of partitions that is named is kept; adaptive execution merges others
    to 64 MB of compressed numbers, millions of steps for each sort and hash map of a task.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey")
    if dealt:
        li = li.repartition(max(spark.sparkContext.defaultParallelism, -(-li.count() // STEPS_PER_TASK)), "l_orderkey")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        idiv(F.col("o_custkey"), CELLS_PER_PARK).alias("package_id"),
        F.col("o_orderkey").alias("journey_id"),
        F.col("o_orderpriority").alias("persona_id"),
        (F.lit(1) + F.col("o_orderkey") % 4).cast("double").alias("weight"),
        (F.col("l_linenumber") * 100 + F.col("l_suppkey")).alias("position"),
        F.col("l_partkey").alias("part_id"),
        (F.col("l_partkey") % 44).alias("space"),
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("station"), e.alias("seq"),
        F.month("ts").alias("month"), F.dayofmonth("ts").alias("day"), F.hour("ts").alias("hour"),
        (F.col("value") % 50).alias("dry_bulb_c"),
        ((e * 29) % 100).cast("double").alias("rh_pct"),
        ((e * 31) % 900).cast("double").alias("ghi_wh_m2"),
        ((e * 17) % 360).cast("double").alias("wind_dir_deg"),
        ((e % 80) / F.lit(10.0)).alias("wind_ms"),
    )


def surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        idiv(p, 1600).alias("surface_id"), (p % 40).alias("ix"), idiv(p % 1600, 40).alias("iy"),
        F.col("p_size").cast("double").alias("z_existing"), ((p * 3) % 50).cast("double").alias("z_proposed"),
    )


PLANT_VALUES = {
    "native_status": ["Native", "Adapted", "Foreign"], "habit": ["Large Tree", "Palm Tree", "Shrub", "Groundcover", "Ornamental Grass"],
    "water_demand": ["Very Low", "Low", "Moderate", "High", ""], "leaf_retention": ["Evergreen", "Deciduous", "Semi-Evergreen"], "foliage_density": ["Dense", "Medium", "Open"],
}


def plants(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    pick = lambda name, m: F.get(F.expr(str_array(PLANT_VALUES[name])), ((p * m) % len(PLANT_VALUES[name])).cast("int")).alias(name)
    return table(spark, sf_dir, "part").select(
        p.alias("plant_id"),
        F.concat(F.col("p_name"), F.lit(" "), (p % 700).cast("string")).alias("scientific_name"),
        pick("native_status", 5), pick("habit", 7), pick("water_demand", 3), pick("leaf_retention", 4), pick("foliage_density", 2),
        F.when(p % 10 != 0, ((p * 3) % 120) / F.lit(10.0)).cast("string").alias("height_m"),
        F.when(p % 9 != 0, ((p * 7) % 90) / F.lit(10.0)).cast("string").alias("canopy_m"),
        F.when(p % 4 != 0, ((p * 11) % 60) / F.lit(100.0)).cast("string").alias("dbh_m"),
        F.col("p_size").cast("string").alias("clear_trunk_m"),
    )


def dataset_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("dataset_id"), F.col("o_orderkey").alias("version_id"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"),
    )


def cell_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select("park_id", "h3_id", "seq", cell_ring().alias("ring"), "min_lng", "min_lat", "max_lng", "max_lat", "lng", "lat",
                                       "hex_area_km2", "pop_density_km2", "center_lng", "center_lat")


def coords_of(u="u", v="v"):
    return F.array(F.struct(node_lng(u).alias("lng"), node_lat(u).alias("lat")), F.struct(node_lng(v).alias("lng"), node_lat(v).alias("lat")))


def road_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Road segments with a two-vertex line from node u to node v."""
    return roads(spark, sf_dir).withColumn("coords", coords_of())


M_PER_DEG = 111194.9               # planar metres per degree used by the planar examples


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short straight ways in planar metres, one per event."""
    e = F.col("event_id")
    p = points(spark, sf_dir)
    x, y = (F.col("lng") - LNG0) * M_PER_DEG, (F.col("lat") - LAT0) * M_PER_DEG
    hw = F.when(F.col("feature_id") % 6 == 0, "footway").otherwise("residential")
    return p.select("park_id", F.col("feature_id").alias("segment_id"), hw.alias("highway"), x.alias("ax"), y.alias("ay"),
                    (x + ((F.col("feature_id") % 13 - 6) * 10)).alias("bx"), (y + ((F.col("feature_id") % 7 - 3) * 10)).alias("by"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as planar boxes: a 100 m square inside every cell."""
    x, y = (F.col("min_lng") - LNG0) * M_PER_DEG, (F.col("min_lat") - LAT0) * M_PER_DEG
    return cells(spark, sf_dir).select("park_id", "h3_id", x.alias("x0"), y.alias("y0"), (x + 100.0).alias("x1"), (y + 100.0).alias("y1"))


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangular buildings in planar metres, one per part."""
    p = F.col("p_partkey")
    x, y = ((p * 373) % 11000).cast("double"), ((p * 197) % 9900).cast("double")
    w, h = (F.lit(10) + F.col("p_size")).cast("double"), (F.lit(10) + (p * 7) % 60).cast("double")
    pt = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return table(spark, sf_dir, "part").select(
        idiv(p, 1200).alias("park_id"), p.alias("building_id"), F.array(pt(x, y), pt(x + w, y), pt(x + w, y + h), pt(x, y + h)).alias("poly"),
        x.alias("bx0"), y.alias("by0"), (x + w).alias("bx1"), (y + h).alias("by1"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping rectangular regions with a circulation behaviour, one per supplier."""
    s = F.col("s_suppkey")
    x0, y0 = F.lit(LNG0) + (s * 37 % 80) / F.lit(1000.0), F.lit(LAT0) + (s * 53 % 70) / F.lit(1000.0)
    x1, y1 = x0 + (s % 9 + 4) / F.lit(1000.0), y0 + (s % 7 + 4) / F.lit(1000.0)
    b = F.get(F.array(*[F.lit(v) for v in ("HardBarrier", "DestinationOnly", "PermeableLandscape", "PreferredCorridor")]), (s % 4).cast("int"))
    d = table(spark, sf_dir, "supplier").select(idiv(s, 60).alias("park_id"), F.concat(F.lit("r"), s.cast("string")).alias("region_id"), b.alias("behavior"), (s % 5).cast("double").alias("priority"),
                                                x0.alias("min_lng"), y0.alias("min_lat"), x1.alias("max_lng"), y1.alias("max_lat"))
    return d.withColumn("ring", cell_ring())


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small rectangular park polygons, one per supplier."""
    s = F.col("s_suppkey")
    x0, y0 = F.lit(LNG0) + (s * 37 % 90) / F.lit(1000.0), F.lit(LAT0) + (s * 53 % 80) / F.lit(1000.0)
    d = table(spark, sf_dir, "supplier").select(idiv(s, 60).alias("park_id"), s.alias("site_id"), x0.alias("min_lng"), y0.alias("min_lat"), (x0 + (s % 5 + 5) / F.lit(10000.0)).alias("max_lng"), (y0 + (s % 3 + 5) / F.lit(10000.0)).alias("max_lat"))
    return d.withColumn("ring", cell_ring())
