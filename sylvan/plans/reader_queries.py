"""Registered reader queries: the given tables are written in the source formats by Spark, then read back.

Files go to the shared checkpoint folder.  A file holds one array, collection or object of at most
:data:`CHUNK` rows, as the providers deliver them, so no file grows with the input; their number does.
"""

from __future__ import annotations

import os
import uuid

import pandas as pd
from pyspark.sql import functions as F

from ..functions.session import ensure_checkpoint_dir, ship_code
from ..sources import adapters as ad
from ..sources import readers as rd
from .registry import query

CHUNK = 100


def _folder(spark) -> str:
    ensure_checkpoint_dir(spark)
    return os.path.join(spark.sparkContext.getCheckpointDir(), "files", uuid.uuid4().hex)


def _one_per_file(df, value) -> str:
    """Write each row's text as a file of its own."""
    path = _folder(df.sparkSession)
    df.select(value.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def _array(*fields):
    """Texts of a chunk's rows as one JSON array, in the order of their first field."""
    rows = F.array_sort(F.collect_list(F.struct(*fields)))
    return F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r["json"]), ","), F.lit("]"))


@query("read_reviews", "SELECT 'c' || c_custkey // 100 AS place_id, 'Park ' || c_custkey // 100 AS park_name, CASE WHEN c_custkey % 7 = 0 THEN 'Anonymous' ELSE c_name END AS author_name, CAST(c_custkey % 6 AS INTEGER) AS rating, "
       "CASE WHEN c_custkey % 3 = 0 THEN 'about ' || c_mktsegment ELSE c_mktsegment END AS review_text, c_custkey || ' days ago' AS published_time, CASE WHEN c_custkey % 4 <> 0 THEN '2024-01-01' END AS published_at, 'scrape' AS source FROM customer WHERE c_custkey % 11 <> 0")
def _(spark, sf):
    k = F.col("c_custkey")
    review = F.struct(F.when(k % 11 == 0, "  ").otherwise(F.col("c_mktsegment")).alias("text"), F.when(k % 3 == 0, F.concat(F.lit("about "), "c_mktsegment")).alias("textTranslated"), F.when(k % 7 != 0, F.col("c_name")).alias("name"),
                      F.concat(k.cast("string"), F.lit(" days ago")).alias("publishAt"), F.when(k % 4 != 0, F.lit("2024-01-01")).alias("publishedAtDate"), F.when(k % 6 != 0, (k % 6).cast("int")).alias("stars"), ad.idiv(k, CHUNK).alias("chunk"))
    d = ad.table(spark, sf, "customer").select(ad.idiv(k, CHUNK).alias("chunk"), k.alias("k"), F.to_json(review).alias("json"))
    path = _one_per_file(d.groupBy("chunk").agg(_array("k", "json").alias("v")), F.col("v"))
    # which file holds which place: one row per file
    files = spark.read.option("wholetext", True).text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file_name"), F.get_json_object("value", "$[0].chunk").alias("c"))
    return rd.read_reviews_json(spark, path, files.select("file_name", F.concat(F.lit("c"), "c").alias("place_id"), F.concat(F.lit("Park "), "c").alias("park_name")))


@query("read_places", "SELECT 'n' || s_nationkey || '-' || s_suppkey // 100 AS place_id, n_name AS name, CAST(NULL AS VARCHAR) AS formatted_address, 25e0 + s_nationkey / 4e0 AS lat, 55e0 + s_nationkey / 8e0 AS lng, s_nationkey % 5 + 0.5e0 AS place_rating, "
       "CAST(count(*) OVER (PARTITION BY s_nationkey, s_suppkey // 100) AS INTEGER) AS user_ratings_total, 'park|n' || s_nationkey AS types, s_name AS author_name, CAST(s_suppkey % 5 + 1 AS INTEGER) AS rating, 'text ' || s_suppkey AS review_text, 'en' AS language, "
       "strftime(make_timestamp(CAST((1700000000 + s_suppkey * 3601) * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ') AS published_at FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(spark, sf):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    d = ad.table(spark, sf, "supplier").join(ad.table(spark, sf, "nation"), n == F.col("n_nationkey")).withColumn("chunk", ad.idiv(k, CHUNK))
    review = F.struct(F.col("s_name").alias("author_name"), (k % 5 + 1).cast("int").alias("rating"), F.concat(F.lit("text "), k.cast("string")).alias("text"), (F.lit(1700000000) + k * 3601).cast("long").alias("time"), F.lit("en").alias("language"))
    g = d.groupBy("s_nationkey", "n_name", "chunk").agg(F.collect_list(review).alias("reviews"))
    place = F.struct(F.concat(F.lit("n"), n.cast("string"), F.lit("-"), F.col("chunk").cast("string")).alias("place_id"), F.col("n_name").alias("name"), (n % 5 + F.lit(0.5)).alias("rating"), F.size("reviews").alias("user_ratings_total"),
                     F.array(F.lit("park"), F.concat(F.lit("n"), n.cast("string"))).alias("types"), F.struct(F.struct((F.lit(25.0) + n / F.lit(4.0)).alias("lat"), (F.lit(55.0) + n / F.lit(8.0)).alias("lng")).alias("location")).alias("geometry"), "reviews")
    return rd.read_places_json(spark, _one_per_file(g, F.to_json(place))).withColumn("types", F.array_join("types", "|"))


@query("read_features", "SELECT 's' || s_suppkey AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'LineString' ELSE 'Point' END AS geom_type, CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 END AS n_points, 55e0 + s_nationkey / 8e0 AS lng, 25e0 + s_suppkey / 64e0 AS lat, "
       "CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_nationkey AS VARCHAR) END AS nation FROM supplier WHERE s_suppkey % 7 <> 0")
def _(spark, sf):
    k, x, y = F.col("s_suppkey"), F.lit(55.0) + F.col("s_nationkey") / F.lit(8.0), F.lit(25.0) + F.col("s_suppkey") / F.lit(64.0)
    point, line = F.to_json(F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))), F.to_json(F.struct(F.lit("LineString").alias("type"), F.array(F.array(x, y), F.array(x + 1.0, y)).alias("coordinates")))
    geometry = F.when(k % 7 == 0, "null").when(k % 3 == 0, line).otherwise(point)
    props = F.to_json(F.struct(F.concat(F.lit("s"), k.cast("string")).alias("title"), F.when(k % 5 != 0, F.col("s_nationkey").cast("string")).alias("nat"), F.lit("dropped").alias("other")))
    feature = F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), props, F.lit("}"))
    d = ad.table(spark, sf, "supplier").select(ad.idiv(k, CHUNK).alias("chunk"), k.alias("k"), feature.alias("json"))
    g = d.groupBy("chunk").agg(_array("k", "json").alias("v"))
    layer = rd.read_geojson(spark, _one_per_file(g, F.concat(F.lit('{"type":"FeatureCollection","features":'), "v", F.lit("}"))))
    layer = rd.project_layer(layer.filter(F.col("geom_type").isNotNull()), {"title": "name", "nat": "nation"})
    p = F.col("properties")
    return layer.select(F.try_element_at(p, F.lit("name")).alias("name"), "geom_type", F.size("points").alias("n_points"), F.get("points", F.lit(0))["lng"].alias("lng"), F.get("points", F.lit(0))["lat"].alias("lat"), F.try_element_at(p, F.lit("nation")).alias("nation"))


@query("read_geometry_blobs", "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN 'LineString' ELSE 'Point' END AS geom_type, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 3 = 0 "
       "THEN '[[' || (55e0 + s_nationkey / 8e0) || ', ' || (25e0 + s_suppkey / 64e0) || '], [0.5, -1.25]]' ELSE '[' || (55e0 + s_nationkey / 8e0) || ', ' || (25e0 + s_suppkey / 64e0) || ']' END AS coordinates, s_suppkey % 5 = 0 AS bad FROM supplier")
def _(spark, sf):
    ship_code(spark)

    @F.pandas_udf("binary")
    def blob(k: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        """Little-endian points, big-endian lines, and blobs that break off."""
        import struct

        def one(k: int, x: float, y: float) -> bytes:
            if k % 5 == 0:
                return struct.pack("<BIdd", 1, 1, x, y)[:13]
            return struct.pack(">BIIdddd", 0, 2, 2, x, y, 0.5, -1.25) if k % 3 == 0 else struct.pack("<BIdd", 1, 1, x, y)

        return pd.Series([one(*r) for r in zip(k, x, y)])

    d = ad.table(spark, sf, "supplier").select("s_suppkey", blob("s_suppkey", F.lit(55.0) + F.col("s_nationkey") / F.lit(8.0), F.lit(25.0) + F.round(F.col("s_suppkey") / F.lit(64.0), 9)).alias("geom"))
    return rd.geometry_from_wkb(d).select("s_suppkey", "geom_type", "coordinates", F.col("geom_error").isNotNull().alias("bad"))


@query("read_weather", "SELECT CAST(month(l_shipdate) AS INTEGER) AS month, CAST(day(l_shipdate) AS INTEGER) AS day, CAST(l_linenumber AS INTEGER) AS hour, l_quantity AS dry_bulb_c, l_tax * 1000e0 AS rh_pct, l_extendedprice AS ghi_wh_m2, CAST(l_partkey % 360 AS DOUBLE) AS wind_dir_deg, l_suppkey / 8e0 AS wind_ms FROM lineitem")
def _(spark, sf):
    at = {1: F.month("l_shipdate"), 2: F.dayofmonth("l_shipdate"), 3: F.col("l_linenumber"), 6: F.col("l_quantity"), 8: F.col("l_tax") * 1000.0, 13: F.col("l_extendedprice"), 20: F.col("l_partkey") % 360, 21: F.col("l_suppkey") / F.lit(8.0)}
    line = F.concat_ws(",", *[at[i].cast("string") if i in at else F.lit("0") for i in range(35)])
    path = _folder(spark)
    ad.table(spark, sf, "lineitem").select(F.explode(F.when(F.col("l_linenumber") == 1, F.array(F.lit("LOCATION,somewhere"), line)).otherwise(F.array(line))).alias("value")).write.text(path)
    return rd.read_epw(spark, path).drop("station")


@query("read_register", "SELECT CAST(p_partkey AS VARCHAR) AS id, 'x, \"' || p_name || '\"' || chr(10) || 'second line' AS note, p_type AS kind FROM part")
def _(spark, sf):
    path = _folder(spark)
    note = F.concat(F.lit('x, "'), F.col("p_name"), F.lit('"\nsecond line'))
    ad.table(spark, sf, "part").select(F.col("p_partkey").alias("﻿id"), note.alias("note"), F.col("p_type").alias(" kind ")).write.option("header", True).option("escape", '"').csv(path)
    return rd.read_csv_register(spark, path)
