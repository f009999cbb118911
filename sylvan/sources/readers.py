"""Readers: scraped reviews, places, GeoJSON, geometry blobs, weather files and registers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_REVIEW = T.StructType([T.StructField(n, T.StringType()) for n in ("text", "textTranslated", "name", "publishAt", "publishedAtDate")] + [T.StructField("stars", T.IntegerType())])


def read_reviews_json(spark: SparkSession, paths, place_map: DataFrame) -> DataFrame:
    """Scraped JSON arrays -> reviews.  ``place_map``: file_name, place_id, park_name.

    Blank texts are dropped; the translated text wins over the original.
    """
    raw = spark.read.schema(RAW_REVIEW).option("multiLine", True).json(paths).withColumn("file_name", F.element_at(F.split(F.input_file_name(), "/"), -1))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    d = raw.filter(blank(F.col("text")).isNotNull()).join(place_map, "file_name")
    return d.select("place_id", "park_name", F.coalesce(blank(F.col("name")), F.lit("Anonymous")).alias("author_name"), F.coalesce("stars", F.lit(0)).alias("rating"),
                    F.coalesce(blank(F.col("textTranslated")), F.col("text")).alias("review_text"), F.col("publishAt").alias("published_time"), F.col("publishedAtDate").alias("published_at"),
                    F.lit("scrape").alias("source"))


PLACE = T.StructType([
    T.StructField("place_id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("formatted_address", T.StringType()), T.StructField("rating", T.DoubleType()),
    T.StructField("user_ratings_total", T.IntegerType()), T.StructField("types", T.ArrayType(T.StringType())),
    T.StructField("geometry", T.StructType([T.StructField("location", T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lng", T.DoubleType())]))])),
    T.StructField("reviews", T.ArrayType(T.StructType([T.StructField("author_name", T.StringType()), T.StructField("rating", T.IntegerType()), T.StructField("text", T.StringType()),
                                                       T.StructField("time", T.LongType()), T.StructField("language", T.StringType())]))),
])


def read_places_json(spark: SparkSession, paths) -> DataFrame:
    """Provider payload with nested reviews -> one row per place and review; epoch seconds become ISO text."""
    d = spark.read.schema(PLACE).option("multiLine", True).json(paths)
    ex = d.select("place_id", "name", "formatted_address", F.col("geometry.location.lat").alias("lat"), F.col("geometry.location.lng").alias("lng"),
                  F.col("rating").alias("place_rating"), "user_ratings_total", "types", F.explode_outer("reviews").alias("r"))
    return ex.select("*", F.col("r.author_name").alias("author_name"), F.col("r.rating").alias("rating"), F.col("r.text").alias("review_text"), F.col("r.language").alias("language"),
                     F.date_format(F.timestamp_seconds("r.time"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at")).drop("r")


GEOJSON = "type string, geometry string, properties map<string,string>, features array<struct<type:string,geometry:string,properties:map<string,string>>>"
COORD_TYPES = {"Point": "array<double>", "MultiPoint": "array<array<double>>", "LineString": "array<array<double>>", "MultiLineString": "array<array<array<double>>>",
               "Polygon": "array<array<array<double>>>", "MultiPolygon": "array<array<array<array<double>>>>"}


def read_geojson(spark: SparkSession, paths) -> DataFrame:
    """Features of FeatureCollection or bare Feature files; :func:`rejected_geojson` lists the other files.

    Coordinates are parsed by geometry type into ``points`` (all vertices) and ``ring`` (first ring or line).
    """
    d = spark.read.option("wholetext", True).text(paths).select(F.input_file_name().alias("file"), F.from_json("value", GEOJSON).alias("j"))
    one = F.array(F.struct(F.col("j.type").alias("type"), F.col("j.geometry").alias("geometry"), F.col("j.properties").alias("properties")))
    fs = F.when(F.col("j.type") == "FeatureCollection", F.col("j.features")).when(F.col("j.type") == "Feature", one)
    ex = d.select("file", F.posexplode(fs).alias("seq", "f")).select("file", "seq", F.col("f.geometry").alias("geometry"), F.col("f.properties").alias("properties"))
    return typed_geometry(ex)


def rejected_geojson(spark: SparkSession, paths) -> DataFrame:
    """file, reason: files without features, because they are no JSON object or have another root type."""
    root = F.get_json_object("value", "$.type")
    d = spark.read.option("wholetext", True).text(paths).select(F.input_file_name().alias("file"), root.alias("root"))
    return d.filter(F.col("root").isNull() | ~F.col("root").isin("FeatureCollection", "Feature")).select("file", F.coalesce(F.concat(F.lit("root type "), "root"), F.lit("no JSON object with a type")).alias("reason"))


def typed_geometry(df: DataFrame, column: str = "geometry") -> DataFrame:
    """Add geom_type and points (array<struct<lng,lat>>) from a GeoJSON geometry string."""
    t = F.get_json_object(column, "$.type")
    c = F.get_json_object(column, "$.coordinates")
    pts = None
    for name, schema in COORD_TYPES.items():
        v = F.from_json(c, schema)
        depth = schema.count("array<")
        flat = F.array(v) if depth == 1 else v
        for _ in range(max(0, depth - 2)):
            flat = F.flatten(flat)
        flat = F.transform(flat, lambda p: F.struct(F.get(p, F.lit(0)).alias("lng"), F.get(p, F.lit(1)).alias("lat")))
        pts = F.when(F.col("geom_type") == name, flat) if pts is None else pts.when(F.col("geom_type") == name, flat)
    return df.withColumn("geom_type", t).withColumn("points", pts)


def project_layer(df: DataFrame, prop_map: dict, props: str = "properties") -> DataFrame:
    """Keep and rename allow-listed properties, drop null values and rows without geometry."""
    entries = F.array(*[F.struct(F.lit(out).alias("key"), F.try_element_at(props, F.lit(src)).alias("value")) for src, out in prop_map.items()])
    return df.filter(F.col("geometry").isNotNull()).withColumn(props, F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())))


# Fixed values of the public formats: names by type code, envelope doubles by envelope code.
WKB_NAMES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}
ENVELOPE_DOUBLES = {0: 0, 1: 4, 2: 6, 3: 6, 4: 8}


class _Blob:
    """A cursor over a binary geometry; runs of vertices are read as arrays."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def numbers(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self.data, kind, n, self.at)
        self.at += out.nbytes
        return out

    def header(self) -> tuple[str, int, int]:
        """Byte order, type code without dimensions, and numbers per vertex (ISO codes and the extended flag bits)."""
        order = ">" if self.numbers("u1", 1)[0] == 0 else "<"
        code = int(self.numbers(order + "u4", 1)[0])
        flags, plain = code >> 29, code & 0x1FFFFFFF
        if flags & 1:  # a reference system id follows
            self.numbers(order + "u4", 1)
        iso = plain // 1000
        return order, plain % 1000, 2 + max(bool(flags & 4) + bool(flags & 2), (0, 1, 1, 2)[iso] if iso < 4 else 99)

    def run(self, order: str, n: int, width: int) -> list:
        return np.round(self.numbers(order + "f8", n * width).reshape(n, width)[:, :2], 6).tolist()

    def count(self, order: str) -> int:
        return int(self.numbers(order + "u4", 1)[0])


def decode_geometry(data: bytes) -> tuple[str, list | None]:
    """Type name and coordinates (rounded to 6 decimals) of a GeoPackage, ISO or extended WKB blob; ValueError on bad input.

    Containers wait on a stack for their parts, so nesting costs no recursion.
    """
    start = 0
    if data[:2] == b"GP":
        if data[3] & 0x10:
            return "Empty", None
        start = 8 + 8 * ENVELOPE_DOUBLES[data[3] >> 1 & 7]
    blob, waiting = _Blob(data, start), []
    while True:
        order, kind, width = blob.header()
        name = WKB_NAMES[kind]
        if kind >= 4:
            waiting.append((name, blob.count(order), []))
            done = None
        elif kind == 1:
            done = blob.run(order, 1, width)[0]
            done = None if done[0] != done[0] else done  # an empty point is not a number
        elif kind == 2:
            done = blob.run(order, blob.count(order), width)
        else:
            done = [blob.run(order, blob.count(order), width) for _ in range(blob.count(order))]
        if kind < 4 and not waiting:
            return name, done
        if kind < 4:
            waiting[-1][2].append({"type": name, "coordinates": done} if waiting[-1][0] == "GeometryCollection" else done)
        while waiting and len(waiting[-1][2]) == waiting[-1][1]:
            name, _, parts = waiting.pop()
            if not waiting:
                return name, parts
            waiting[-1][2].append({"type": name, "coordinates": parts} if waiting[-1][0] == "GeometryCollection" else parts)


def geometry_from_wkb(df: DataFrame, column: str = "geom") -> DataFrame:
    """Decode a column of geometry blobs: adds geom_type, coordinates (JSON text) and geom_error.

    Null and empty geometries give nulls; a blob that cannot be read gives nulls and the reason, and
    the job goes on.  Arrow batches are decoded in parallel on the executors.
    """
    @F.pandas_udf("struct<geom_type:string,coordinates:string,geom_error:string>")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import json

        def one(b):
            if b is None:
                return None, None, None
            try:
                kind, coords = decode_geometry(bytes(b))
            except (ValueError, KeyError, IndexError) as e:
                return None, None, f"unreadable geometry: {e}"
            return (None, None, None) if coords is None else (kind, json.dumps(coords), None)

        for s in batches:
            yield pd.DataFrame([one(b) for b in s], columns=["geom_type", "coordinates", "geom_error"])

    names = ("geom_type", "coordinates", "geom_error")
    return df.withColumn("_g", decode(column)).withColumns({n: F.col(f"_g.{n}") for n in names}).drop("_g")


# Positions of the weather columns.
EPW_COLUMNS = {"month": (1, "int"), "day": (2, "int"), "hour": (3, "int"), "dry_bulb_c": (6, "double"), "rh_pct": (8, "double"), "ghi_wh_m2": (13, "double"), "wind_dir_deg": (20, "double"), "wind_ms": (21, "double")}


def read_epw(spark: SparkSession, paths) -> DataFrame:
    """Hourly weather files: header lines fall out because they have fewer than 35 fields or no numeric month."""
    d = spark.read.text(paths).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("station"), F.split("value", ",").alias("f"))
    d = d.filter((F.size("f") >= 35) & F.get("f", F.lit(1)).try_cast("int").isNotNull() & F.get("f", F.lit(6)).try_cast("double").isNotNull())
    return d.select("station", *[F.get("f", F.lit(i)).try_cast(t).alias(n) for n, (i, t) in EPW_COLUMNS.items()])


def read_csv_register(spark: SparkSession, paths) -> DataFrame:
    """CSV with a header, quotes doubled inside quoted fields; a byte-order mark on the first name is removed."""
    d = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True).option("escape", '"').csv(paths)
    return d.toDF(*[c.lstrip("﻿").strip() for c in d.columns])
