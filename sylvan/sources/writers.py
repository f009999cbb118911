"""Writers: review exports, cell and package tables, feature lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Column names of the text-analysis export.
NLP_COLUMNS = [("park_name", "park_name"), ("review_text", "review_text"), ("rating", "rating"), ("sentiment_placeholder", "sentiment"), ("topic_placeholder", "topic"),
               ("issue_category_placeholder", "issue_category"), ("design_requirement_placeholder", "design_requirement")]


def nlp_ready(df: DataFrame) -> DataFrame:
    """The seven-column projection for text analysis."""
    return df.select(*[F.col(c).alias(n) for n, c in NLP_COLUMNS])


def write_nlp_ready(df: DataFrame, path: str, fmt: str = "csv") -> None:
    out = nlp_ready(df)
    if fmt == "csv":
        out.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    else:
        out.write.mode("overwrite").json(path)


def workbook_tables(df: DataFrame) -> dict[str, DataFrame]:
    """Place summary, reviews and text-analysis tables that belong together."""
    summary = df.groupBy("place_id", "park_name").agg(F.count(F.lit(1)).alias("reviews"), F.avg("rating").alias("avg_rating"),
                                                      F.sum(F.when(F.col("sentiment") == "NEGATIVE", 1).otherwise(0)).alias("negative"))
    reviews = df.select("place_id", "author_name", "rating", "review_text", "sentiment", "topic", "issue_category", "design_requirement", F.array_join("keywords", ", ").alias("keywords"))
    return {"park_summary": summary, "reviews": reviews, "nlp_ready": nlp_ready(df)}


def write_workbook_tables(df: DataFrame, path: str) -> None:
    for name, t in workbook_tables(df).items():
        t.write.mode("overwrite").parquet(f"{path}/{name}")


def flat_table(df: DataFrame) -> DataFrame:
    """Arrays joined with ``|`` so the table fits a CSV."""
    return df.select(*[F.array_join(F.transform(F.col(n), lambda x: x.cast("string")), "|").alias(n) if t.startswith("array<") and "struct" not in t else F.col(n) for n, t in df.dtypes])


def write_flat_csv(df: DataFrame, path: str) -> None:
    flat_table(df).write.mode("overwrite").option("header", True).csv(path)


def geojson_lines(df: DataFrame, geom_type, coordinates, properties) -> DataFrame:
    """One JSON feature per row (text column ``value``)."""
    props = F.struct(*[F.col(p) for p in properties])
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(geom_type).alias("type"), coordinates.alias("coordinates")).alias("geometry"), props.alias("properties"))).alias("value"))


def write_geojson_lines(df: DataFrame, path: str, **kw) -> None:
    geojson_lines(df, **kw).write.mode("overwrite").text(path)
