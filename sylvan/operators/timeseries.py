"""Time buckets, periods, trends and season labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.numeric import count_where, js_round
from ..functions.session import fixed_table
from .ranking import exact_rank


def period_key(ts, grain: str) -> Column:
    """'2026-03', '2026-Q1' or '2026'; null for null dates."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    year = F.date_format(ts, "yyyy")
    if grain == "year":
        return year
    if grain == "quarter":
        return F.concat(year, F.lit("-Q"), F.quarter(ts).cast("string"))
    return F.date_format(ts, "yyyy-MM")


def bucket_by_time(df: DataFrame, group_cols=("place_id",), n: int = 8, seq: str = "review_id") -> DataFrame:
    """Add bucket 0..n-1 (chunks of ceil(N/n) rows) and time_basis.

    Calendar order where at least 80 % of the group has a date (undated rows last),
    else row order.
    """
    keys = list(group_cols)
    stats = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"), F.count("published_ts").alias("_dated"))
    stats = stats.withColumn("_cal", F.col("_dated") / F.col("_total") >= F.lit(0.8)).drop("_dated")
    df = df.join(stats, keys)
    ts = F.when(F.col("_cal"), F.col("published_ts"))
    ranked = exact_rank(df.withColumn("_ts", ts), keys, [F.col("_ts").asc_nulls_last(), F.col(seq).asc()], "_rank")
    size = F.greatest(F.lit(1), F.ceil(F.col("_total") / F.lit(float(n))))
    return ranked.withColumns({
        "bucket": F.floor((F.col("_rank") - 1) / size).cast("int"),
        "time_basis": F.when(F.col("_cal"), F.lit("calendar")).otherwise(F.lit("sequence")),
    }).drop("_ts", "_rank", "_total", "_cal")


def trend_from_halves(early, recent) -> Column:
    """Struct(trend, trend_pct) from the means of the early and the late half."""
    pct = F.when(early == 0, F.when(recent == 0, F.lit(0.0)).otherwise(F.lit(100.0))).otherwise(
        (recent - early) / F.abs(early) * F.lit(100.0)
    )
    pct = F.coalesce(pct, F.lit(0.0))
    return F.struct(
        F.when(pct > 2, F.lit("up")).when(pct < -2, F.lit("down")).otherwise(F.lit("flat")).alias("trend"),
        js_round(pct, 1).alias("trend_pct"),
    )


def series_trend(series: DataFrame, group_cols, order: str, value: str, min_points: int = 1) -> DataFrame:
    """Trend of a short ordered series per group (one row per period)."""
    keys = list(group_cols)
    wg = W.partitionBy(*keys)
    s = series.withColumns({"_rn": F.row_number().over(wg.orderBy(order)), "_n": F.count(F.lit(1)).over(wg)})
    half = F.greatest(F.lit(1), F.floor(F.col("_n") / F.lit(2)))
    out = s.groupBy(*keys).agg(
        F.max("_n").alias("n_points"),
        F.avg(F.when(F.col("_rn") <= half, F.col(value).cast("double"))).alias("_early"),
        F.avg(F.when(F.col("_rn") > F.col("_n") - half, F.col(value).cast("double"))).alias("_late"),
    )
    ok = F.col("n_points") >= min_points
    t = trend_from_halves(F.when(ok, F.col("_early")).otherwise(F.lit(0.0)), F.when(ok, F.col("_late")).otherwise(F.lit(0.0)))
    return out.withColumn("_t", t).select(*keys, "n_points", F.col("_t.trend").alias("trend"), F.col("_t.trend_pct").alias("trend_pct"))


def with_season_labels(df: DataFrame, ts: str = "published_ts", calendar=None) -> DataFrame:
    """Season, Ramadan flag, day type and posting time of each dated row.

    The calendar is a range join against a fixed table of a few rows; ranges do
    not overlap, so rows are not multiplied.
    """
    cal = fixed_table(df.sparkSession, [(a, b) for a, b in calendar or lx.RAMADAN], "start_day string, end_day string")
    day = F.to_date(ts)
    m, h, d = F.month(ts), F.hour(ts), F.dayofweek(ts)
    j = df.join(cal, (day >= F.to_date("start_day")) & (day <= F.to_date("end_day")), "left")
    return j.withColumns({
        "season": F.when(m.between(6, 9), "Summer").when((m >= 11) | (m <= 3), "Winter").when(m.isNotNull(), "Transitional"),
        "ramadan": F.when(F.col("start_day").isNotNull(), "Ramadan").when(m.isNotNull(), "Non-Ramadan"),
        "day_type": F.when(d.isin(1, 7), "Weekend").when(d.isNotNull(), "Weekday"),
        "posting_time": F.when(h.between(5, 11), "Morning").when(h.between(12, 16), "Afternoon")
        .when(h.between(17, 20), "Evening").when(h.isNotNull(), "Night"),
    }).drop("start_day", "end_day")


METRICS = ("avg_rating", "sentiment_score", "review_volume", "negative_pct")


def place_time_series(df: DataFrame, grain: str = "month", place: str = "place_id") -> DataFrame:
    """period x place matrix in long form, nulls where empty, plus the all-place row (place null).

    Grouping sets give the per-place and the all-place values in one aggregation.
    """
    dated = df.filter(F.col("published_ts").isNotNull()).withColumn("period", period_key("published_ts", grain))
    one = F.when(F.col("sentiment") == "POSITIVE", 1).when(F.col("sentiment") == "NEGATIVE", -1).otherwise(0)
    agg = dated.groupingSets([["period", place], ["period"]], "period", place).agg(
        F.grouping(place).alias("_all"),
        F.count(F.lit(1)).alias("n"), F.sum("rating").alias("_r"), F.sum(one).alias("_s"),
        count_where(F.col("sentiment") == "NEGATIVE").alias("_neg"),
    )
    vals = {
        "avg_rating": F.col("_r") / F.col("n"),
        "sentiment_score": (F.col("_s") / F.col("n") + F.lit(1.0)) / F.lit(2.0) * F.lit(100.0),
        "negative_pct": F.col("_neg") / F.col("n") * F.lit(100.0),
    }
    agg = agg.withColumns(vals).withColumnRenamed("n", "review_volume")
    agg = agg.withColumn(place, F.when(F.col("_all") == 1, F.lit("(all)")).otherwise(F.col(place)))
    return agg.select("period", place, *METRICS)


def place_time_matrix(df: DataFrame, metric: str, places, grain: str = "month", place: str = "place_id") -> DataFrame:
    """The series of one metric as a wide table: one column per given place, nulls where empty."""
    long = place_time_series(df, grain, place)
    return long.groupBy("period").pivot(place, [*places, "(all)"]).agg(F.first(metric))


def topic_evolution(df: DataFrame, grain: str = "month", group_cols=()) -> DataFrame:
    """Share of each issue category per period."""
    keys = [*group_cols, "period"]
    d = df.filter(F.col("published_ts").isNotNull()).withColumn("period", period_key("published_ts", grain))
    c = d.groupBy(*keys, "issue_category").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*keys)))


def keyword_trend(df: DataFrame, keyword: str, grain: str = "month", group_cols=()) -> DataFrame:
    """Reviews per period that contain ``keyword``; periods of dated reviews without a hit stay as 0."""
    d = df.filter(F.col("published_ts").isNotNull()).withColumn("period", period_key("published_ts", grain))
    return d.groupBy(*group_cols, "period").agg(count_where(F.contains(F.lower("review_text"), F.lit(keyword.lower()))).alias("n"))


def monthly_series(df: DataFrame, group_cols=("place_id",)) -> DataFrame:
    """Monthly volume and 0-100 sentiment of the dated reviews."""
    one = F.when(F.col("sentiment") == "POSITIVE", 1.0).when(F.col("sentiment") == "NEGATIVE", -1.0).otherwise(0.0)
    d = df.filter(F.col("published_ts").isNotNull())
    return d.groupBy(*group_cols, period_key("published_ts", "month").alias("period")).agg(
        F.count(F.lit(1)).alias("n"), js_round((F.avg(one) + 1.0) / 2.0 * 100.0).alias("sentiment_score"))


def temporal_summary(df: DataFrame, group_cols=("place_id",)) -> DataFrame:
    """Dated share and the trend of the monthly volume; the four label breakdowns are ``seasonal_breakdown``."""
    keys = list(group_cols)
    base = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (js_round(F.count("published_ts") / F.count(F.lit(1)) * 1000.0) / 10.0).alias("dated_share"))
    tr = series_trend(monthly_series(df, keys), keys, "period", "n", 2)
    return base.join(tr, keys, "left").select(*keys, "n", "dated_share", F.col("trend").alias("volume_trend"), F.col("trend_pct").alias("volume_trend_pct"))
