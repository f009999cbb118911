"""Exact ranks, top-n, histograms, index percentiles and normalisation.

Whole-input ranks never sort everything in one task: rows are range-partitioned by
the sort key (which ends in a unique key, so equal values do not pile up in one
partition), numbered inside each partition, and shifted by the sizes of the
partitions before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.numeric import js_round
from ..functions.session import cut_lineage


def _cols(keys):
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def exact_rank(df: DataFrame, group_cols, order, out: str = "rank") -> DataFrame:
    """1-based rank of every row within its group, for groups of any size.

    ``order`` is a list of sort Columns that ends with a unique key.  The ordered
    rows are checkpointed once, since range bounds are sampled and must not be
    drawn twice.
    """
    keys = list(group_cols)
    sort = [*[F.col(k).asc() for k in keys], *order]
    placed = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    placed = cut_lineage(placed.withColumn("_rid", F.monotonically_increasing_id()))
    placed = placed.withColumn("_pid", F.shiftright("_rid", 33))
    sizes = placed.groupBy(*keys, "_pid").agg(F.min("_rid").alias("_lo"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(*keys, "_pid", "_lo", "_off")
    return (
        placed.join(sizes, [*keys, "_pid"])
        .withColumn(out, F.col("_off") + F.col("_rid") - F.col("_lo") + F.lit(1))
        .drop("_rid", "_pid", "_lo", "_off")
    )


def top_n_by(df: DataFrame, metric, n: int, group_cols=(), seq: str = "seq") -> DataFrame:
    """Highest ``n`` rows by ``metric``; ties by ``seq``.

    Without groups this is a take-ordered; with groups the ranked filter is pushed
    below the shuffle, so at most n rows per group and task are moved.
    """
    metric = F.col(metric) if isinstance(metric, str) else metric
    df = df.withColumn("_m", metric)
    if not group_cols:
        return df.orderBy(F.desc("_m"), F.asc(seq)).limit(n).drop("_m")
    w = W.partitionBy(*group_cols).orderBy(F.desc("_m"), F.asc(seq))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).drop("_m")


def histogram(df: DataFrame, value, k: int, group_cols=()) -> DataFrame:
    """k equal-width buckets from the smallest to the largest value; empty buckets are kept."""
    value = F.col(value) if isinstance(value, str) else value
    keys = list(group_cols)
    v = df.select(*keys, value.alias("_v")).filter(F.col("_v").isNotNull())
    stats = v.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi")) if keys else v.agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(k))
    stats = stats.withColumn("_w", F.when(width == 0, F.lit(1.0)).otherwise(width)).drop("_hi")
    joined = v.join(stats, keys) if keys else v.join(F.broadcast(stats))  # one row of statistics
    idx = F.least(F.lit(k - 1), F.floor((F.col("_v") - F.col("_lo")) / F.col("_w"))).cast("int")
    counts = joined.groupBy(*keys, idx.alias("bucket_index")).agg(F.count(F.lit(1)).alias("n"))
    spine = stats.filter(F.col("_lo").isNotNull()).withColumn("bucket_index", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return spine.join(counts, [*keys, "bucket_index"], "left").select(
        *keys, "bucket_index",
        js_round(F.col("_lo") + F.col("bucket_index") * F.col("_w")).alias("bucket"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def percentiles(df: DataFrame, value, points, group_cols=(), span_minus_one: bool = False) -> DataFrame:
    """Index percentiles sorted[min(n-1, floor(p*n/100))]; exact at any size.

    Equal values are counted first, so the ranking sees one row per distinct value.
    ``span_minus_one`` takes the index int(p/100*(n-1)) instead.
    """
    value = F.col(value) if isinstance(value, str) else value
    keys = list(group_cols)
    hist = df.select(*keys, value.alias("_v")).filter(F.col("_v").isNotNull()).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    hist = cut_lineage(hist.repartitionByRange(*_cols(keys), F.col("_v")).sortWithinPartitions(*keys, "_v")
                       .withColumn("_pid", F.spark_partition_id()))
    sizes = hist.groupBy(*keys, "_pid").agg(F.sum("_c").alias("_n"))
    wg = W.partitionBy(*keys)
    sizes = sizes.withColumns({
        "_off": F.coalesce(F.sum("_n").over(wg.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "_total": F.sum("_n").over(wg),
    }).drop("_n")
    within = W.partitionBy(*keys, "_pid").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    cum = hist.join(sizes, [*keys, "_pid"]).withColumn("_hi", F.col("_off") + F.sum("_c").over(within))
    pts = F.explode(F.array(*[F.lit(p) for p in points])).alias("percentile")
    cum = cum.select(*keys, "_v", "_c", "_hi", "_total", pts)
    if span_minus_one:
        idx = F.floor(F.col("percentile") / F.lit(100.0) * (F.col("_total") - 1))
    else:
        idx = F.least(F.col("_total") - 1, F.floor(F.col("percentile") / F.lit(100.0) * F.col("_total")))
    return cum.filter((idx < F.col("_hi")) & (idx >= F.col("_hi") - F.col("_c"))).select(*keys, "percentile", F.col("_v").alias("value"))


def minmax_normalise(df: DataFrame, value: str, out: str, group_cols=(), scale: float = 1.0, inverse: bool = False, flat: float = 0.0) -> DataFrame:
    """(x - min) / (max - min) per group by a statistics join (no whole-group window)."""
    keys = list(group_cols)
    agg = [F.min(value).alias("_lo"), F.max(value).alias("_hi")]
    stats = df.groupBy(*keys).agg(*agg) if keys else df.agg(*agg)
    j = df.join(stats, keys, "left") if keys else df.join(F.broadcast(stats))  # one row
    x = (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    x = F.when(F.col("_hi") == F.col("_lo"), F.lit(float(flat))).otherwise((F.lit(1.0) - x) if inverse else x)
    return j.withColumn(out, x * F.lit(float(scale))).drop("_lo", "_hi")


def zscore(df: DataFrame, fields, group_cols=()) -> DataFrame:
    """Population z-score of each field within its group; 0 where the field does not vary."""
    keys = list(group_cols)
    agg = []
    for f in fields:
        v = F.coalesce(F.col(f).cast("double"), F.lit(0.0))
        agg += [F.avg(v).alias(f"_m_{f}"), F.stddev_pop(v).alias(f"_s_{f}")]
    stats = df.groupBy(*keys).agg(*agg) if keys else df.agg(*agg)
    j = df.join(stats, keys) if keys else df.join(F.broadcast(stats))  # one row
    out = {}
    for f in fields:
        v = F.coalesce(F.col(f).cast("double"), F.lit(0.0))
        out[f"z_{f}"] = F.when(F.col(f"_s_{f}") == 0, F.lit(0.0)).otherwise((v - F.col(f"_m_{f}")) / F.col(f"_s_{f}"))
    return j.withColumns(out).drop(*[f"_m_{f}" for f in fields], *[f"_s_{f}" for f in fields])


def quote_score():
    """Confidence minus a penalty for quotes too short or too long for a card."""
    n = F.length(F.coalesce(F.col("review_text"), F.lit("")))
    return F.coalesce(F.col("category_confidence"), F.lit(0.5)) - F.when(n < 40, F.lit(0.4)).when(n > 220, F.lit(0.25)).otherwise(F.lit(0.0))


def representative_quote(df: DataFrame, group_cols, seq: str = "review_id") -> DataFrame:
    """Best quote per group as an aggregate with map-side combine (no sort of hot groups)."""
    key = F.struct(quote_score(), -F.col(seq))
    return df.groupBy(*group_cols).agg(
        F.max_by(F.struct(seq, "author_name", "review_text", "design_requirement"), key).alias("_q")
    ).select(*group_cols, F.col(f"_q.{seq}").alias("quote_id"), F.col("_q.author_name").alias("quote_author"),
             F.col("_q.review_text").alias("quote"), F.col("_q.design_requirement").alias("design_implication"))


def weighted_mean(value, weight):
    """Aggregate Column sum(w*x)/sum(w); null when the weights sum to 0."""
    value = F.col(value) if isinstance(value, str) else value
    weight = F.col(weight) if isinstance(weight, str) else weight
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))
