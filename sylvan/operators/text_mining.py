"""Word n-grams, TF-IDF and topic co-occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.numeric import js_round


def _top(df: DataFrame, group_cols, n: int, *order) -> DataFrame:
    """Top n overall (take-ordered) or per group (ranked filter pushed below the shuffle)."""
    if not group_cols:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*group_cols).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def ngrams(df: DataFrame, n: int = 2, top: int = 30, group_cols=()) -> DataFrame:
    """Most frequent n-grams with at least two occurrences; ties by first occurrence."""
    keys = list(group_cols)
    def grams(t):
        starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - (n - 1)))
        return F.transform(starts, lambda i: F.concat_ws(" ", *[F.element_at(t, i + k) for k in range(n)]))

    ex = df.select(*keys, "review_id", F.posexplode(tx.let(tx.tokenize_light("review_text"), grams)).alias("pos", "phrase"))
    c = ex.groupBy(*keys, "phrase").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("review_id", "pos")).alias("_first")).filter(F.col("n") >= 2)
    return _top(c, keys, top, F.desc("n"), F.asc("_first")).drop("_first")


def tfidf(df: DataFrame, top: int = 40, group_cols=()) -> DataFrame:
    """Mean tf-idf over the documents that hold a term; idf = ln(N/df), df >= 3, length > 2.

    idf is constant per term, so one pass is enough: each token adds 1/len(document) to
    its term and each distinct token adds 1 to the document frequency.  A single shuffle
    by term, combined on the map side; nothing is keyed by document.
    """
    keys = list(group_cols)
    t = df.select(*keys, tx.tokenize_light("review_text").alias("_t")).filter(F.size("_t") > 0)
    total = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("_docs")) if keys else t.agg(F.count(F.lit(1)).alias("_docs"))
    parts = tx.let(F.col("_t"), lambda v: F.concat(
        F.transform(v, lambda w: F.struct(w.alias("term"), F.lit(0).alias("df"), F.size(v).alias("_n"))),
        F.transform(F.array_distinct(v), lambda w: F.struct(w.alias("term"), F.lit(1).alias("df"), F.size(v).alias("_n"))),
    ))
    ex = t.select(*keys, F.inline(parts))
    c = ex.groupBy(*keys, "term").agg(F.sum("df").alias("df"), F.sum(F.when(F.col("df") == 0, F.lit(1.0) / F.col("_n")).otherwise(F.lit(0.0))).alias("_tf"))
    c = c.filter((F.length("term") > 2) & (F.col("df") >= 3))
    j = c.join(total, keys) if keys else c.join(F.broadcast(total))  # one row
    s = j.withColumn("_s", F.col("_tf") * F.log(F.col("_docs") / F.col("df")) / F.col("df"))
    out = _top(s, keys, top, F.desc(js_round("_s", 9)), F.asc("term"))
    return out.select(*keys, "term", "df", js_round("_s", 3).alias("score"))


def topic_nodes(df: DataFrame, group_cols=()) -> DataFrame:
    return tx.exploded(df, "categories", group_cols, "category").groupBy(*group_cols, "category").agg(F.count(F.lit(1)).alias("n"))


def topic_cooccurrence(df: DataFrame, max_edges: int = 40, group_cols=()) -> DataFrame:
    """Unordered category pairs within a review.  The pairs come from the row's own array of at
    most 20 categories, so there is no self-join."""
    keys = list(group_cols)
    def pairs_of(v):
        return F.flatten(F.transform(v, lambda a: F.transform(
            F.filter(v, lambda b: b > a), lambda b: F.struct(a.alias("source"), b.alias("target")))))

    pairs = tx.let(F.sort_array("categories"), pairs_of)
    d = df
    c = d.select(*keys, "review_id", F.inline(pairs)).groupBy(*keys, "source", "target").agg(F.count(F.lit(1)).alias("weight"), F.min("review_id").alias("_first"))
    return _top(c, keys, max_edges, F.desc("weight"), F.asc("_first"), F.asc("source"), F.asc("target")).drop("_first")
