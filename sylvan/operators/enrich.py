"""Review enrichment: sentiment, keywords, issue category, topic.  Row-level, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx


def enrich_reviews(df: DataFrame, lexicon=None, text_col: str = "review_text") -> DataFrame:
    """Add sentiment, keywords, categories, issue_category, topic, design_requirement,
    category_confidence and published_ts to raw reviews."""
    out = df.withColumn("_words", tx.rule_words(text_col, lexicon))
    out = out.withColumns({"_hits": tx.sentiment_hits(text_col, F.col("_words")), "_issue": tx.classify_issue(text_col, lexicon, F.col("_words"))})
    cols = {
        "pos_hits": F.col("_hits.pos"), "neg_hits": F.col("_hits.neg"),
        "sentiment": tx.sentiment_of("rating", "_hits.pos", "_hits.neg"),
        "keywords": tx.extract_keywords(text_col),
        "category_score": F.col("_issue.score"), "issue_category": F.col("_issue.category"),
        "design_requirement": F.col("_issue.advice"), "categories": F.col("_issue.categories"),
        "category_confidence": tx.category_confidence("_issue.score"), "topic": tx.topic_of("_issue.category"),
    }
    if "published_at" in df.columns:
        cols["published_ts"] = F.try_to_timestamp("published_at")
    return out.withColumns(cols).drop("_hits", "_issue", "_words")


def sentence_table(df: DataFrame) -> DataFrame:
    """One row per sentence with its keyword sentiment and matched categories."""
    sent = df.select(
        "place_id", "review_id", "rating", "author_name", "review_text",
        F.posexplode(tx.split_sentences("review_text")).alias("pos", "sentence"),
    ).withColumn("_low", F.lower("sentence"))
    p, n = tx.contains_any(F.col("_low"), lx.POSITIVE_WORDS), tx.contains_any(F.col("_low"), lx.NEGATIVE_WORDS)
    return sent.withColumns({
        "sentence_sentiment": F.when(p & ~n, F.lit("POSITIVE")).when(n & ~p, F.lit("NEGATIVE")).otherwise(F.lit("NEUTRAL")),
        "topics": tx.labels_matched("_low", [(n, w) for n, w, _ in lx.ISSUE_LEXICON]),
    }).drop("_low")


def sentence_profile(df: DataFrame) -> DataFrame:
    """Per review, the sentence counts by sentiment; computed inside the row, without exploding."""
    def kind(s):
        p, n = tx.text_matches_any(s, lx.POSITIVE_WORDS), tx.text_matches_any(s, lx.NEGATIVE_WORDS)
        return F.when(p & ~n, F.lit(1)).when(n & ~p, F.lit(-1)).otherwise(F.lit(0))

    counts = tx.let(F.transform(tx.split_sentences("review_text"), kind), lambda k: F.struct(
        F.size(k).alias("n"), F.size(F.filter(k, lambda x: x == -1)).alias("neg"), F.size(F.filter(k, lambda x: x == 1)).alias("pos")))
    df = df.withColumn("_s", counts)
    return df.withColumns({"n_sentences": F.col("_s.n"), "n_negative": F.col("_s.neg"), "n_positive": F.col("_s.pos")}).drop("_s")


def mismatch_flag():
    """Rating and sentence sentiment point in opposite directions (after ``sentence_profile``)."""
    share = F.try_divide(F.col("n_negative"), F.col("n_sentences"))
    return F.coalesce(
        (F.col("n_sentences") > 0)
        & (((F.col("rating") >= 4) & (share >= 0.5)) | ((F.col("rating") <= 2) & (F.col("n_negative") == 0) & (F.col("n_positive") > 0))),
        F.lit(False),
    )


def rating_sentiment_mismatch(df: DataFrame) -> DataFrame:
    from ..functions.numeric import js_round

    prof = sentence_profile(df).filter(mismatch_flag())
    return prof.select(
        "place_id", "review_id", "author_name", "rating", "review_text",
        js_round(F.col("n_negative") / F.col("n_sentences"), 2).alias("negative_sentence_share"),
    )


def merge_external_labels(reviews: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels produced elsewhere replace the rule path where present; rule results fill the rest.

    ``labels``: review_id, sentiment, topic, issue_category, confidence (any may be null).
    Both sides are keyed by review_id, so Spark may choose any join strategy.
    """
    lab = labels.select(
        "review_id", F.col("sentiment").alias("_s"), F.col("issue_category").alias("_c"),
        F.col("confidence").alias("_f"), F.lit(True).alias("_m"),
    )
    j = reviews.join(lab, "review_id", "left")
    has = F.coalesce(F.col("_m"), F.lit(False))
    return j.withColumns({
        "sentiment": F.when(has, F.coalesce("_s", F.lit("NEUTRAL"))).otherwise(F.col("sentiment")),
        "issue_category": F.when(has, F.coalesce("_c", F.lit("landscape / greenery"))).otherwise(F.col("issue_category")),
        "category_confidence": F.when(has, F.coalesce("_f", F.lit(0.85))).otherwise(F.col("category_confidence")),
        "source": F.when(has, F.concat(F.col("source"), F.lit(" (labelled)"))).otherwise(F.concat(F.col("source"), F.lit(" (rules)"))),
    }).drop("_s", "_c", "_f", "_m")
