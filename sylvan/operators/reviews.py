"""Aggregate analyses of enriched reviews.

Every operator takes ``group_cols`` (default: per place).  Aggregations combine on the
map side and leave at most (groups x categories) rows; windows run on those small
results only, so one place or category with a third of all rows costs no extra.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..functions.numeric import any_of, band, clamp, count_where, js_round, share
from ..functions.session import fixed_table
from .enrich import mismatch_flag, sentence_profile
from .ranking import quote_score
from .timeseries import bucket_by_time, period_key, series_trend, trend_from_halves, with_season_labels

PLACE = ("place_id",)


def pos():
    return F.col("sentiment") == "POSITIVE"


def neg():
    return F.col("sentiment") == "NEGATIVE"


def sign():
    return F.when(pos(), F.lit(1.0)).when(neg(), F.lit(-1.0)).otherwise(F.lit(0.0))


def sentiment_summary(df: DataFrame, group_cols=PLACE) -> DataFrame:
    """Mean sentiment (-1..1) and the three shares."""
    return df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"), F.avg(sign()).alias("sentiment_score"),
        share(pos()).alias("positive_share"), share(F.col("sentiment") == "NEUTRAL").alias("neutral_share"), share(neg()).alias("negative_share"),
    )


def priority_index(mention_share, negative_share, avg_rating):
    return F.least(F.lit(100.0), js_round(
        (mention_share * F.lit(0.4) + negative_share * F.lit(0.4) + (F.lit(5.0) - avg_rating) / F.lit(5.0) * F.lit(0.2)) * F.lit(100.0)))


def _impact_from_counts(agg: DataFrame, keys) -> DataFrame:
    """agg: keys, issue_category, n, neg, rating_sum -> impact rows."""
    total = F.sum("n").over(W.partitionBy(*keys))
    agg = agg.withColumns({
        "mention_share": F.col("n") / total,
        "_avg": F.col("rating_sum") / F.col("n"),
        "negative_share": F.col("neg") / F.col("n"),
    })
    agg = agg.withColumn("priority_index", priority_index(F.col("mention_share"), F.col("negative_share"), F.col("_avg")))
    return agg.withColumns({
        "avg_rating": js_round("_avg", 1), "priority": band(F.col("priority_index"), lx.PRIORITY_CUTS, "Low"),
    }).withColumnRenamed("n", "mentions").drop("_avg", "neg", "rating_sum")


def issue_impact(df: DataFrame, group_cols=PLACE) -> DataFrame:
    """Per issue category: mentions, shares, average rating, priority index and level."""
    keys = list(group_cols)
    agg = df.groupBy(*keys, "issue_category").agg(
        F.count(F.lit(1)).alias("n"), count_where(neg()).alias("neg"), F.sum(F.col("rating").cast("double")).alias("rating_sum"),
        F.min("review_id").alias("first_seq"),
    )
    return _impact_from_counts(agg, keys)


IMPACT_ORDER = {"priority": ("priority_index", False), "frequency": ("mentions", False), "rating": ("avg_rating", True), "sentiment": ("negative_share", False)}


def sort_issue_impact(impact: DataFrame, mode: str = "priority", group_cols=PLACE) -> DataFrame:
    """Rank impact rows by one of four modes; ties keep first-seen order."""
    col, asc = IMPACT_ORDER[mode]
    w = W.partitionBy(*group_cols).orderBy(F.asc(col) if asc else F.desc(col), F.asc("first_seq"))
    return impact.withColumn("rank", F.row_number().over(w))


KPI_IDS = ["totalReviews", "parksSelected", "avgRating", "sentimentScore", "positivePct", "neutralPct", "negativePct", "themeCount",
           "aiConfidence", "designOpportunities", "criticalIssues", "avgReviewLength"]  # fixed values: KPI ids in display order


def _kpi_values(agg: DataFrame, keys, parks: int) -> DataFrame:
    """Category-level sums per ``keys`` -> one row per key with a column per KPI."""
    imp = _impact_from_counts(agg.select(*keys, "issue_category", "n", "neg", "rating_sum"), keys)
    lv = imp.groupBy(*keys).agg(
        count_where(F.col("priority") != "Low").alias("designOpportunities"),
        count_where(F.col("priority").isin("High", "Very High")).alias("criticalIssues"),
    )
    tot = agg.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("rating_sum").alias("r"),
        F.sum("conf_sum").alias("cf"), F.sum("words").alias("wd"), F.count("issue_category").alias("themes"),
    )
    n = F.col("n").cast("double")
    ps, ns = F.col("pos") / n, F.col("neg") / n
    out = tot.join(lv, keys).withColumns({
        "totalReviews": n, "parksSelected": F.lit(float(parks)), "avgRating": F.col("r") / n,
        "sentimentScore": ((F.col("pos") - F.col("neg")) / n + F.lit(1.0)) / F.lit(2.0) * F.lit(100.0),
        "positivePct": ps * F.lit(100.0), "neutralPct": (F.col("n") - F.col("pos") - F.col("neg")) / n * F.lit(100.0), "negativePct": ns * F.lit(100.0),
        "themeCount": F.col("themes").cast("double"), "aiConfidence": F.col("cf") / n * F.lit(100.0),
        "designOpportunities": F.col("designOpportunities").cast("double"), "criticalIssues": F.col("criticalIssues").cast("double"),
        "avgReviewLength": F.col("wd") / n,
    })
    return out.select(*keys, "n", *KPI_IDS)


def _kpi_base(df: DataFrame, keys) -> DataFrame:
    return df.groupBy(*keys, "issue_category").agg(
        F.count(F.lit(1)).alias("n"), count_where(pos()).alias("pos"), count_where(neg()).alias("neg"),
        F.sum(F.col("rating").cast("double")).alias("rating_sum"), F.sum(F.coalesce("category_confidence", F.lit(0.5))).alias("conf_sum"),
        F.sum(tx.word_count("review_text")).alias("words"),
    )


def kpi_buckets(df: DataFrame, group_cols=PLACE, parks: int = 1, n: int = 8) -> DataFrame:
    """Sparkline values of the 12 KPIs: one row per group, KPI and time bucket (empty buckets included)."""
    keys = list(group_cols)
    cols = [*keys, "review_id", "issue_category", "sentiment", "rating", "category_confidence", "review_text", "published_ts"]
    df = df.select(*dict.fromkeys(cols)).withColumn("_w", tx.word_count("review_text")).drop("review_text")
    b = bucket_by_time(df, keys, n)
    agg = b.groupBy(*keys, "bucket", "time_basis", "issue_category").agg(
        F.count(F.lit(1)).alias("n"), count_where(pos()).alias("pos"), count_where(neg()).alias("neg"),
        F.sum(F.col("rating").cast("double")).alias("rating_sum"), F.sum(F.coalesce("category_confidence", F.lit(0.5))).alias("conf_sum"),
        F.sum("_w").alias("words"),
    )
    vals = _kpi_values(agg, [*keys, "time_basis", "bucket"], parks)
    spine = vals.select(*keys, "time_basis").distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    empty = {"parksSelected": float(parks), "sentimentScore": 50.0}
    full = spine.join(vals, [*keys, "time_basis", "bucket"], "left").fillna({k: empty.get(k, 0.0) for k in KPI_IDS} | {"n": 0})
    return full.unpivot([*keys, "time_basis", "bucket", "n"], KPI_IDS, "kpi", "value")


def kpis(df: DataFrame, group_cols=PLACE, parks: int = 1, n: int = 8) -> DataFrame:
    """12 KPIs per group with overall value, 8-bucket sparkline, trend and time basis."""
    keys = list(group_cols)
    buckets = kpi_buckets(df, keys, parks, n)
    half = n // 2
    t = buckets.groupBy(*keys, "kpi", "time_basis").agg(
        F.avg(F.when(F.col("bucket") < half, F.col("value"))).alias("_e"), F.avg(F.when(F.col("bucket") >= n - half, F.col("value"))).alias("_l"),
        F.sum("n").alias("sample_size"),
        F.transform(F.sort_array(F.collect_list(F.struct("bucket", "value"))), lambda x: x["value"]).alias("sparkline"),
    ).withColumn("_t", trend_from_halves(F.col("_e"), F.col("_l")))
    overall = _kpi_values(_kpi_base(df, keys), keys, parks).drop("n").unpivot(keys, KPI_IDS, "kpi", "value")
    return t.join(overall, [*keys, "kpi"]).select(
        *keys, "kpi", "value", F.col("_t.trend").alias("trend"), F.col("_t.trend_pct").alias("trend_pct"), "sparkline", "time_basis", "sample_size")


def health_pools():
    """Predicate of each health sub-score pool."""
    cat, low = F.col("issue_category"), F.lower("review_text")
    has = lambda words: tx.contains_any(low, words)
    return {
        "thermalComfort": cat == "shade / heat comfort",
        "accessibility": cat == "accessibility",
        "maintenance": cat.isin("maintenance", "cleanliness"),
        "safety": cat.isin("safety", "lighting"),
        "familyFriendliness": has(lx.FAMILY_WORDS),
        "playQuality": cat.isin("playground", "sports facilities"),
        "landscapeQuality": cat.isin("landscape / greenery", "water features"),
        "biodiversity": (cat == "landscape / greenery") & has(lx.BIODIVERSITY_WORDS),
        "amenities": cat.isin("toilets", "food / cafe", "parking"),
        "walkability": (cat == "accessibility") & has(lx.WALK_WORDS),
        "communityActivity": ((cat == "crowding") & ~neg()) | has(lx.COMMUNITY_WORDS),
    }


def health_score(df: DataFrame, group_cols=PLACE) -> DataFrame:
    """11 sub-scores per group in one pass; fewer than 5 reviews give the flagged baseline of 60."""
    keys = list(group_cols)
    flags = df.select(*keys, "sentiment", "rating", *[p.alias(f"_f_{k}") for k, p in health_pools().items()])
    agg = []
    for k, _ in lx.HEALTH_KEYS:
        f = F.col(f"_f_{k}")
        agg += [count_where(f).alias(f"{k}_n"), count_where(f & pos()).alias(f"{k}_p"), count_where(f & neg()).alias(f"{k}_g"),
                F.sum(F.when(f, F.col("rating").cast("double")).otherwise(0.0)).alias(f"{k}_r")]
    wide = flags.groupBy(*keys).agg(*agg)
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(label).alias("label"), F.col(f"{k}_n").alias("n"), F.col(f"{k}_p").alias("p"),
                              F.col(f"{k}_g").alias("g"), F.col(f"{k}_r").alias("r")) for k, label in lx.HEALTH_KEYS])
    long = wide.select(*keys, F.inline(rows))
    n = F.col("n").cast("double")
    comp = (F.col("p") / n - F.col("g") / n + F.lit(1.0)) / F.lit(2.0)
    score = clamp(js_round((comp * F.lit(0.6) + F.col("r") / n / F.lit(5.0) * F.lit(0.4)) * F.lit(100.0)), F.lit(0.0), F.lit(100.0))
    return long.select(*keys, "key", "label", F.when(F.col("n") < 5, F.lit(60.0)).otherwise(score).alias("score"),
                       F.col("n").alias("sample_size"), (F.col("n") < 5).alias("low_sample"))


def health_overall(scores: DataFrame, group_cols=PLACE) -> DataFrame:
    return scores.groupBy(*group_cols).agg(js_round(F.avg("score")).alias("overall"))


def benchmark_pivot(df: DataFrame, place: str = "place_id") -> DataFrame:
    """Places side by side: one row per place, one column per sub-score, plus the overall score."""
    s = health_score(df, [place])
    return s.groupBy(place).pivot("key", [k for k, _ in lx.HEALTH_KEYS]).agg(F.first("score")).join(health_overall(s, [place]), place)


def rating_drivers(df: DataFrame, group_cols=PLACE) -> DataFrame:
    """Share of each category among 5-star minus its share among 1-star reviews (multi-label)."""
    keys = list(group_cols)
    five, one = F.col("rating") == 5, F.col("rating") == 1
    totals = df.groupBy(*keys).agg(count_where(five).alias("_t5"), count_where(one).alias("_t1"))
    c = tx.exploded(df, "categories", [*keys, "rating"], "category").groupBy(*keys, "category").agg(
        count_where(five).alias("_c5"), count_where(one).alias("_c1"))
    s5 = F.when(F.col("_t5") == 0, F.lit(0.0)).otherwise(F.col("_c5") / F.col("_t5"))
    s1 = F.when(F.col("_t1") == 0, F.lit(0.0)).otherwise(F.col("_c1") / F.col("_t1"))
    j = c.join(totals, keys) if keys else c.join(F.broadcast(totals))
    return j.select(*keys, "category", s5.alias("share_in_5_star"), s1.alias("share_in_1_star"), (s5 - s1).alias("differential"))


def top_keywords(df: DataFrame, group_cols, n: int) -> DataFrame:
    """Most frequent keywords per group, ties by first occurrence."""
    keys = list(group_cols)
    kw = tx.exploded(df, "keywords", [*keys, "review_id"], "keyword", "pos")
    c = kw.groupBy(*keys, "keyword").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("review_id", "pos")).alias("first"))
    w = W.partitionBy(*keys).orderBy(F.desc("n"), F.asc("first"))
    return c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).drop("first")


def topic_distribution(df: DataFrame, group_cols=PLACE, n_keywords: int = 8) -> DataFrame:
    """Per single-label category: counts, shares, top keywords and a representative quote."""
    keys = [*group_cols, "issue_category"]
    key = F.struct(quote_score(), -F.col("review_id"))
    base = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("review_count"), share(pos()).alias("positive_share"), share(F.col("sentiment") == "NEUTRAL").alias("neutral_share"),
        share(neg()).alias("negative_share"), F.avg("rating").alias("_ar"),
        F.max_by(F.struct("review_id", "author_name", "review_text", "design_requirement"), key).alias("_q"), F.min("review_id").alias("first_seq"),
    )
    kw = top_keywords(df, keys, n_keywords).groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "keyword"))), lambda x: x["keyword"]).alias("top_keywords"))
    return base.join(kw, keys, "left").select(
        *keys, "review_count", "positive_share", "neutral_share", "negative_share", js_round("_ar", 1).alias("avg_rating"),
        F.coalesce("top_keywords", F.array().cast("array<string>")).alias("top_keywords"), F.col("_q.review_id").alias("quote_id"),
        F.col("_q.author_name").alias("quote_author"), F.col("_q.review_text").alias("quote"), F.col("_q.design_requirement").alias("design_implication"), "first_seq")


def with_personas(df: DataFrame, personas=None) -> DataFrame:
    """array<string> of the personas a review speaks for (0 or more)."""
    low = F.lower(F.coalesce("review_text", F.lit("")))
    df = df.withColumn("_plow", low)
    return df.withColumn("personas", tx.labels_matched("_plow", [(p, w) for p, _, w in personas or lx.PERSONAS])).drop("_plow")


def persona_label():
    m = F.create_map(*[F.lit(x) for pid, label, _ in lx.PERSONAS for x in (pid, label)])
    return F.element_at(m, F.col("persona"))


def _persona_categories(df: DataFrame, keys) -> DataFrame:
    """One row per persona and category: the compact base of the persona analyses."""
    ex = tx.exploded(with_personas(df), "personas", [*keys, "review_id", "issue_category", "sentiment", "category_confidence", "author_name",
                                                     "review_text", "design_requirement"], "persona")
    qkey = F.struct(pos().cast("int"), quote_score(), -F.col("review_id"))
    return ex.groupBy(*keys, "persona", "issue_category").agg(
        F.count(F.lit(1)).alias("n"), count_where(neg()).alias("neg"), F.min("review_id").alias("first_seq"),
        F.min_by("design_requirement", "review_id").alias("first_advice"),
        F.max(qkey).alias("_k"), F.max_by(F.struct("review_id", "author_name", "review_text"), qkey).alias("_q"))


def persona_analytics(df: DataFrame, group_cols=PLACE) -> DataFrame:
    """Per persona: review count, top needs and complaints, positive quote, suggested intervention."""
    keys = [*group_cols, "persona"]
    base = _persona_categories(df, list(group_cols))
    # At most one entry per lexicon category is collected for a persona.
    g = base.groupBy(*keys).agg(
        F.sum("n").alias("review_count"),
        F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col("first_seq").alias("s"), F.col("issue_category").alias("c")))).alias("_needs"),
        F.sort_array(F.collect_list(F.when(F.col("n") >= 2, F.struct((-(F.col("neg") / F.col("n"))).alias("o"), F.col("first_seq").alias("s"),
                     F.col("issue_category").alias("c"), F.col("first_advice").alias("a"))))).alias("_compl"),
        F.min_by("first_advice", "first_seq").alias("_any"), F.max_by("_q", "_k").alias("_q"), F.min("first_seq").alias("first_seq"))
    top = F.slice("_compl", 1, 3)
    return g.select(
        *keys, persona_label().alias("label"), "review_count",
        F.transform(F.slice("_needs", 1, 3), lambda x: x["c"]).alias("primary_needs"),
        F.transform(top, lambda x: x["c"]).alias("top_complaints"), F.transform(top, lambda x: -x["o"]).alias("complaint_shares"),
        F.col("_q.review_id").alias("quote_id"), F.col("_q.author_name").alias("quote_author"), F.col("_q.review_text").alias("positive_quote"),
        F.coalesce(F.get("_compl", F.lit(0))["a"], F.col("_any")).alias("suggested_intervention"), "first_seq")


def opportunity_interventions(df: DataFrame, group_cols=PLACE, catalogue=None) -> DataFrame:
    """Curated interventions scored by the issue impact of their category."""
    keys = list(group_cols)
    imp = issue_impact(df, keys).select(*keys, F.col("issue_category").alias("category"), "mentions", "priority_index", "priority")
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("id", "label", "category", "cost", "maintenance", "difficulty"), r)])
                     for r in catalogue or lx.INTERVENTIONS])
    if keys:
        spine = imp.select(*keys).distinct().select(*keys, F.inline(rows))
    else:
        spine = df.sparkSession.range(1).select(F.inline(rows))
    j = spine.join(imp, [*keys, "category"], "left")
    low = F.col("mentions").isNull() | (F.col("mentions") < 3)
    return j.select(
        *keys, "id", "label", "category", F.when(low, F.lit(20.0)).otherwise(F.col("priority_index")).alias("score"),
        F.when(low, F.lit("Low")).otherwise(F.col("priority")).alias("expected_impact"), "cost", "maintenance", "difficulty",
        F.coalesce("mentions", F.lit(0)).cast("long").alias("supporting_mentions"), low.alias("insufficient_data"))


def cost_to_number(level):
    return F.when(level == "Low", 20).when(level == "Medium", 55).otherwise(85)


def place_layer_metrics(df: DataFrame, place: str = "place_id") -> DataFrame:
    """Nine map layers per place, min-max normalised across places."""
    cat = F.col("issue_category")
    agg = [F.count(F.lit(1)).cast("double").alias("reviewDensity"), (F.avg(sign()) * 100).alias("sentimentDensity")]
    for layer, c in lx.LAYER_CATEGORIES:
        agg.append(F.coalesce(F.try_divide(count_where((cat == c) & neg()) , count_where(cat == c)) * 100, F.lit(0.0)).alias(layer))
    agg.append((share(cat == "landscape / greenery") * 100).alias("greeneryMentions"))
    layers = ["reviewDensity", "sentimentDensity", *[x for x, _ in lx.LAYER_CATEGORIES], "greeneryMentions"]
    long = df.groupBy(place).agg(*agg).unpivot(place, layers, "layer", "value")
    stats = long.groupBy("layer").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    rng = F.when(F.col("_hi") == F.col("_lo"), F.lit(1.0)).otherwise(F.col("_hi") - F.col("_lo"))
    return long.join(F.broadcast(stats), "layer").select(place, "layer", "value", ((F.col("value") - F.col("_lo")) / rng).alias("normalized"))  # 9 rows


SEASON_DIMS = ("season", "ramadan", "day_type", "posting_time")


def seasonal_breakdown(df: DataFrame, dims=SEASON_DIMS, group_cols=()) -> DataFrame:
    """Counts, ratings and complaint shares per label of each calendar dimension, in one pass."""
    keys = [*group_cols, "dimension", "bucket"]
    d = with_season_labels(df.filter(F.col("published_ts").isNotNull()))
    cat = F.col("issue_category")
    d = d.withColumn("_event", tx.text_matches_any("review_text", lx.COMMUNITY_WORDS))
    long = d.select(*group_cols, "rating", "sentiment", "issue_category", "_event",
                    F.inline(F.array(*[F.struct(F.lit(x).alias("dimension"), F.col(x).alias("bucket")) for x in dims])))

    def neg_share(c):
        return js_round(F.coalesce(F.try_divide(count_where((cat == c) & neg()), count_where(cat == c)), F.lit(0.0)) * 100)

    return long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("review_count"), js_round(F.avg("rating"), 1).alias("avg_rating"),
        js_round((F.avg(sign()) + 1.0) / 2.0 * 100.0).alias("sentiment_score"), neg_share("shade / heat comfort").alias("heat_complaints_pct"),
        neg_share("crowding").alias("crowding_pct"), js_round(share(F.col("_event")) * 100.0).alias("event_mentions_pct"))


def cleaning_summary(df: DataFrame, group_cols=PLACE) -> DataFrame:
    """Totals, blanks, exact duplicates (author and text), very short and mismatched reviews.

    Duplicates are counted on a 256-bit digest, so long texts are not shuffled.
    """
    keys = list(group_cols)
    txt = F.coalesce("review_text", F.lit(""))
    trimmed = tx.js_trim(txt)
    digest = F.unhex(F.sha2(tx.js_trim(F.lower(F.concat_ws("|", F.col("author_name"), txt))), 256))
    d = sentence_profile(df).select(*keys, digest.alias("_d"), F.length(trimmed).alias("_len"), mismatch_flag().alias("_mm"))
    per = d.groupBy(*keys, "_d").agg(F.count(F.lit(1)).alias("n"), count_where(F.col("_len") > 0).alias("v"), count_where(F.col("_len") < 15).alias("s"),
                                     count_where(F.col("_mm")).alias("m"))
    return per.groupBy(*keys).agg(
        F.sum("n").alias("total_raw"), F.sum("v").alias("valid_reviews"), (F.sum("n") - F.count(F.lit(1))).alias("duplicates"),
        F.sum("s").alias("very_short"), F.sum("m").alias("flagged"))


def median_rating(df: DataFrame, keys, out: str = "_median") -> DataFrame:
    """The rating at place n div 2 of the sorted non-null ratings, for any scale.

    Equal ratings are counted before the shuffle, so the window sees distinct ratings only.
    """
    by = [F.lit(0).alias("_one")] if not keys else list(keys)
    names = ["_one"] if not keys else list(keys)
    c = df.filter(F.col("rating").isNotNull()).groupBy(*by, F.col("rating").cast("double").alias("_r")).agg(F.count(F.lit(1)).alias("_c"))
    w = W.partitionBy(*names)
    c = c.withColumns({"_upto": F.sum("_c").over(w.orderBy("_r").rowsBetween(W.unboundedPreceding, W.currentRow)), "_all": F.sum("_c").over(w)})
    return c.filter(F.col("_upto") > F.floor(F.col("_all") / F.lit(2))).groupBy(*names).agg(F.min("_r").alias(out)).drop("_one")


def nlp_kpis(df: DataFrame, group_cols=PLACE) -> DataFrame:
    """Review KPI table in long form: key, value."""
    keys = list(group_cols)
    low = F.lower(F.coalesce("review_text", F.lit("")))
    d = df.withColumn("_low", low)
    n = F.count(F.lit(1))
    agg = [n.alias("_n"), F.avg("rating").alias("_avg"), F.avg(sign()).alias("_sc"), share(pos()).alias("_p"), share(neg()).alias("_g"),
           share(F.col("sentiment") == "NEUTRAL").alias("_u"), count_where(F.col("issue_category") != lx.DEFAULT_CATEGORY).alias("actionableReviews"),
           count_where(pos()).alias("praiseReviews"), F.size(F.collect_set("issue_category")).alias("_div"), F.avg("category_confidence").alias("_cf")]
    agg += [count_where(F.array_contains("categories", c)).alias(k) for k, c in lx.MENTION_TOPICS]
    agg += [count_where(tx.contains_any(F.col("_low"), w)).alias(k) for k, w in lx.MENTION_GROUPS]
    g = d.groupBy(*keys).agg(*agg) if keys else d.agg(*agg)
    m = median_rating(df, keys)
    g = g.join(m, keys, "left") if keys else g.join(F.broadcast(m), how="left")  # one row
    vals = {
        "totalReviews": F.col("_n"), "avgRating": js_round("_avg", 1), "medianRating": F.col("_median"),
        "positiveShare": js_round(F.col("_p") * 1000.0) / 10.0, "neutralShare": js_round(F.col("_u") * 1000.0) / 10.0, "negativeShare": js_round(F.col("_g") * 1000.0) / 10.0,
        "overallSentimentScore": js_round((F.col("_sc") + 1.0) / 2.0 * 100.0), "actionabilityScore": js_round(F.col("actionableReviews") / F.col("_n") * 100.0),
        "issueDiversityScore": js_round(F.col("_div") / F.lit(20.0) * 100.0), "topicConfidence": js_round(F.col("_cf") * 100.0),
    }
    g = g.withColumns(vals)
    names = [*vals, "actionableReviews", "praiseReviews", *[k for k, _ in lx.MENTION_TOPICS], *[k for k, _ in lx.MENTION_GROUPS]]
    return g.select(*keys, *[F.col(x).cast("double").alias(x) for x in names]).unpivot(keys, names, "key", "value")


def topic_analysis(df: DataFrame, group_cols=PLACE) -> DataFrame:
    """Per multi-label category: single-label count, mentions, shares, rating and monthly trend.

    One explode feeds both the totals and the monthly series: counts are kept per month
    and rolled up.
    """
    keys = [*group_cols, "category"]
    ex = tx.exploded(df, "categories", [*group_cols, "rating", "sentiment", period_key("published_ts", "month").alias("period"),
                                        F.col("issue_category").alias("_single")], "category")
    m = ex.groupBy(*keys, "period").agg(F.count(F.lit(1)).alias("n"), count_where(pos()).alias("p"), count_where(neg()).alias("g"),
                                        F.sum("rating").alias("r"), count_where(F.col("_single") == F.col("category")).alias("single"))
    tot = m.groupBy(*keys).agg(F.sum("single").alias("review_count"), F.sum("n").alias("mentions"), js_round(F.sum("p") / F.sum("n") * 100.0).alias("positive_pct"),
                               js_round(F.sum("g") / F.sum("n") * 100.0).alias("negative_pct"), js_round(F.sum("r") / F.sum("n"), 1).alias("avg_rating"))
    tr = series_trend(m.filter(F.col("period").isNotNull()), keys, "period", "n", 2)
    return tot.join(tr, keys, "left").select(
        *keys, "review_count", "mentions", "positive_pct", "negative_pct", "avg_rating", F.coalesce("trend", F.lit("flat")).alias("trend"),
        F.coalesce("trend_pct", F.lit(0.0)).alias("trend_pct"), (F.coalesce("n_points", F.lit(0)) >= 2).alias("has_date_trend"))


def complaint_intelligence(df: DataFrame, group_cols=PLACE) -> DataFrame:
    """Issues with negative mentions: severity, affected personas, intervention, confidence, trend."""
    keys = [*group_cols, "issue_category"]
    first_neg = F.struct((~neg()).cast("int"), F.col("review_id"))
    # One pass over the reviews: counts per category and month, from which impact, advice and trend follow.
    base = df.groupBy(*keys, period_key("published_ts", "month").alias("period")).agg(
        F.count(F.lit(1)).alias("n"), count_where(neg()).alias("neg"), F.sum(F.col("rating").cast("double")).alias("rating_sum"),
        F.min("review_id").alias("first_seq"), F.min(F.struct(first_neg.alias("o"), F.col("design_requirement").alias("a"))).alias("_adv"))
    per_cat = base.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("neg").alias("neg"), F.sum("rating_sum").alias("rating_sum"),
                                      F.min("first_seq").alias("first_seq"), F.min("_adv").alias("_adv"))
    imp = _impact_from_counts(per_cat, list(group_cols)).withColumn("suggested_intervention", F.col("_adv.a"))
    imp = imp.filter((F.col("negative_share") > 0) & (F.col("issue_category") != lx.DEFAULT_CATEGORY))
    tr = series_trend(base.filter(F.col("period").isNotNull()), keys, "period", "n", 2)
    order = F.create_map(*[F.lit(x) for i, (pid, _, _) in enumerate(lx.PERSONAS) for x in (pid, i)])
    pers = persona_analytics(df, group_cols).select(*group_cols, "label", "review_count", F.element_at(order, F.col("persona")).alias("_po"),
                                                    F.explode("top_complaints").alias("issue_category"))
    pers = pers.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("review_count"), "_po", "label"))), lambda x: x["label"]).alias("affected_personas"))
    j = imp.join(tr, keys, "left").join(pers, keys, "left")
    sev = band(F.col("priority_index"), lx.SEVERITY_CUTS, "Low")
    rank = F.when(sev == "Critical", 4).when(sev == "High", 3).when(sev == "Medium", 2).otherwise(1)
    out = j.select(
        *keys, sev.alias("severity"), rank.alias("severity_rank"), "mentions", js_round(F.col("negative_share") * 100.0).alias("negative_pct"), "avg_rating",
        F.coalesce("affected_personas", F.array().cast("array<string>")).alias("affected_personas"), "suggested_intervention",
        F.least(F.lit(95), F.lit(40) + F.col("mentions") * 2).cast("double").alias("confidence"), F.coalesce("trend", F.lit("flat")).alias("recent_trend"),
        "priority_index", "first_seq")
    w = W.partitionBy(*group_cols).orderBy(F.desc("severity_rank"), F.desc("mentions"), F.desc("priority_index"), F.asc("first_seq"))
    return out.withColumn("rank", F.row_number().over(w))


def positive_features(df: DataFrame, group_cols=PLACE) -> DataFrame:
    """Specific topics with praise, ranked by praise share times mentions; avg_rating is the real mean."""
    t = topic_distribution(df, group_cols).filter((F.col("positive_share") > 0) & (F.col("issue_category") != lx.DEFAULT_CATEGORY))
    t = t.withColumn("positive_pct", js_round(F.col("positive_share") * 100.0))
    w = W.partitionBy(*group_cols).orderBy(F.desc(F.col("positive_pct") * F.col("review_count")), F.desc("review_count"), F.asc("first_seq"))
    return t.select(*group_cols, "issue_category", F.col("review_count").alias("mentions"), "positive_pct", "avg_rating", "quote_id", "quote", "quote_author",
                    F.row_number().over(w).alias("rank"))


def persona_visit_times(df: DataFrame, group_cols=PLACE) -> DataFrame:
    keys = [*group_cols, "persona"]
    d = with_personas(df).withColumn("_low", F.lower("review_text"))
    ex = tx.exploded(d, "personas", [*group_cols, *[tx.contains_any(F.col("_low"), w).alias(f"_t{i}") for i, (_, w) in enumerate(lx.VISIT_TIMES)]], "persona")
    g = ex.groupBy(*keys).agg(*[count_where(F.col(f"_t{i}")).alias(f"_c{i}") for i in range(len(lx.VISIT_TIMES))])
    best = F.greatest(*[F.col(f"_c{i}") for i in range(len(lx.VISIT_TIMES))])
    label = None
    for i, (name, _) in enumerate(lx.VISIT_TIMES):
        label = F.when(F.col(f"_c{i}") == best, F.lit(name)) if label is None else label.when(F.col(f"_c{i}") == best, F.lit(name))
    return g.select(*keys, best.alias("visit_mentions"),
                    F.when(best >= 3, label).otherwise(F.lit("Not enough time-of-day evidence")).alias("likely_visit_time"),
                    F.when(best >= 8, F.lit("Medium")).when(best >= 3, F.lit("Low")).otherwise(F.lit("N/A")).alias("visit_time_confidence"))


def user_group_insights(df: DataFrame, group_cols=PLACE) -> DataFrame:
    keys = [*group_cols, "persona"]
    return persona_analytics(df, group_cols).join(persona_visit_times(df, group_cols), keys)


def activity_patterns(df: DataFrame, group_cols=PLACE) -> DataFrame:
    """Mentions of eight time-of-day and day-of-week vocabularies."""
    keys = list(group_cols)
    d = df.withColumn("_low", F.lower(F.coalesce("review_text", F.lit(""))))
    agg = [F.count(F.lit(1)).alias("_n"), *[count_where(tx.contains_any(F.col("_low"), w)).alias(k) for k, _, w in lx.ACTIVITY_TIMES]]
    g = d.groupBy(*keys).agg(*agg) if keys else d.agg(*agg)
    names = [k for k, _, _ in lx.ACTIVITY_TIMES]
    return g.unpivot([*keys, "_n"], names, "key", "mention_count").select(
        *keys, "key", "mention_count", (js_round(F.col("mention_count") / F.col("_n") * 1000.0) / 10.0).alias("mention_share_pct"))


def park_stats(df: DataFrame, place: str = "place_id") -> DataFrame:
    """Mean of the place ratings, best and worst place, and the most frequent issue among poor reviews."""
    per = df.groupBy(place, "issue_category").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("rating").cast("double")).alias("r"), F.min("review_id").alias("s"),
        count_where(neg() | (F.col("rating") <= 3)).alias("poor"),
        F.min(F.when(neg() | (F.col("rating") <= 3), F.col("review_id"))).alias("poor_first"))
    places = per.groupBy(place).agg((F.sum("r") / F.sum("n")).alias("avg"), F.min("s").alias("s"))
    top = places.agg(js_round(F.avg("avg"), 2).alias("avg_rating"), F.max_by(place, F.struct("avg", -F.col("s"))).alias("best_place"),
                     F.min_by(place, F.struct("avg", -F.col("s"))).alias("worst_place"))
    issue = per.groupBy("issue_category").agg(F.sum("poor").alias("n"), F.min("poor_first").alias("s")).filter(F.col("n") > 0).agg(
        F.max_by("issue_category", F.struct("n", -F.col("s"))).alias("_i"))
    issue = issue.select(F.when(F.col("_i") == lx.DEFAULT_CATEGORY, "Landscape Shading").otherwise(F.coalesce("_i", F.lit("Landscape Density"))).alias("top_issue"))
    return F.broadcast(top).join(F.broadcast(issue), how="inner")  # one row each


def issue_counts(df: DataFrame, group_cols=()) -> DataFrame:
    return df.groupBy(*group_cols, "issue_category").agg(F.count(F.lit(1)).alias("n"))


def issue_sentiment_stack(df: DataFrame) -> DataFrame:
    return df.groupBy("issue_category").pivot("sentiment", ["POSITIVE", "NEUTRAL", "NEGATIVE"]).agg(F.count(F.lit(1))).fillna(0)


def keyword_frequencies(df: DataFrame, n: int | None = None) -> DataFrame:
    kw = tx.exploded(df, "keywords", ["review_id"], "keyword", "pos").groupBy("keyword").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("review_id", "pos")).alias("first"))
    if n:
        kw = kw.orderBy(F.desc("n"), F.asc("first")).limit(n)
    return kw.drop("first")


STATUS_CUTS = [(80, "VERY POSITIVE"), (60, "POSITIVE"), (40, "MIXED"), (20, "NEGATIVE")]


def exec_summary(df: DataFrame, group_cols=PLACE) -> DataFrame:
    """One headline row per group, composed of the section operators."""
    keys = list(group_cols)
    base = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("reviews_analyzed"), js_round(F.avg("rating"), 1).alias("average_rating"),
                                 js_round((F.avg(sign()) + 1.0) / 2.0 * 100.0).alias("satisfaction_score"))
    comp = complaint_intelligence(df, keys)
    top = comp.groupBy(*keys).agg(F.min_by("issue_category", "rank").alias("top_negative_topic"), F.min_by("suggested_intervention", "rank").alias("most_requested_improvement"),
                                  F.min_by("issue_category", F.struct((F.col("severity") != "Critical").cast("int"), "rank")).alias("critical_issue_cluster"))
    posf = positive_features(df, keys).filter(F.col("rank") == 1).select(*keys, F.col("issue_category").alias("top_positive_topic"))
    order = F.create_map(*[F.lit(x) for i, (pid, _, _) in enumerate(lx.PERSONAS) for x in (pid, i)])
    pers = persona_analytics(df, keys).groupBy(*keys).agg(F.max_by("label", F.struct("review_count", -F.element_at(order, F.col("persona")))).alias("top_user_group"))
    j = base.join(top, keys, "left").join(posf, keys, "left").join(pers, keys, "left")
    none = F.lit("Insufficient data")
    return j.select(*keys, "reviews_analyzed", "average_rating", band(F.col("satisfaction_score"), STATUS_CUTS, "VERY NEGATIVE").alias("overall_sentiment"),
                    F.coalesce("top_positive_topic", none).alias("top_positive_topic"), F.coalesce("top_negative_topic", none).alias("top_negative_topic"),
                    F.coalesce("most_requested_improvement", none).alias("most_requested_improvement"), F.coalesce("top_user_group", none).alias("top_user_group"),
                    F.coalesce("critical_issue_cluster", F.lit("None identified")).alias("critical_issue_cluster"), "satisfaction_score")


def review_summary(df: DataFrame, group_cols=PLACE) -> dict[str, DataFrame]:
    """Report sections, each a tidy table: top 8 topics, 8 complaints, 6 personas and the rest."""
    keys = list(group_cols)

    def ranked(t, n, *order):
        return t.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)

    return {
        "summary": exec_summary(df, keys), "kpis": nlp_kpis(df, keys), "cleaning": cleaning_summary(df, keys),
        "topics": ranked(topic_distribution(df, keys), 8, F.desc("review_count"), F.asc("first_seq")),
        "complaints": complaint_intelligence(df, keys).filter(F.col("rank") <= 8),
        "positive_features": positive_features(df, keys).filter(F.col("rank") <= 8),
        "personas": ranked(user_group_insights(df, keys), 6, F.desc("review_count"), F.asc("persona")),
        "temporal": seasonal_breakdown(df, group_cols=keys), "activity": activity_patterns(df, keys),
    }


def design_requirement_matrix(complaints: DataFrame, context: DataFrame, group_cols=PLACE, n: int = 12) -> DataFrame:
    """Top complaints against site evidence.  ``context``: the group keys, avg_heat, avg_green, avg_walk, avg_access."""
    j = complaints.filter(F.col("rank") <= n)
    missing = set(group_cols) - set(context.columns)
    if missing:
        raise ValueError(f"site evidence lacks the keys {sorted(missing)}")
    j = j.join(context, list(group_cols), "left")
    cat, sev = F.col("issue_category"), F.col("severity")
    heat = (cat == "shade / heat comfort") & (F.coalesce("avg_heat", F.lit(0.0)).__ge__(55) | (F.coalesce("avg_green", F.lit(100.0)) < 10))
    play = (cat == "playground") & (F.coalesce("avg_access", F.lit(100.0)) < 50)
    walk = cat.isin("accessibility", "parking") & (F.coalesce("avg_walk", F.lit(0.0)) > 20)
    hit = any_of([heat, play, walk])
    prio = (F.when(sev == "Critical", "Must Have").when((sev == "High") & hit, "Must Have").when(sev == "High", "High Priority")
            .when(sev == "Medium", "Medium Priority").otherwise("Optional"))
    return j.select(*group_cols, F.concat(F.lit("REQ-"), F.lpad(F.col("rank").cast("string"), 3, "0")).alias("id"), cat.alias("topic"), sev,
                    hit.alias("site_reinforced"), prio.alias("priority_class"), F.col("mentions").alias("evidence_count"), "confidence")
