"""Hand-computed fixtures for the text rules, time buckets and review aggregates."""

from pyspark.sql import functions as F

from sylvan.functions import text as tx
from sylvan.functions.numeric import js_round, truthy_or
from sylvan.operators import enrich, filters, reviews, timeseries


def one(spark, expr, text):
    return spark.createDataFrame([(text,)], "t string").select(expr).first()[0]


def rows(spark, items):
    """items: (id, place, rating, text, date)"""
    return enrich.enrich_reviews(spark.createDataFrame([(i, p, f"Place {p}", f"a{i}", r, t, d) for i, p, r, t, d in items],
                                                       "review_id long, place_id string, park_name string, author_name string, rating int, review_text string, published_at string"))


def test_rounding_goes_up_on_ties(spark):
    d = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "x double")
    assert [r[0] for r in d.select(js_round("x")).collect()] == [1.0, 2.0, 3.0, 0.0]
    assert spark.range(1).select(js_round(F.lit(1.005), 2), js_round(F.lit(0.285), 2)).first() == (1.0, 0.28)


def test_truthy_default(spark):
    d = spark.createDataFrame([(None,), (0.0,), (float("nan"),), (2.0,)], "x double")
    assert [r[0] for r in d.select(truthy_or("x", 7.0)).collect()] == [7.0, 7.0, 7.0, 2.0]


def test_tie_takes_the_earlier_category_and_whole_words_count_twice(spark):
    assert one(spark, tx.classify_issue("t")["category"], "clean bench") == "cleanliness"
    assert one(spark, tx.classify_issue("t")["score"], "a cat") == 2
    assert one(spark, tx.classify_issue("t")["score"], "location") == 1
    assert one(spark, tx.classify_issue("t")["score"], "catégorie") == 2  # the boundary is ASCII: 'cat' before an accented letter is a word
    assert one(spark, tx.classify_issue("t")["category"], "nothing here at all") == "general landscape"


def test_phrase_needs_single_spaces(spark):
    scores = lambda t: one(spark, tx.category_scores("t"), t)
    safety = 4
    assert scores("kid safe")[safety] == 4 and scores("kid, safe")[safety] == 2


def test_keywords_order(spark):
    assert one(spark, tx.extract_keywords("t"), "green lawn 2024 lawn 1999 trees") == ["lawn", "1999", "2024", "green", "trees"]
    assert one(spark, tx.extract_keywords("t"), "") == []


def test_tokenisers_differ_on_punctuation(spark):
    assert one(spark, tx.extract_keywords("t"), "well-kept") == ["wellkept"]
    assert one(spark, tx.tokenize_light("t"), "well-kept 'no shade'") == ["well", "kept", "no", "shade"]


def test_sentences_and_mismatch(spark):
    assert one(spark, tx.split_sentences("t"), "Great park!  Too hot. ok") == ["Great park!", "Too hot."]
    d = rows(spark, [(1, "p", 5, "It is dirty. Bad smell.", None), (2, "p", 1, "Wonderful place.", None), (3, "p", 5, "Wonderful place.", None)])
    got = {r.review_id: r.negative_sentence_share for r in enrich.rating_sentiment_mismatch(d).collect()}
    assert got == {1: 1.0, 2: 0.0}


def test_sentiment_rules(spark):
    d = rows(spark, [(1, "p", 4, "hot dirty poor", None), (2, "p", 4, "good but hot", None), (3, "p", 2, "great", None), (4, "p", 3, "great", None), (5, "p", 3, "bad", None), (6, "p", 3, "so so", None)])
    assert [r.sentiment for r in d.orderBy("review_id").collect()] == ["NEUTRAL", "POSITIVE", "NEGATIVE", "POSITIVE", "NEGATIVE", "NEUTRAL"]


def buckets(spark, dates):
    d = rows(spark, [(i, "p", 3, "x", v) for i, v in enumerate(dates)])
    return [(r.review_id, r.bucket, r.time_basis) for r in timeseries.bucket_by_time(d).orderBy("review_id").collect()]


def test_nine_rows_leave_empty_buckets(spark):
    got = buckets(spark, [None] * 9)
    assert [b for _, b, _ in got] == [0, 0, 1, 1, 2, 2, 3, 3, 4] and {t for _, _, t in got} == {"sequence"}


def test_calendar_needs_eighty_percent(spark):
    days = [f"2024-01-{31 - i:02d}T00:00:00Z" for i in range(10)]
    assert {t for _, _, t in buckets(spark, days[:8] + [None, None])} == {"calendar"}
    assert {t for _, _, t in buckets(spark, days[:7] + [None, None, None])} == {"sequence"}
    assert buckets(spark, days[:8] + [None, None])[0][1] == 3  # the latest of eight dates comes fourth from the end


def test_kpis_keep_empty_buckets(spark):
    d = rows(spark, [(i, "p", 4, "great lawn", None) for i in range(9)])
    k = {r.kpi: r for r in reviews.kpis(d).collect()}
    assert k["totalReviews"].value == 9.0 and list(k["totalReviews"].sparkline) == [2, 2, 2, 2, 1, 0, 0, 0]
    assert k["sentimentScore"].sparkline[7] == 50.0 and k["totalReviews"].trend == "down"


def test_health_baseline_below_five(spark):
    base = [(i, "p", 5, "dirty bin", None) for i in range(4)]
    s = {r.key: (r.score, r.low_sample) for r in reviews.health_score(rows(spark, base)).collect()}
    assert s["maintenance"] == (60.0, True)
    s = {r.key: (r.score, r.low_sample) for r in reviews.health_score(rows(spark, base + [(9, "p", 5, "dirty bin", None)])).collect()}
    assert s["maintenance"] == (100.0, False)


def test_issue_impact_numbers(spark):
    d = rows(spark, [(1, "p", 1, "dirty", None), (2, "p", 5, "lawn", None), (3, "p", 1, "dirty", None), (4, "p", 4, "lawn", None)])
    got = {r.issue_category: (r.mentions, r.avg_rating, r.priority_index, r.priority) for r in reviews.issue_impact(d).collect()}
    assert got["cleanliness"] == (2, 1.0, 76.0, "Very High") and got["landscape / greenery"] == (2, 4.5, 22.0, "Low")


def test_trend_with_zero_start(spark):
    d = spark.createDataFrame([("g", 1, 0), ("g", 2, 5), ("h", 1, 0), ("h", 2, 0), ("i", 1, 4), ("i", 2, 4)], "g string, p int, v int")
    assert {r.g: (r.trend, r.trend_pct) for r in timeseries.series_trend(d, ["g"], "p", "v").collect()} == {"g": ("up", 100.0), "h": ("flat", 0.0), "i": ("flat", 0.0)}


def test_ramadan_and_weekend(spark):
    d = rows(spark, [(1, "p", 3, "x", "2024-03-11T05:00:00Z"), (2, "p", 3, "x", "2024-04-10T21:00:00Z"), (3, "p", 3, "x", "2024-07-06T12:00:00Z")])
    got = [(r.season, r.ramadan, r.day_type, r.posting_time) for r in timeseries.with_season_labels(d).orderBy("review_id").collect()]
    assert got == [("Winter", "Ramadan", "Weekday", "Morning"), ("Transitional", "Non-Ramadan", "Weekday", "Night"), ("Summer", "Non-Ramadan", "Weekend", "Afternoon")]


def test_shares_sum_to_one_and_search(spark):
    d = rows(spark, [(i, "p", 1 + i % 5, "shade and bench and cafe", None) for i in range(7)])
    r = reviews.sentiment_summary(d).first()
    assert abs(r.positive_share + r.neutral_share + r.negative_share - 1) < 1e-12
    assert filters.filter_reviews(d, search="A3").count() == 1 and filters.table_page(d, sort=[("rating", True)], size=3).count() == 3


def test_empty_input_keeps_schema(spark):
    d = rows(spark, [(1, "p", 3, "x", None)]).filter("review_id < 0")
    assert reviews.issue_impact(d).count() == 0 and reviews.persona_analytics(d).count() == 0
