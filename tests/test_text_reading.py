"""Category and sentiment rules read a text once and frame none."""

import random
import re

from pyspark.sql import functions as F

from sylvan.functions import lexicon as lx
from sylvan.functions import text as tx
from sylvan.operators.enrich import enrich_reviews

WORDS = [w for _, ws, _ in lx.ISSUE_LEXICON for w in ws] + lx.POSITIVE_WORDS + lx.NEGATIVE_WORDS


def scores(text):
    out = []
    for _, ws, _ in lx.ISSUE_LEXICON:
        out.append(sum(1 + bool(re.search(f"(?<![A-Za-z0-9_]){re.escape(k)}(?![A-Za-z0-9_])", text)) for k in dict.fromkeys(ws) if k in text))
    return out


def test_scores_and_hits_by_brute_force(spark):
    rnd = random.Random(4)
    texts = []
    for _ in range(400):
        parts = [rnd.choice(WORDS)[rnd.choice([0, 0, 0, 1]):] + rnd.choice(["", "s", "_", "é", "."]) for _ in range(rnd.randrange(12))]
        texts.append(rnd.choice([" ", "  ", "", "-", "\n", "\u00e9"]).join(parts))
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "i int, review_text string, rating int")
    hits = tx.sentiment_hits("review_text", tx.rule_words("review_text"))
    for r in df.select("i", tx.category_scores("review_text").alias("s"), tx.category_scores("review_text", found=tx.rule_words("review_text")).alias("s2"), hits.alias("h")).collect():
        low = texts[r["i"]].lower()
        assert r["s"] == r["s2"] == scores(low), low
        assert r["h"]["pos"] == sum(w in low for w in dict.fromkeys(lx.POSITIVE_WORDS)) and r["h"]["neg"] == sum(w in low for w in dict.fromkeys(lx.NEGATIVE_WORDS))


def test_text_is_read_once(spark):
    df = spark.createDataFrame([(1, "The toilet was dirty", 3)], "i int, review_text string, rating int")
    plan = enrich_reviews(df).select("issue_category", "sentiment")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "regexp_replace" not in plan


def test_words_with_marks_keep_the_frame(spark):
    df = spark.createDataFrame([("an e-bike here, bike lane",)], "t string")
    lexicon = [("a", ["e-bike", "bike"], "x"), ("b", [".lane", "lane"], "y")]
    assert df.select(tx.category_scores("t", lexicon).alias("s")).first()["s"] == [3, 2]
    assert df.select(F.size(tx.found_words(F.col("t"), ["^a", "]b", "bike", "e-bike", "-", "h", "i", "j", "k", "l"])).alias("n")).first()["n"] == 7
