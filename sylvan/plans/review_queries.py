"""Registered review queries with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..functions.numeric import js_round
from ..functions.session import written_table
from ..operators import enrich as en
from ..operators import filters as fl
from ..operators import ranking as rk
from ..operators import reviews as rv
from ..operators import text_mining as tm
from ..operators import timeseries as ts
from ..sources import adapters as ad
from .registry import query
from .sqlbase import ENRICHED, KEYWORDS, REVIEWS, any_like, enrich_ctes, hits, js, q, values_list, with_enriched


def enriched(spark, sf):
    return en.enrich_reviews(ad.reviews(spark, sf))


def enriched_table(spark, sf):
    """The enriched reviews as a written table, for queries that use them more than once."""
    return written_table(enriched(spark, sf))


def joined(c):
    return F.array_join(c, "|")


POSN = "CASE WHEN sentiment = 'POSITIVE' THEN 1 ELSE 0 END"
NEGN = "CASE WHEN sentiment = 'NEGATIVE' THEN 1 ELSE 0 END"
SIGN = "CASE WHEN sentiment = 'POSITIVE' THEN 1e0 WHEN sentiment = 'NEGATIVE' THEN -1e0 ELSE 0e0 END"


def share_sql(cond):
    return f"avg(CASE WHEN {cond} THEN 1e0 ELSE 0e0 END)"


def cnt_sql(cond):
    return f"CAST(count(*) FILTER (WHERE {cond}) AS BIGINT)"


# --- enrichment -----------------------------------------------------------------

@query("enriched_reviews", with_enriched(
    "SELECT review_id, place_id, pos_hits, neg_hits, sentiment, issue_category, topic, category_confidence, array_to_string(categories, '|') AS categories, md5(design_requirement) AS advice FROM enriched"))
def _(spark, sf):
    return enriched(spark, sf).select("review_id", "place_id", "pos_hits", "neg_hits", "sentiment", "issue_category", "topic", "category_confidence",
                                      joined("categories").alias("categories"), F.md5("design_requirement").alias("advice"))


@query("review_keywords", with_enriched(KEYWORDS[0:0] + f""", {KEYWORDS}
SELECT e.review_id, coalesce(k.ks, '') AS keywords FROM enriched e LEFT JOIN (SELECT review_id, string_agg(w, '|' ORDER BY kr) AS ks FROM kw GROUP BY review_id) k USING (review_id)""").replace("\n, tok", ", tok"))
def _(spark, sf):
    return enriched(spark, sf).select("review_id", joined("keywords").alias("keywords"))


@query("lexicon_hit_counts", f"WITH {REVIEWS} SELECT review_id, {hits('lower(review_text)', lx.POSITIVE_WORDS)} AS pos_hits, {hits('lower(review_text)', lx.NEGATIVE_WORDS)} AS neg_hits FROM reviews")
def _(spark, sf):
    h = ad.reviews(spark, sf).select("review_id", tx.sentiment_hits("review_text").alias("h"))
    return h.select("review_id", F.col("h.pos").alias("pos_hits"), F.col("h.neg").alias("neg_hits"))


@query("multi_label_categories", f"""WITH {REVIEWS} SELECT review_id, concat_ws('|', {', '.join(f"CASE WHEN {any_like('lower(review_text)', w)} THEN {q(n)} END" for n, w, _ in lx.ISSUE_LEXICON)}) AS categories FROM reviews""")
def _(spark, sf):
    return ad.reviews(spark, sf).select("review_id", joined(tx.match_all_categories("review_text")).alias("categories"))


@query("review_word_counts", f"WITH {REVIEWS} SELECT review_id, len(list_filter(regexp_split_to_array(review_text, {q(lx.WHITESPACE + '+')}), lambda w: w <> '')) AS words, length(review_text) AS chars FROM reviews")
def _(spark, sf):
    return ad.reviews(spark, sf).select("review_id", tx.word_count("review_text").cast("long").alias("words"), F.length("review_text").cast("long").alias("chars"))


@query("text_match_any", f"WITH {REVIEWS} SELECT place_id, {cnt_sql(any_like('lower(review_text)', lx.COMMUNITY_WORDS))} AS n FROM reviews GROUP BY place_id")
def _(spark, sf):
    return ad.reviews(spark, sf).groupBy("place_id").agg(rv.count_where(tx.text_matches_any("review_text", lx.COMMUNITY_WORDS)).alias("n"))


# RE2 has no look-behind, so sentence ends are marked before splitting.
SENT = f"""sent0 AS (SELECT review_id, place_id, rating, author_name, unnest(string_split(regexp_replace(review_text, {q('([.!?])' + lx.WHITESPACE + '+')}, {q(chr(92) + '1' + chr(1))}, 'g'), {q(chr(1))})) AS raw FROM enriched),
sent1 AS (SELECT * EXCLUDE (raw), regexp_replace(raw, {q('^' + lx.WHITESPACE + '+|' + lx.WHITESPACE + '+$')}, '', 'g') AS sentence FROM sent0),
sent AS (SELECT *, CASE WHEN {any_like('lower(sentence)', lx.POSITIVE_WORDS)} AND NOT {any_like('lower(sentence)', lx.NEGATIVE_WORDS)} THEN 'POSITIVE'
  WHEN {any_like('lower(sentence)', lx.NEGATIVE_WORDS)} AND NOT {any_like('lower(sentence)', lx.POSITIVE_WORDS)} THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS sentence_sentiment FROM sent1 WHERE length(sentence) > 3),
prof AS (SELECT review_id, count(*) AS ns, count(*) FILTER (WHERE sentence_sentiment = 'NEGATIVE') AS nn, count(*) FILTER (WHERE sentence_sentiment = 'POSITIVE') AS np FROM sent GROUP BY review_id),
flagged AS (SELECT e.review_id, e.place_id, e.author_name, e.rating, {js('nn / CAST(ns AS DOUBLE)', 2)} AS negative_sentence_share FROM enriched e JOIN prof USING (review_id)
  WHERE (rating >= 4 AND nn / CAST(ns AS DOUBLE) >= 0.5e0) OR (rating <= 2 AND nn = 0 AND np > 0))"""


@query("sentence_sentiment", with_enriched(f""", {SENT}
SELECT place_id, review_id, sentence_sentiment, count(*) AS n, CAST(sum(length(sentence)) AS BIGINT) AS chars FROM sent GROUP BY ALL""".lstrip()).replace("enriched AS (", "enriched AS (", 1))
def _(spark, sf):
    s = en.sentence_table(ad.reviews(spark, sf))
    return s.groupBy("place_id", "review_id", "sentence_sentiment").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("sentence")).alias("chars"))


@query("sentence_topics", with_enriched(f""", {SENT}, st AS (SELECT place_id, sentence_sentiment, unnest(list_filter([{', '.join(f"CASE WHEN {any_like('lower(sentence)', w)} THEN {q(n)} END" for n, w, _ in lx.ISSUE_LEXICON)}], lambda x: x IS NOT NULL)) AS category FROM sent)
SELECT place_id, category, sentence_sentiment, count(*) AS n FROM st GROUP BY ALL"""))
def _(spark, sf):
    s = en.sentence_table(ad.reviews(spark, sf))
    return tx.exploded(s, "topics", ["place_id", "sentence_sentiment"], "category").groupBy("place_id", "category", "sentence_sentiment").agg(F.count(F.lit(1)).alias("n"))


@query("rating_sentiment_mismatch", with_enriched(f", {SENT} SELECT * FROM flagged"))
def _(spark, sf):
    return en.rating_sentiment_mismatch(ad.reviews(spark, sf)).drop("review_text")


LABELS = """ext AS (SELECT doc_id AS review_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'POSITIVE' WHEN toxic = 1 THEN 'NEGATIVE' END AS s,
  CASE WHEN doc_id % 3 = 0 THEN 'seating' WHEN doc_id % 3 = 1 THEN 'safety' END AS c FROM labels)"""


@query("merge_external_labels", with_enriched(f""", {LABELS}
SELECT e.review_id, CASE WHEN x.review_id IS NOT NULL THEN coalesce(x.s, 'NEUTRAL') ELSE e.sentiment END AS sentiment,
 CASE WHEN x.review_id IS NOT NULL THEN coalesce(x.c, 'landscape / greenery') ELSE e.issue_category END AS issue_category,
 CASE WHEN x.review_id IS NOT NULL THEN 0.85e0 ELSE e.category_confidence END AS category_confidence,
 e.source || CASE WHEN x.review_id IS NOT NULL THEN ' (labelled)' ELSE ' (rules)' END AS source
FROM enriched e LEFT JOIN ext x USING (review_id)"""))
def _(spark, sf):
    lab = ad.external_labels(spark, sf).withColumn("confidence", F.lit(0.85))
    return en.merge_external_labels(enriched(spark, sf), lab).select("review_id", "sentiment", "issue_category", "category_confidence", "source")


LIGHT = f"""light AS (SELECT review_id, place_id, list_filter(regexp_split_to_array(translate(lower(review_text), {q(lx.LIGHT_PUNCT)}, {q(' ' * len(lx.LIGHT_PUNCT))}), {q(lx.WHITESPACE + '+')}),
  lambda w: w <> '' AND w NOT IN ({', '.join(q(w) for w in lx.LIGHT_STOP)})) AS toks FROM reviews)"""


@query("light_tokens", f"WITH {REVIEWS}, {LIGHT} SELECT review_id, CAST(len(toks) AS BIGINT) AS n, md5(array_to_string(toks, ' ')) AS digest FROM light")
def _(spark, sf):
    d = ad.reviews(spark, sf).select("review_id", tx.tokenize_light("review_text").alias("t"))
    return d.select("review_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


CHAT = """chat AS (SELECT conv_id*1000 + turn AS review_id, 'c' || (conv_id % 7) AS place_id, CAST(1 + (conv_id*3 + turn) % 5 AS INTEGER) AS rating, text AS review_text FROM conversations WHERE role = 'user')"""


@query("chat_issue_counts", f"WITH {CHAT}, {enrich_ctes('chat')} SELECT place_id, issue_category, sentiment, count(*) AS n FROM enriched GROUP BY ALL")
def _(spark, sf):
    return en.enrich_reviews(ad.chat_reviews(spark, sf)).groupBy("place_id", "issue_category", "sentiment").agg(F.count(F.lit(1)).alias("n"))


# --- filters --------------------------------------------------------------------

@query("filter_reviews", with_enriched("""SELECT review_id, place_id FROM enriched WHERE sentiment = 'NEGATIVE' AND issue_category = 'seating'
 AND (contains(lower(park_name), 'bench') OR contains(lower(review_text), 'bench') OR contains(lower(author_name), 'bench') OR contains(lower(design_requirement), 'bench'))"""))
def _(spark, sf):
    return fl.filter_reviews(enriched(spark, sf), category="seating", sentiment="NEGATIVE", search="Bench").select("review_id", "place_id")


@query("global_search", with_enriched(f", {KEYWORDS}, hit AS (SELECT DISTINCT review_id FROM kw WHERE contains(lower(w), 'a1')) "
       "SELECT review_id FROM enriched WHERE contains(lower(review_text), 'a1') OR contains(lower(author_name), 'a1') OR contains(lower(park_name), 'a1') OR review_id IN (SELECT review_id FROM hit)"))
def _(spark, sf):
    return fl.global_search(enriched(spark, sf), "A1").select("review_id")


@query("review_table_page", with_enriched("SELECT review_id, rating, category_confidence FROM enriched WHERE sentiment = 'NEGATIVE' ORDER BY rating DESC, category_confidence, review_id LIMIT 15 OFFSET 30"))
def _(spark, sf):
    return fl.table_page(enriched(spark, sf), {"sentiment": "NEGATIVE"}, [("rating", True), ("category_confidence", False)], page=2).select("review_id", "rating", "category_confidence")


IMPACT = f"""impact0 AS (SELECT place_id, issue_category, count(*) AS mentions, sum({NEGN}) / CAST(count(*) AS DOUBLE) AS negative_share, sum(CAST(rating AS DOUBLE)) / count(*) AS ar, min(review_id) AS first_seq FROM {{src}} GROUP BY ALL),
impact1 AS (SELECT *, mentions / CAST(sum(mentions) OVER (PARTITION BY place_id) AS DOUBLE) AS mention_share FROM impact0),
impact2 AS (SELECT *, least(100e0, {js('(mention_share * 0.4e0 + negative_share * 0.4e0 + (5e0 - ar) / 5e0 * 0.2e0) * 100e0')}) AS priority_index FROM impact1),
impact AS (SELECT place_id, issue_category, mentions, mention_share, {js('ar', 1)} AS avg_rating, negative_share, priority_index, first_seq,
  CASE WHEN priority_index >= 75 THEN 'Very High' WHEN priority_index >= 50 THEN 'High' WHEN priority_index >= 25 THEN 'Medium' ELSE 'Low' END AS priority FROM impact2)"""
IMP = IMPACT.replace("{src}", "enriched")


@query("cross_filtered_impact", with_enriched(f", sub AS (SELECT * FROM enriched WHERE contains(lower(review_text), 'the')), {IMPACT.replace('{src}', 'sub')} SELECT * EXCLUDE (first_seq) FROM impact"))
def _(spark, sf):
    return rv.issue_impact(fl.cross_filter(enriched(spark, sf), keyword="the")).drop("first_seq")


@query("cross_filtered_category", with_enriched("SELECT place_id, review_id, issue_category, sentiment FROM enriched WHERE issue_category = 'cleanliness' AND contains(lower(review_text), 'the')"))
def _(spark, sf):
    return fl.cross_filter(enriched(spark, sf), category="cleanliness", keyword="the").select("place_id", "review_id", "issue_category", "sentiment")


@query("search_places", "SELECT 'Place ' || source AS name, source AS formatted_address FROM documents WHERE contains(lower(source), 'src1') OR contains(lower('Place ' || source), 'src1') GROUP BY source")
def _(spark, sf):
    places = ad.reviews(spark, sf).select(F.col("park_name").alias("name"), F.col("place_id").alias("formatted_address")).distinct()
    return fl.search_places(places, "SRC1")


# --- aggregates -----------------------------------------------------------------

@query("sentiment_summary", with_enriched(f"SELECT place_id, count(*) AS n, avg({SIGN}) AS sentiment_score, avg({POSN}) AS positive_share, {share_sql('sentiment = ' + q('NEUTRAL'))} AS neutral_share, avg({NEGN}) AS negative_share FROM enriched GROUP BY place_id"))
def _(spark, sf):
    return rv.sentiment_summary(enriched(spark, sf))


@query("issue_impact", with_enriched(f", {IMP} SELECT * EXCLUDE (first_seq) FROM impact"))
def _(spark, sf):
    return rv.issue_impact(enriched(spark, sf)).drop("first_seq")


@query("issue_impact_ranked", with_enriched(f", {IMP} " + " UNION ALL ".join(
    f"SELECT {q(m)} AS mode, place_id, issue_category, row_number() OVER (PARTITION BY place_id ORDER BY {c} {'ASC' if a else 'DESC'}, first_seq) AS rank FROM impact" for m, (c, a) in rv.IMPACT_ORDER.items())))
def _(spark, sf):
    imp = rv.issue_impact(enriched(spark, sf))
    out = None
    for m in rv.IMPACT_ORDER:
        t = rv.sort_issue_impact(imp, m).select(F.lit(m).alias("mode"), "place_id", "issue_category", "rank")
        out = t if out is None else out.unionByName(t)
    return out


WORDS = f"len(list_filter(regexp_split_to_array(review_text, {q(lx.WHITESPACE + '+')}), lambda w: w <> ''))"
BUCKETED = f"""bt0 AS (SELECT *, {WORDS} AS words, count(*) OVER (PARTITION BY place_id) AS total, count(published_ts) OVER (PARTITION BY place_id) / CAST(count(*) OVER (PARTITION BY place_id) AS DOUBLE) >= 0.8e0 AS cal FROM enriched),
bt1 AS (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY CASE WHEN cal THEN published_ts END NULLS LAST, review_id) AS rn FROM bt0),
bt AS (SELECT *, (rn - 1) // greatest(1, CAST(ceil(total / 8e0) AS BIGINT)) AS bucket, CASE WHEN cal THEN 'calendar' ELSE 'sequence' END AS time_basis FROM bt1)"""


def _kpi_sql(src, keys):
    k = ", ".join(keys)
    return f"""kc_{src} AS (SELECT {k}, issue_category, count(*) AS n, sum({NEGN}) / CAST(count(*) AS DOUBLE) AS ns, sum(CAST(rating AS DOUBLE)) / count(*) AS ar FROM {src} GROUP BY ALL),
kl_{src} AS (SELECT *, least(100e0, {js(f'(n / CAST(sum(n) OVER (PARTITION BY {k}) AS DOUBLE) * 0.4e0 + ns * 0.4e0 + (5e0 - ar) / 5e0 * 0.2e0) * 100e0')}) AS pi FROM kc_{src}),
kp_{src} AS (SELECT {k}, CAST(count(*) FILTER (WHERE pi >= 25) AS DOUBLE) AS "designOpportunities", CAST(count(*) FILTER (WHERE pi >= 50) AS DOUBLE) AS "criticalIssues" FROM kl_{src} GROUP BY ALL),
kv_{src} AS (SELECT {k}, count(*) AS n, CAST(count(*) AS DOUBLE) AS "totalReviews", 1e0 AS "parksSelected", avg(CAST(rating AS DOUBLE)) AS "avgRating", (avg({SIGN}) + 1e0) / 2e0 * 100e0 AS "sentimentScore",
 avg({POSN}) * 100e0 AS "positivePct", {share_sql("sentiment = 'NEUTRAL'")} * 100e0 AS "neutralPct", avg({NEGN}) * 100e0 AS "negativePct", CAST(count(DISTINCT issue_category) AS DOUBLE) AS "themeCount",
 avg(category_confidence) * 100e0 AS "aiConfidence", avg(words) AS "avgReviewLength" FROM {src} GROUP BY {k}),
kw_{src} AS (SELECT * FROM kv_{src} JOIN kp_{src} USING ({k}))"""


KPI_COLS = ", ".join(f'"{k}"' for k in rv.KPI_IDS)
KPI_DEF = {"parksSelected": "1e0", "sentimentScore": "50e0"}
KPI_FULL = f"""{BUCKETED}, {_kpi_sql('bt', ['place_id', 'time_basis', 'bucket'])},
kspine AS (SELECT DISTINCT place_id, time_basis, b AS bucket FROM bt, range(8) t(b)),
kfull AS (SELECT s.place_id, s.time_basis, s.bucket, coalesce(k.n, 0) AS n, {', '.join(f'coalesce(k."{k}", {KPI_DEF.get(k, "0e0")}) AS "{k}"' for k in rv.KPI_IDS)} FROM kspine s LEFT JOIN kw_bt k USING (place_id, time_basis, bucket)),
klong AS (UNPIVOT kfull ON {KPI_COLS} INTO NAME kpi VALUE value)"""


@query("kpi_buckets", with_enriched(f", {KPI_FULL} SELECT place_id, time_basis, bucket, kpi, n, {js('value', 6)} AS value FROM klong"))
def _(spark, sf):
    return rv.kpi_buckets(enriched_table(spark, sf)).select("place_id", "time_basis", F.col("bucket").cast("long"), "kpi", "n", js_round("value", 6).alias("value"))


def _trend_sql(e, l):
    pct = f"coalesce(CASE WHEN {e} = 0 THEN CASE WHEN {l} = 0 THEN 0e0 ELSE 100e0 END ELSE ({l} - {e}) / abs({e}) * 100e0 END, 0e0)"
    return f"CASE WHEN {pct} > 2 THEN 'up' WHEN {pct} < -2 THEN 'down' ELSE 'flat' END AS trend, {js(pct, 1)} AS trend_pct"


@query("review_kpis", with_enriched(f""", {KPI_FULL}, {_kpi_sql('bt0', ['place_id'])},
ktr AS (SELECT place_id, kpi, time_basis, CAST(sum(n) AS BIGINT) AS sample_size, avg(value) FILTER (WHERE bucket < 4) AS e, avg(value) FILTER (WHERE bucket >= 4) AS l FROM klong GROUP BY ALL),
kov AS (UNPIVOT (SELECT place_id, {KPI_COLS} FROM kw_bt0) ON {KPI_COLS} INTO NAME kpi VALUE value)
SELECT place_id, kpi, {js('value', 6)} AS value, {_trend_sql('e', 'l')}, time_basis, sample_size FROM ktr JOIN kov USING (place_id, kpi)"""))
def _(spark, sf):
    return rv.kpis(enriched_table(spark, sf)).drop("sparkline").withColumn("value", js_round("value", 6))


def _health_sql():
    h = lambda w: any_like("lower(review_text)", w)
    cat = "issue_category"
    return {
        "thermalComfort": f"{cat} = 'shade / heat comfort'", "accessibility": f"{cat} = 'accessibility'", "maintenance": f"{cat} IN ('maintenance','cleanliness')",
        "safety": f"{cat} IN ('safety','lighting')", "familyFriendliness": h(lx.FAMILY_WORDS), "playQuality": f"{cat} IN ('playground','sports facilities')",
        "landscapeQuality": f"{cat} IN ('landscape / greenery','water features')", "biodiversity": f"{cat} = 'landscape / greenery' AND {h(lx.BIODIVERSITY_WORDS)}",
        "amenities": f"{cat} IN ('toilets','food / cafe','parking')", "walkability": f"{cat} = 'accessibility' AND {h(lx.WALK_WORDS)}",
        "communityActivity": f"({cat} = 'crowding' AND sentiment <> 'NEGATIVE') OR {h(lx.COMMUNITY_WORDS)}",
    }


HEALTH = "hs AS (" + " UNION ALL ".join(
    f"SELECT place_id, {q(k)} AS key, {q(dict(lx.HEALTH_KEYS)[k])} AS label, CAST(count(*) FILTER (WHERE {c}) AS BIGINT) AS n, avg({POSN}) FILTER (WHERE {c}) AS p, avg({NEGN}) FILTER (WHERE {c}) AS g, avg(CAST(rating AS DOUBLE)) FILTER (WHERE {c}) AS r FROM enriched GROUP BY place_id"
    for k, c in _health_sql().items()) + f"), health AS (SELECT place_id, key, label, CASE WHEN n < 5 THEN 60e0 ELSE greatest(0e0, least(100e0, {js('((p - g + 1e0) / 2e0 * 0.6e0 + r / 5e0 * 0.4e0) * 100e0')})) END AS score, n AS sample_size, n < 5 AS low_sample FROM hs)"


@query("health_score", with_enriched(f", {HEALTH} SELECT * FROM health"))
def _(spark, sf):
    return rv.health_score(enriched(spark, sf))


@query("health_benchmark", with_enriched(f", {HEALTH}, ov AS (SELECT place_id, {js('avg(score)')} AS overall FROM health GROUP BY place_id) SELECT h.place_id, " + ", ".join(
    f'max(score) FILTER (WHERE key = {q(k)}) AS "{k}"' for k, _ in lx.HEALTH_KEYS) + ", max(overall) AS overall FROM health h JOIN ov USING (place_id) GROUP BY h.place_id"))
def _(spark, sf):
    return rv.benchmark_pivot(enriched(spark, sf))


@query("rating_drivers", with_enriched(""", t AS (SELECT place_id, count(*) FILTER (WHERE rating = 5) AS t5, count(*) FILTER (WHERE rating = 1) AS t1 FROM enriched GROUP BY place_id),
x AS (SELECT place_id, rating, unnest(categories) AS category FROM enriched), c AS (SELECT place_id, category, count(*) FILTER (WHERE rating = 5) AS c5, count(*) FILTER (WHERE rating = 1) AS c1 FROM x GROUP BY ALL),
s AS (SELECT place_id, category, CASE WHEN t5 = 0 THEN 0e0 ELSE c5 / CAST(t5 AS DOUBLE) END AS share_in_5_star, CASE WHEN t1 = 0 THEN 0e0 ELSE c1 / CAST(t1 AS DOUBLE) END AS share_in_1_star FROM c JOIN t USING (place_id))
SELECT *, share_in_5_star - share_in_1_star AS differential FROM s"""))
def _(spark, sf):
    return rv.rating_drivers(enriched(spark, sf))


QSCORE = "category_confidence - CASE WHEN length(review_text) < 40 THEN 0.4e0 WHEN length(review_text) > 220 THEN 0.25e0 ELSE 0e0 END"
TOPICS = f"""{KEYWORDS},
tk AS (SELECT place_id, issue_category, w, count(*) AS n, min(review_id * 10 + kr) AS f FROM kw GROUP BY ALL),
tkr AS (SELECT *, row_number() OVER (PARTITION BY place_id, issue_category ORDER BY n DESC, f) AS r FROM tk),
tks AS (SELECT place_id, issue_category, string_agg(w, '|' ORDER BY r) AS top_keywords FROM tkr WHERE r <= 8 GROUP BY ALL),
tq AS (SELECT place_id, issue_category, review_id AS quote_id, author_name AS quote_author, review_text AS quote, row_number() OVER (PARTITION BY place_id, issue_category ORDER BY {QSCORE} DESC, review_id) AS r FROM enriched),
tb AS (SELECT place_id, issue_category, count(*) AS review_count, avg({POSN}) AS positive_share, {share_sql("sentiment = 'NEUTRAL'")} AS neutral_share, avg({NEGN}) AS negative_share, {js('avg(CAST(rating AS DOUBLE))', 1)} AS avg_rating, min(review_id) AS first_seq FROM enriched GROUP BY ALL),
topics AS (SELECT tb.*, coalesce(top_keywords, '') AS top_keywords, quote_id, quote_author, quote FROM tb LEFT JOIN tks USING (place_id, issue_category) JOIN tq USING (place_id, issue_category) WHERE tq.r = 1)"""


@query("topic_distribution", with_enriched(f", {TOPICS} SELECT * EXCLUDE (first_seq, quote) FROM topics"))
def _(spark, sf):
    return rv.topic_distribution(enriched_table(spark, sf)).withColumn("top_keywords", joined("top_keywords")).drop("quote", "design_implication", "first_seq")


@query("representative_quote", with_enriched(f", tq AS (SELECT place_id, topic, review_id AS quote_id, author_name AS quote_author, row_number() OVER (PARTITION BY place_id, topic ORDER BY {QSCORE} DESC, review_id) AS r FROM enriched) SELECT * EXCLUDE (r) FROM tq WHERE r = 1"))
def _(spark, sf):
    return rk.representative_quote(enriched(spark, sf), ["place_id", "topic"]).drop("quote", "design_implication")


PERS = f"""pe AS (SELECT *, unnest(list_filter([{', '.join(f"CASE WHEN {any_like('low', w)} THEN {q(p)} END" for p, _, w in lx.PERSONAS)}], lambda x: x IS NOT NULL)) AS persona FROM enriched),
plab AS (SELECT * FROM (VALUES {values_list([(i, p, lab) for i, (p, lab, _) in enumerate(lx.PERSONAS)])}) v(po, persona, label)),
pc AS (SELECT place_id, persona, issue_category, count(*) AS n, sum({NEGN}) / CAST(count(*) AS DOUBLE) AS ns, min(review_id) AS f FROM pe GROUP BY ALL),
pneed AS (SELECT place_id, persona, string_agg(issue_category, '|' ORDER BY r) AS primary_needs FROM (SELECT *, row_number() OVER (PARTITION BY place_id, persona ORDER BY n DESC, f) AS r FROM pc) WHERE r <= 3 GROUP BY ALL),
pcr AS (SELECT *, row_number() OVER (PARTITION BY place_id, persona ORDER BY ns DESC, f) AS r FROM pc WHERE n >= 2),
pcomp AS (SELECT place_id, persona, string_agg(issue_category, '|' ORDER BY r) AS top_complaints FROM pcr WHERE r <= 3 GROUP BY ALL),
pq AS (SELECT place_id, persona, review_id AS quote_id, row_number() OVER (PARTITION BY place_id, persona ORDER BY {POSN} DESC, {QSCORE} DESC, review_id) AS r FROM pe),
piv AS (SELECT pe.place_id, pe.persona, pe.design_requirement AS suggested_intervention, row_number() OVER (PARTITION BY pe.place_id, pe.persona ORDER BY CASE WHEN pe.issue_category = t.issue_category THEN 0 ELSE 1 END, review_id) AS r
  FROM pe LEFT JOIN (SELECT * FROM pcr WHERE r = 1) t ON pe.place_id = t.place_id AND pe.persona = t.persona),
personas AS (SELECT b.place_id, b.persona, label, po, review_count, primary_needs, coalesce(top_complaints, '') AS top_complaints, quote_id, suggested_intervention
  FROM (SELECT place_id, persona, count(*) AS review_count FROM pe GROUP BY ALL) b JOIN plab USING (persona) JOIN pneed USING (place_id, persona) LEFT JOIN pcomp USING (place_id, persona)
  JOIN pq USING (place_id, persona) JOIN piv USING (place_id, persona) WHERE pq.r = 1 AND piv.r = 1)"""


@query("persona_analytics", with_enriched(f", {PERS} SELECT place_id, persona, label, review_count, primary_needs, top_complaints, quote_id, md5(suggested_intervention) AS advice FROM personas"))
def _(spark, sf):
    return rv.persona_analytics(enriched(spark, sf)).select("place_id", "persona", "label", "review_count", joined("primary_needs").alias("primary_needs"),
                                                            joined("top_complaints").alias("top_complaints"), "quote_id", F.md5("suggested_intervention").alias("advice"))


@query("intervention_scores", with_enriched(f""", {IMP}, iv AS (SELECT * FROM (VALUES {values_list(lx.INTERVENTIONS)}) v(id, label, category, cost, maintenance, difficulty)),
sp AS (SELECT DISTINCT place_id FROM enriched), j AS (SELECT sp.place_id, iv.*, i.mentions, i.priority_index, i.priority FROM sp CROSS JOIN iv LEFT JOIN impact i ON i.place_id = sp.place_id AND i.issue_category = iv.category)
SELECT place_id, id, label, category, CASE WHEN coalesce(mentions, 0) < 3 THEN 20e0 ELSE priority_index END AS score, CASE WHEN coalesce(mentions, 0) < 3 THEN 'Low' ELSE priority END AS expected_impact, cost, maintenance, difficulty,
 coalesce(mentions, 0) AS supporting_mentions, coalesce(mentions, 0) < 3 AS insufficient_data FROM j"""))
def _(spark, sf):
    return rv.opportunity_interventions(enriched_table(spark, sf))


@query("place_layer_metrics", with_enriched(f""", w AS (SELECT place_id, CAST(count(*) AS DOUBLE) AS "reviewDensity", avg({SIGN}) * 100 AS "sentimentDensity", """ + ", ".join(
    f"coalesce(avg({NEGN}) FILTER (WHERE issue_category = {q(c)}), 0e0) * 100 AS \"{k}\"" for k, c in lx.LAYER_CATEGORIES) + f""", {share_sql("issue_category = 'landscape / greenery'")} * 100 AS "greeneryMentions" FROM enriched GROUP BY place_id),
l AS (UNPIVOT w ON COLUMNS(* EXCLUDE (place_id)) INTO NAME layer VALUE value), s AS (SELECT layer, min(value) AS lo, max(value) AS hi FROM l GROUP BY layer)
SELECT place_id, l.layer, value, (value - lo) / CASE WHEN hi = lo THEN 1e0 ELSE hi - lo END AS normalized FROM l JOIN s USING (layer)"""))
def _(spark, sf):
    return rv.place_layer_metrics(enriched(spark, sf))


SEASON = """sea0 AS (SELECT *, month(published_ts) AS m, hour(published_ts) AS h, dayofweek(published_ts) AS d, CAST(published_ts AS DATE) AS dd FROM enriched WHERE published_ts IS NOT NULL),
sea AS (SELECT *, CASE WHEN m BETWEEN 6 AND 9 THEN 'Summer' WHEN m >= 11 OR m <= 3 THEN 'Winter' ELSE 'Transitional' END AS season,
 CASE WHEN """ + " OR ".join(f"dd BETWEEN DATE '{a}' AND DATE '{b}'" for a, b in lx.RAMADAN) + """ THEN 'Ramadan' ELSE 'Non-Ramadan' END AS ramadan,
 CASE WHEN d IN (0, 6) THEN 'Weekend' ELSE 'Weekday' END AS day_type, CASE WHEN h BETWEEN 5 AND 11 THEN 'Morning' WHEN h BETWEEN 12 AND 16 THEN 'Afternoon' WHEN h BETWEEN 17 AND 20 THEN 'Evening' ELSE 'Night' END AS posting_time FROM sea0)"""


def _season_agg(dim):
    def ns(c):
        return js(f"coalesce(avg({NEGN}) FILTER (WHERE issue_category = {q(c)}), 0e0) * 100")
    return f"""SELECT {q(dim)} AS dimension, {dim} AS bucket, count(*) AS review_count, {js('avg(CAST(rating AS DOUBLE))', 1)} AS avg_rating, {js(f'(avg({SIGN}) + 1e0) / 2e0 * 100e0')} AS sentiment_score,
 {ns('shade / heat comfort')} AS heat_complaints_pct, {ns('crowding')} AS crowding_pct, {js(share_sql(any_like('low', lx.COMMUNITY_WORDS)) + ' * 100e0')} AS event_mentions_pct FROM sea GROUP BY {dim}"""


@query("seasonal_breakdown", with_enriched(f", {SEASON} " + " UNION ALL ".join(_season_agg(d) for d in rv.SEASON_DIMS)))
def _(spark, sf):
    return rv.seasonal_breakdown(enriched(spark, sf))


@query("season_labels", with_enriched(f", {SEASON} SELECT review_id, season, ramadan, day_type, posting_time FROM sea"))
def _(spark, sf):
    d = ts.with_season_labels(enriched(spark, sf).filter(F.col("published_ts").isNotNull()))
    return d.select("review_id", "season", "ramadan", "day_type", "posting_time")


CLEANING = f"""cl0 AS (SELECT place_id, review_id, regexp_replace(review_text, {q('^' + lx.WHITESPACE + '+|' + lx.WHITESPACE + '+$')}, '', 'g') AS t, lower(author_name || '|' || regexp_replace(review_text, {q(lx.WHITESPACE + '+$')}, '')) AS k FROM enriched),
clean AS (SELECT place_id, count(*) AS total_raw, {cnt_sql('length(t) > 0')} AS valid_reviews, count(*) - count(DISTINCT k) AS duplicates, {cnt_sql('length(t) < 15')} AS very_short, CAST(count(f.review_id) AS BIGINT) AS flagged FROM cl0 LEFT JOIN (SELECT review_id FROM flagged) f USING (review_id) GROUP BY place_id)"""


@query("cleaning_summary", with_enriched(f", {SENT}, {CLEANING} SELECT * FROM clean"))
def _(spark, sf):
    return rv.cleaning_summary(ad.reviews(spark, sf))


@query("nlp_kpis", with_enriched(f""", med AS (SELECT place_id, CAST(rating AS DOUBLE) AS m FROM (SELECT place_id, rating, row_number() OVER (PARTITION BY place_id ORDER BY rating) AS rn, count(*) OVER (PARTITION BY place_id) AS n FROM enriched) WHERE rn = n // 2 + 1),
w AS (SELECT place_id, CAST(count(*) AS DOUBLE) AS "totalReviews", {js('avg(CAST(rating AS DOUBLE))', 1)} AS "avgRating", max(m) AS "medianRating", {js(f'avg({POSN}) * 1000e0')} / 10e0 AS "positiveShare",
 {js(share_sql("sentiment = 'NEUTRAL'") + ' * 1000e0')} / 10e0 AS "neutralShare", {js(f'avg({NEGN}) * 1000e0')} / 10e0 AS "negativeShare", {js(f'(avg({SIGN}) + 1e0) / 2e0 * 100e0')} AS "overallSentimentScore",
 {js(share_sql(f"issue_category <> {q(lx.DEFAULT_CATEGORY)}") + ' * 100e0')} AS "actionabilityScore", {js('count(DISTINCT issue_category) / 20e0 * 100e0')} AS "issueDiversityScore", {js('avg(category_confidence) * 100e0')} AS "topicConfidence",
 CAST(count(*) FILTER (WHERE issue_category <> {q(lx.DEFAULT_CATEGORY)}) AS DOUBLE) AS "actionableReviews", CAST(sum({POSN}) AS DOUBLE) AS "praiseReviews",
 {', '.join(f'CAST(count(*) FILTER (WHERE list_contains(categories, {q(c)})) AS DOUBLE) AS "{k}"' for k, c in lx.MENTION_TOPICS)},
 {', '.join(f'CAST(count(*) FILTER (WHERE {any_like("low", ws)}) AS DOUBLE) AS "{k}"' for k, ws in lx.MENTION_GROUPS)}
 FROM enriched JOIN med USING (place_id) GROUP BY place_id) UNPIVOT w ON COLUMNS(* EXCLUDE (place_id)) INTO NAME key VALUE value"""))
def _(spark, sf):
    return rv.nlp_kpis(enriched(spark, sf))


def _series(name, src, keys, cond="published_ts IS NOT NULL"):
    k = ", ".join(keys)
    return f"""{name}_m AS (SELECT {k}, strftime(published_ts, '%Y-%m') AS period, count(*) AS n FROM {src} WHERE {cond} GROUP BY ALL),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY period) AS rn, count(*) OVER (PARTITION BY {k}) AS c FROM {name}_m),
{name}_h AS (SELECT {k}, max(c) AS np, avg(n) FILTER (WHERE rn <= greatest(1, c // 2)) AS e, avg(n) FILTER (WHERE rn > c - greatest(1, c // 2)) AS l FROM {name}_r GROUP BY ALL),
{name} AS (SELECT {k}, np, {_trend_sql('e', 'l')} FROM {name}_h WHERE np >= 2)"""


@query("topic_analysis", with_enriched(f""", mx AS (SELECT *, unnest(categories) AS category FROM enriched), {_series('tr', 'mx', ['place_id', 'category'])},
sg AS (SELECT place_id, issue_category AS category, count(*) AS rc FROM enriched GROUP BY ALL),
t AS (SELECT place_id, category, count(*) AS mentions, {js(f'avg({POSN}) * 100e0')} AS positive_pct, {js(f'avg({NEGN}) * 100e0')} AS negative_pct, {js('avg(CAST(rating AS DOUBLE))', 1)} AS avg_rating FROM mx GROUP BY ALL)
SELECT t.*, coalesce(rc, 0) AS review_count, coalesce(trend, 'flat') AS trend, coalesce(trend_pct, 0e0) AS trend_pct, coalesce(np, 0) >= 2 AS has_date_trend FROM t LEFT JOIN sg USING (place_id, category) LEFT JOIN tr USING (place_id, category)"""))
def _(spark, sf):
    return rv.topic_analysis(enriched(spark, sf))


COMPLAINTS = f"""{IMP}, {PERS}, {_series('ctr', 'enriched', ['place_id', 'issue_category'])},
adv AS (SELECT place_id, issue_category, design_requirement AS suggested_intervention, row_number() OVER (PARTITION BY place_id, issue_category ORDER BY {NEGN} DESC, review_id) AS r FROM enriched),
aff AS (SELECT place_id, issue_category, string_agg(label, '|' ORDER BY review_count DESC, po) AS affected_personas FROM (SELECT place_id, label, po, review_count, unnest(string_split(top_complaints, '|')) AS issue_category FROM personas) GROUP BY ALL),
cm0 AS (SELECT i.place_id, i.issue_category, CASE WHEN priority_index >= 75 THEN 'Critical' WHEN priority_index >= 50 THEN 'High' WHEN priority_index >= 25 THEN 'Medium' ELSE 'Low' END AS severity, mentions,
 {js('negative_share * 100e0')} AS negative_pct, avg_rating, coalesce(affected_personas, '') AS affected_personas, suggested_intervention, CAST(least(95, 40 + mentions * 2) AS DOUBLE) AS confidence, coalesce(trend, 'flat') AS recent_trend, priority_index, first_seq
 FROM impact i JOIN adv a ON a.place_id = i.place_id AND a.issue_category = i.issue_category AND a.r = 1 LEFT JOIN ctr ON ctr.place_id = i.place_id AND ctr.issue_category = i.issue_category
 LEFT JOIN aff ON aff.place_id = i.place_id AND aff.issue_category = i.issue_category WHERE negative_share > 0 AND i.issue_category <> {q(lx.DEFAULT_CATEGORY)}),
complaints AS (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END DESC, mentions DESC, priority_index DESC, first_seq) AS rank FROM cm0)"""


@query("complaint_intelligence", with_enriched(f", {COMPLAINTS} SELECT place_id, rank, issue_category, severity, mentions, negative_pct, avg_rating, affected_personas, md5(suggested_intervention) AS advice, confidence, recent_trend FROM complaints"))
def _(spark, sf):
    c = rv.complaint_intelligence(enriched_table(spark, sf))
    return c.select("place_id", "rank", "issue_category", "severity", "mentions", "negative_pct", "avg_rating", joined("affected_personas").alias("affected_personas"),
                    F.md5("suggested_intervention").alias("advice"), "confidence", "recent_trend")


POSF = f"""pf0 AS (SELECT *, {js('positive_share * 100e0')} AS positive_pct FROM topics WHERE positive_share > 0 AND issue_category <> {q(lx.DEFAULT_CATEGORY)}),
posf AS (SELECT place_id, issue_category, review_count AS mentions, positive_pct, avg_rating, quote_id, quote_author, row_number() OVER (PARTITION BY place_id ORDER BY positive_pct * review_count DESC, review_count DESC, first_seq) AS rank FROM pf0)"""


@query("positive_features", with_enriched(f", {TOPICS}, {POSF} SELECT * FROM posf"))
def _(spark, sf):
    return rv.positive_features(enriched_table(spark, sf)).drop("quote")


VISIT = f"""vt AS (SELECT place_id, persona, {', '.join(f'count(*) FILTER (WHERE {any_like("low", w)}) AS c{i}' for i, (_, w) in enumerate(lx.VISIT_TIMES))} FROM pe GROUP BY ALL),
vt2 AS (SELECT *, greatest(c0, c1, c2, c3) AS visit_mentions FROM vt),
visit AS (SELECT place_id, persona, visit_mentions, CASE WHEN visit_mentions >= 3 THEN CASE visit_mentions {' '.join(f'WHEN c{i} THEN {q(n)}' for i, (n, _) in enumerate(lx.VISIT_TIMES))} END ELSE 'Not enough time-of-day evidence' END AS likely_visit_time,
 CASE WHEN visit_mentions >= 8 THEN 'Medium' WHEN visit_mentions >= 3 THEN 'Low' ELSE 'N/A' END AS visit_time_confidence FROM vt2)"""


@query("user_group_insights", with_enriched(f", {PERS}, {VISIT} SELECT place_id, persona, label, review_count, primary_needs, likely_visit_time, visit_time_confidence, visit_mentions FROM personas JOIN visit USING (place_id, persona)"))
def _(spark, sf):
    return rv.user_group_insights(enriched_table(spark, sf)).select("place_id", "persona", "label", "review_count", joined("primary_needs").alias("primary_needs"), "likely_visit_time", "visit_time_confidence", "visit_mentions")


@query("activity_patterns", f"WITH {REVIEWS} " + " UNION ALL ".join(
    f"SELECT place_id, {q(k)} AS key, {cnt_sql(any_like('lower(review_text)', w))} AS mention_count, {js(share_sql(any_like('lower(review_text)', w)) + ' * 1000e0')} / 10e0 AS mention_share_pct FROM reviews GROUP BY place_id" for k, _, w in lx.ACTIVITY_TIMES))
def _(spark, sf):
    return rv.activity_patterns(ad.reviews(spark, sf))


@query("park_stats", with_enriched(f""", p AS (SELECT place_id, avg(CAST(rating AS DOUBLE)) AS a, min(review_id) AS s FROM enriched GROUP BY place_id),
i AS (SELECT issue_category, count(*) AS n, min(review_id) AS s FROM enriched WHERE sentiment = 'NEGATIVE' OR rating <= 3 GROUP BY issue_category),
ti AS (SELECT issue_category FROM i ORDER BY n DESC, s LIMIT 1)
SELECT (SELECT {js('avg(a)', 2)} FROM p) AS avg_rating, (SELECT place_id FROM p ORDER BY a DESC, s LIMIT 1) AS best_place, (SELECT place_id FROM p ORDER BY a, s DESC LIMIT 1) AS worst_place,
 (SELECT CASE issue_category WHEN {q(lx.DEFAULT_CATEGORY)} THEN 'Landscape Shading' ELSE issue_category END FROM ti) AS top_issue"""))
def _(spark, sf):
    return rv.park_stats(enriched(spark, sf))


@query("issue_counts", with_enriched("SELECT issue_category, count(*) AS n FROM enriched GROUP BY ALL"))
def _(spark, sf):
    return rv.issue_counts(enriched(spark, sf))


@query("issue_sentiment_stack", with_enriched("SELECT issue_category, " + ", ".join(f'{cnt_sql("sentiment = " + q(s))} AS "{s}"' for s in ("POSITIVE", "NEUTRAL", "NEGATIVE")) + " FROM enriched GROUP BY issue_category"))
def _(spark, sf):
    return rv.issue_sentiment_stack(enriched(spark, sf))


@query("keyword_frequencies", with_enriched(f", {KEYWORDS} SELECT w AS keyword, count(*) AS n FROM kw GROUP BY w"))
def _(spark, sf):
    return rv.keyword_frequencies(enriched(spark, sf))


@query("exec_summary", with_enriched(f""", {COMPLAINTS}, {TOPICS}, {POSF},
b AS (SELECT place_id, count(*) AS reviews_analyzed, {js('avg(CAST(rating AS DOUBLE))', 1)} AS average_rating, {js(f'(avg({SIGN}) + 1e0) / 2e0 * 100e0')} AS satisfaction_score FROM enriched GROUP BY place_id),
cc AS (SELECT place_id, issue_category AS critical_issue_cluster FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY CASE severity WHEN 'Critical' THEN 0 ELSE 1 END, rank) AS r FROM complaints) WHERE r = 1),
tp AS (SELECT place_id, label AS top_user_group FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY review_count DESC, po) AS r FROM personas) WHERE r = 1)
SELECT b.*, CASE WHEN satisfaction_score >= 80 THEN 'VERY POSITIVE' WHEN satisfaction_score >= 60 THEN 'POSITIVE' WHEN satisfaction_score >= 40 THEN 'MIXED' WHEN satisfaction_score >= 20 THEN 'NEGATIVE' ELSE 'VERY NEGATIVE' END AS overall_sentiment,
 coalesce(f.issue_category, 'Insufficient data') AS top_positive_topic, coalesce(c.issue_category, 'Insufficient data') AS top_negative_topic, md5(coalesce(c.suggested_intervention, 'Insufficient data')) AS improvement,
 coalesce(top_user_group, 'Insufficient data') AS top_user_group, coalesce(critical_issue_cluster, 'None identified') AS critical_issue_cluster
FROM b LEFT JOIN (SELECT * FROM complaints WHERE rank = 1) c USING (place_id) LEFT JOIN (SELECT * FROM posf WHERE rank = 1) f USING (place_id) LEFT JOIN cc USING (place_id) LEFT JOIN tp USING (place_id)"""))
def _(spark, sf):
    return rv.exec_summary(enriched_table(spark, sf)).withColumn("improvement", F.md5("most_requested_improvement")).drop("most_requested_improvement")


# --- text mining ----------------------------------------------------------------

def _ngram_sql(n):
    return f"""WITH {REVIEWS}, {LIGHT}, g AS (SELECT review_id, unnest(range(1, len(toks) - {n - 2})) AS p, toks FROM light WHERE len(toks) >= {n}),
c AS (SELECT array_to_string(toks[p:p + {n - 1}], ' ') AS phrase, count(*) AS n, min(review_id * 100000 + p) AS f FROM g GROUP BY 1)
SELECT phrase, n FROM c WHERE n >= 2 ORDER BY n DESC, f LIMIT 30"""


@query("bigrams", _ngram_sql(2))
def _(spark, sf):
    return tm.ngrams(ad.reviews(spark, sf), 2)


@query("trigrams", _ngram_sql(3))
def _(spark, sf):
    return tm.ngrams(ad.reviews(spark, sf), 3)


@query("tfidf_terms", f"""WITH {REVIEWS}, {LIGHT}, w AS (SELECT review_id, unnest(toks) AS term, len(toks) AS len FROM light WHERE len(toks) > 0),
tf AS (SELECT review_id, term, count(*) / CAST(any_value(len) AS DOUBLE) AS tf FROM w GROUP BY review_id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
nd AS (SELECT count(*) AS nd FROM light WHERE len(toks) > 0), s AS (SELECT term, df, sum(tf * ln(nd / CAST(df AS DOUBLE))) / df AS s FROM tf JOIN df USING (term), nd WHERE length(term) > 2 AND df >= 3 GROUP BY term, df)
SELECT term, df, {js('s', 3)} AS score FROM s ORDER BY {js('s', 9)} DESC, term LIMIT 40""")
def _(spark, sf):
    return tm.tfidf(ad.reviews(spark, sf))


@query("topic_cooccurrence_nodes", with_enriched(", x AS (SELECT unnest(categories) AS category FROM enriched) SELECT category, count(*) AS n FROM x GROUP BY category"))
def _(spark, sf):
    return tm.topic_nodes(enriched(spark, sf))


@query("topic_cooccurrence_edges", with_enriched(""", x AS (SELECT review_id, unnest(categories) AS c FROM enriched),
e AS (SELECT a.c AS source, b.c AS target, count(*) AS weight, min(a.review_id) AS f FROM x a JOIN x b ON a.review_id = b.review_id AND a.c < b.c GROUP BY ALL)
SELECT source, target, weight FROM e ORDER BY weight DESC, f, source, target LIMIT 40"""))
def _(spark, sf):
    return tm.topic_cooccurrence(enriched(spark, sf))


# --- time -----------------------------------------------------------------------

@query("time_buckets", with_enriched(f", {BUCKETED} SELECT place_id, review_id, bucket, time_basis FROM bt"))
def _(spark, sf):
    return ts.bucket_by_time(enriched(spark, sf).select("place_id", "review_id", "published_ts")).select("place_id", "review_id", F.col("bucket").cast("long"), "time_basis")


PERIOD = {"month": "strftime(published_ts, '%Y-%m')", "quarter": "year(published_ts) || '-Q' || quarter(published_ts)", "year": "CAST(year(published_ts) AS VARCHAR)"}


@query("period_keys", f"WITH {REVIEWS} SELECT review_id, {PERIOD['month']} AS month, {PERIOD['quarter']} AS quarter, {PERIOD['year']} AS year FROM reviews WHERE published_ts IS NOT NULL")
def _(spark, sf):
    d = ad.reviews(spark, sf).withColumn("published_ts", F.try_to_timestamp("published_at")).filter(F.col("published_ts").isNotNull())
    return d.select("review_id", *[ts.period_key("published_ts", g).alias(g) for g in ("month", "quarter", "year")])


def _pts(place):
    return f"""SELECT {PERIOD['quarter']} AS period, {place} AS place_id, avg(CAST(rating AS DOUBLE)) AS avg_rating, (avg({SIGN}) + 1e0) / 2e0 * 100e0 AS sentiment_score, count(*) AS review_volume, avg({NEGN}) * 100e0 AS negative_pct
FROM enriched WHERE published_ts IS NOT NULL GROUP BY ALL"""


@query("place_time_series", with_enriched(_pts("place_id") + " UNION ALL " + _pts("'(all)'")))
def _(spark, sf):
    return ts.place_time_series(enriched(spark, sf), "quarter")


#: The dimension of places in the given tables.
SOURCES = [f"src{i}" for i in range(20)]


@query("place_time_matrix", with_enriched(f", l AS ({_pts('place_id')} UNION ALL {_pts(chr(39) + '(all)' + chr(39))}) SELECT period, " + ", ".join(
    f'max(avg_rating) FILTER (WHERE place_id = {q(p)}) AS "{p}"' for p in [*SOURCES, "(all)"]) + " FROM l GROUP BY period"))
def _(spark, sf):
    return ts.place_time_matrix(enriched(spark, sf), "avg_rating", SOURCES, "quarter")


@query("topic_evolution", with_enriched(f", c AS (SELECT {PERIOD['month']} AS period, issue_category, count(*) AS n FROM enriched WHERE published_ts IS NOT NULL GROUP BY ALL) SELECT *, n / CAST(sum(n) OVER (PARTITION BY period) AS DOUBLE) AS share FROM c"))
def _(spark, sf):
    return ts.topic_evolution(enriched(spark, sf))


@query("keyword_trend", f"WITH {REVIEWS} SELECT place_id, {PERIOD['quarter']} AS period, {cnt_sql('contains(lower(review_text), ' + q('shade') + ')')} AS n FROM reviews WHERE published_ts IS NOT NULL GROUP BY ALL")
def _(spark, sf):
    d = ad.reviews(spark, sf).withColumn("published_ts", F.try_to_timestamp("published_at"))
    return ts.keyword_trend(d, "Shade", "quarter", ["place_id"])


@query("monthly_trend", with_enriched(f", {_series('tr', 'enriched', ['place_id'])} SELECT place_id, np AS n_points, trend, trend_pct FROM tr"))
def _(spark, sf):
    d = enriched(spark, sf).filter(F.col("published_ts").isNotNull()).groupBy("place_id", ts.period_key("published_ts", "month").alias("period")).agg(F.count(F.lit(1)).alias("n"))
    return ts.series_trend(d, ["place_id"], "period", "n", 2)


@query("temporal_summary", with_enriched(f""", {_series('tr', 'enriched', ['place_id'])} SELECT e.place_id, CAST(count(*) AS BIGINT) AS n, {js('count(published_ts) / CAST(count(*) AS DOUBLE) * 1000e0')} / 10e0 AS dated_share,
 max(trend) AS volume_trend, max(trend_pct) AS volume_trend_pct FROM enriched e LEFT JOIN tr USING (place_id) GROUP BY e.place_id"""))
def _(spark, sf):
    return ts.temporal_summary(enriched_table(spark, sf))


@query("temporal_months", with_enriched(f"SELECT place_id, {PERIOD['month']} AS period, count(*) AS n, {js(f'(avg({SIGN}) + 1e0) / 2e0 * 100e0')} AS sentiment_score FROM enriched WHERE published_ts IS NOT NULL GROUP BY ALL"))
def _(spark, sf):
    return ts.monthly_series(enriched(spark, sf))


@query("review_summary_topics", with_enriched(f", {TOPICS} SELECT * FROM (SELECT * EXCLUDE (first_seq, quote), row_number() OVER (PARTITION BY place_id ORDER BY review_count DESC, first_seq) AS rank FROM topics) WHERE rank <= 8"))
def _(spark, sf):
    return rv.review_summary(enriched_table(spark, sf))["topics"].withColumn("top_keywords", joined("top_keywords")).drop("quote", "design_implication", "first_seq")


@query("review_summary_personas", with_enriched(f", {PERS}, {VISIT} SELECT * FROM (SELECT place_id, persona, label, review_count, primary_needs, likely_visit_time, row_number() OVER (PARTITION BY place_id ORDER BY review_count DESC, persona) AS rank FROM personas JOIN visit USING (place_id, persona)) WHERE rank <= 6"))
def _(spark, sf):
    return rv.review_summary(enriched_table(spark, sf))["personas"].select("place_id", "persona", "label", "review_count", joined("primary_needs").alias("primary_needs"), "likely_visit_time", "rank")


@query("review_summary_features", with_enriched(f", {TOPICS}, {POSF} SELECT * FROM posf WHERE rank <= 8"))
def _(spark, sf):
    return rv.review_summary(enriched_table(spark, sf))["positive_features"].drop("quote")
