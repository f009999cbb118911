"""SQL text helpers for the DuckDB statement registered next to each query.

Written separately from the DataFrame code; only fixed word lists and phrases are shared.
"""

from __future__ import annotations

from ..functions import lexicon as lx
from ..sources import adapters as ad


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def js(x: str, dp: int = 0) -> str:
    if dp == 0:
        return f"floor(CAST({x} AS DOUBLE) + 0.5e0)"
    p = f"{10**dp}e0"
    return f"(floor(CAST({x} AS DOUBLE) * {p} + 0.5e0) / {p})"


def norm(x: str, top: float) -> str:
    return f"greatest(0e0, least(100e0, ({x}) / {float(top)!r}e0 * 100e0))"


def any_like(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(w)})" for w in words) + ")"


def hits(col: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({col}, {q(w)}) AS INTEGER)" for w in words) + ")"


def values_list(rows) -> str:
    return ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else ("NULL" if v is None else str(v)) for v in r) + ")" for r in rows)


PHRASE_ARRAY = "[" + ", ".join(q(p) for p in ad.PHRASES) + "]"

REVIEWS = f"""reviews AS (
 SELECT doc_id AS review_id, source AS place_id, 'Place ' || source AS park_name, 'a' || (doc_id % 97) AS author_name,
        CAST(1 + (doc_id*7 + doc_id // 40) % 5 AS INTEGER) AS rating,
        text || ' ' || ({PHRASE_ARRAY})[CAST((doc_id*3) % 40 AS INTEGER) + 1] AS review_text,
        CASE WHEN doc_id % 11 <> 0 THEN TIMESTAMP '2023-01-01 00:00:00' + to_days(CAST((doc_id*13) % 1400 AS INTEGER)) + to_hours(CAST((doc_id*5) % 24 AS INTEGER)) END AS published_ts,
        lang AS language, 'documents' AS source
 FROM documents)"""


def score_expr(words) -> str:
    return "(" + " + ".join(
        f"CASE WHEN contains(low, {q(w)}) THEN CASE WHEN regexp_matches(low, {q(chr(92) + 'b' + w + chr(92) + 'b')}) THEN 2 ELSE 1 END ELSE 0 END" for w in words
    ) + ")"


def enrich_ctes(src: str = "reviews") -> str:
    """CTEs low_t, scored, enriched over ``src`` (review_text, rating)."""
    scores = ", ".join(f"{score_expr(w)} AS s{i}" for i, (_, w, _) in enumerate(lx.ISSUE_LEXICON))
    n = len(lx.ISSUE_LEXICON)
    best = "greatest(" + ", ".join(f"s{i}" for i in range(n)) + ")"
    cat = "CASE WHEN best = 0 THEN " + q(lx.DEFAULT_CATEGORY) + " " + " ".join(
        f"WHEN s{i} = best THEN {q(lx.ISSUE_LEXICON[i][0])}" for i in range(n)) + " END"
    adv = "CASE WHEN best = 0 THEN " + q(lx.DEFAULT_ADVICE) + " " + " ".join(
        f"WHEN s{i} = best THEN {q(lx.ISSUE_LEXICON[i][2])}" for i in range(n)) + " END"
    multi = "list_filter([" + ", ".join(f"CASE WHEN s{i} > 0 THEN {q(lx.ISSUE_LEXICON[i][0])} END" for i in range(n)) + "], lambda x: x IS NOT NULL)"
    topic = "CASE " + " ".join(f"WHEN issue_category IN ({', '.join(q(c) for c in cats)}) THEN {q(t)}" for t, cats in lx.TOPIC_GROUPS) + f" ELSE {q(lx.DEFAULT_TOPIC)} END"
    return f"""low_t AS (SELECT *, lower(review_text) AS low FROM {src}),
scored AS (SELECT *, {scores}, {hits('low', lx.POSITIVE_WORDS)} AS pos_hits, {hits('low', lx.NEGATIVE_WORDS)} AS neg_hits FROM low_t),
scored2 AS (SELECT *, {best} AS best FROM scored),
scored3 AS (SELECT *, {cat} AS issue_category, {adv} AS design_requirement, {multi} AS categories,
  CASE WHEN rating >= 4 THEN CASE WHEN neg_hits > pos_hits + 1 THEN 'NEUTRAL' ELSE 'POSITIVE' END
       WHEN rating <= 2 THEN 'NEGATIVE' WHEN neg_hits > pos_hits THEN 'NEGATIVE' WHEN pos_hits > neg_hits THEN 'POSITIVE' ELSE 'NEUTRAL' END AS sentiment,
  CASE WHEN best = 0 THEN 0.3e0 ELSE least(1e0, 0.5e0 + best / 8e0) END AS category_confidence FROM scored2),
enriched AS (SELECT * EXCLUDE ({', '.join(f's{i}' for i in range(n))}), {topic} AS topic FROM scored3)"""


ENRICHED = f"{REVIEWS},\n{enrich_ctes()}"


def with_enriched(body: str) -> str:
    return f"WITH {ENRICHED}\n{body}"


KEYWORDS = f"""tok AS (SELECT review_id, place_id, issue_category, list_filter(regexp_split_to_array(translate(low, {q(lx.KEYWORD_PUNCT)}, ''), {q(lx.WHITESPACE + '+')}),
   lambda w: length(w) > 3 AND w NOT IN ({', '.join(q(w) for w in lx.KEYWORD_STOP)})) AS toks FROM enriched),
tokpos AS (SELECT review_id, place_id, issue_category, unnest(toks) AS w, unnest(range(1, len(toks) + 1)) AS p FROM tok),
kwc AS (SELECT review_id, place_id, issue_category, w, count(*) AS n, min(p) AS p FROM tokpos GROUP BY ALL),
kwr AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY n DESC,
   CASE WHEN regexp_full_match(w, '0|[1-9][0-9]{{0,9}}') AND try_cast(w AS BIGINT) < 4294967295 THEN try_cast(w AS BIGINT) ELSE 1099511627776 END, p) AS kr FROM kwc),
kw AS (SELECT review_id, place_id, issue_category, w, kr FROM kwr WHERE kr <= 5)"""


_poi = ", ".join(f"CAST((k*{m} + k // 7) % 3 AS DOUBLE) AS {f}" for f, m in ad.POI_FIELDS)
_tot = " + ".join(f for f, _ in ad.POI_FIELDS)
CELLS = f"""cells0 AS (SELECT k // {ad.CELLS_PER_PARK} AS park_id, k AS seq, 'cell' || lpad(CAST(k AS VARCHAR), 9, '0') AS h3_id,
  {ad.LNG0}e0 + ((k % 900) % 30) / 300e0 AS min_lng, {ad.LAT0}e0 + ((k % 900) // 30) / 1000e0 * 3e0 AS min_lat,
  {ad.LNG0}e0 + ((k % 900) % 30 + 1) / 300e0 AS max_lng, {ad.LAT0}e0 + ((k % 900) // 30 + 1) / 1000e0 * 3e0 AS max_lat,
  CAST((k*31) % 4000 AS DOUBLE) AS population, CAST(100000 + (k*17) % 10000 AS DOUBLE) AS hex_area_m2,
  CAST(100000 + (k*17) % 10000 AS DOUBLE) / 1000000e0 AS hex_area_km2,
  CAST((k*11) % 80 AS DOUBLE) AS building_coverage_pct, CAST((k*7) % 40 AS DOUBLE) AS green_coverage_pct,
  CAST((k*13) % 300 AS DOUBLE) AS building_count,
  CASE WHEN k % 5 = 0 THEN CAST(100000 + (k*17) % 10000 AS DOUBLE) * ((k*23) % 60) / 100e0 ELSE 0e0 END AS park_area_m2,
  CAST((k*29) % 6000 AS DOUBLE) AS road_length_m, CAST((k*37) % 9000 AS DOUBLE) AS real_road_length_m, {_poi},
  CAST((k*53) % 12 AS DOUBLE) AS intersection_count_hex, CAST((k*59) % 8 AS DOUBLE) AS barrier_score_hex,
  CASE WHEN k % 7 <> 0 THEN ((k*41) % 600) / 10e0 END AS walking_time_to_park_minutes,
  CASE WHEN k % 7 <> 0 THEN ((k*41) % 600) * 8e0 END AS network_distance_to_park_m,
  CASE WHEN k % 7 <> 0 AND k % 13 <> 0 THEN 0.5e0 + ((k*43) % 50) / 100e0 END AS route_directness_ratio,
  CASE WHEN k % 9 <> 0 THEN CAST((k*47) % 1200 AS DOUBLE) END AS nearest_bus_stop_distance_m
  FROM (SELECT c_custkey AS k FROM customer)),
cells AS (SELECT *, {_tot} AS amenity_total, building_coverage_pct / 100e0 * hex_area_m2 AS building_area_m2,
  population / hex_area_km2 AS pop_density_km2, road_length_m / hex_area_km2 AS road_density_m_per_km2,
  real_road_length_m / hex_area_km2 AS real_road_density_m_per_km2, (min_lng + max_lng) / 2e0 AS lng, (min_lat + max_lat) / 2e0 AS lat, {ad.CENTER[0]}e0 AS center_lng, {ad.CENTER[1]}e0 AS center_lat FROM cells0)"""

SITE = f"""{CELLS},
site0 AS (SELECT * REPLACE (CAST(50 + (seq*17) % 51 AS DOUBLE) AS hex_area_m2, CAST(50 + (seq*17) % 51 AS DOUBLE) / 1000000e0 AS hex_area_km2, CAST(50 + (seq*17) % 51 AS DOUBLE) AS park_area_m2) FROM cells),
site AS (SELECT * REPLACE (building_coverage_pct / 100e0 * hex_area_m2 AS building_area_m2) FROM site0)"""

POINTS = f"""points AS (SELECT event_id // {ad.POINTS_PER_PARK} AS park_id, event_id AS feature_id,
  CASE event_type {' '.join(f'WHEN {q(a)} THEN {q(b)}' for a, b in ad.LAYERS.items())} END AS layer,
  {ad.LNG0}e0 + (event_id % 1000) / 10000e0 AS lng, {ad.LAT0}e0 + ((event_id*37) % 900) / 10000e0 AS lat, props FROM events)"""

_hw = "[" + ", ".join(q(h) for h in ad.HIGHWAYS) + "]"
ROADS = f"""roads AS (SELECT * FROM (SELECT l_orderkey // {ad.EDGES_PER_NETWORK} AS park_id, l_orderkey*8 + l_linenumber AS segment_id,
  l_partkey % 500 AS u, (l_suppkey*7 + l_linenumber) % 500 AS v, l_quantity AS length, ({_hw})[l_linenumber] AS highway FROM lineitem) WHERE u <> v)"""

HAVERSINE_R = 6371008.8
HAVERSINE_ETL_R = 6371000.0


def haversine(lng1, lat1, lng2, lat2, r=HAVERSINE_R):
    return (f"(2e0 * {float(r)!r}e0 * asin(least(1e0, sqrt(pow(sin((({lat2}) - ({lat1})) * pi() / 360e0), 2) + "
            f"cos(({lat1}) * pi() / 180e0) * cos(({lat2}) * pi() / 180e0) * pow(sin((({lng2}) - ({lng1})) * pi() / 360e0), 2)))))")
