"""Registry contract and a sample of queries against DuckDB on the smallest scale."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = ["enriched_reviews", "review_keywords", "issue_impact", "health_score", "tfidf_terms", "topic_cooccurrence_edges", "points_to_cells", "cell_scores", "routing_edges", "road_stats", "monthly_climate", "cut_fill", "compiled_rules", "program_attributes"]
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 150 and all(callable(f) for f in q.values())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def norm(rows, cols):
    order = [cols.index(c) for c in sorted(cols)]
    return sorted(repr(tuple(r[i] + 0.0 if isinstance(r[i], float) else r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_duckdb(spark, scratch, name):
    con = duckdb.connect(config={"temp_directory": scratch})
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert norm([tuple(r) for r in df.collect()], df.columns) == norm(cur.fetchall(), cols)


def test_changed_weight_turns_the_oracle_red(spark, scratch, monkeypatch):
    from sylvan.functions import formulas as fm

    real = fm.cell_formulas()
    monkeypatch.setattr(fm, "cell_formulas", lambda *a, **k: {**real, "heat_score": real["heat_score"].replace("0.7e0", "0.6e0")})
    with pytest.raises(AssertionError):
        test_matches_duckdb(spark, scratch, "cell_scores")
