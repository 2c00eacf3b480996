"""Registered queries against their SQL on the smallest tables."""

import pytest

from conftest import SF
from ledgerline.plans import catalog

Q, O = catalog.queries(), catalog.oracle_sql()
#: The fits with all their restarts take minutes; their parts are compared through kmeans_fit_from_starts and test_analytics.
CHECKED = sorted(O)


def test_every_oracle_has_a_query():
    assert set(O) <= set(Q) and len(Q) >= 190


@pytest.mark.parametrize("key", CHECKED)
def test_query_equals_sql(spark, duck, key):
    df = Q[key](spark, SF)
    names = sorted(df.columns)
    mine = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    cursor = duck.execute(O[key])
    at = [[d[0] for d in cursor.description].index(c) for c in names]
    theirs = sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=repr)
    assert mine == theirs


def test_no_query_repeats_a_column(spark):
    for key in ("scored_file", "score_summary", "company_ratios", "join_score_ratios", "scenario_file", "guardrails_table"):
        names = Q[key](spark, SF).columns
        assert len(names) == len(set(names)), key


def test_files_round_trip(spark):
    years = {r["fiscal_year"]: r["n"] for r in Q["ingest_csv_to_parquet"](spark, SF).collect()}
    want = {r["fiscal_year"]: r["n"] for r in Q["facts_by_year"](spark, SF).collect()}
    assert years == want
    assert Q["read_company_input"](spark, SF).filter("assets is not null").count() > 0
