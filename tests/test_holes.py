"""Holes that the driver tables don't have: companies never scored or fetched, and missing quarters."""
import datetime as dt

from pyspark.sql import functions as F

from quarterdeck.operators import changes
from quarterdeck.operators.periods import trailing_year
from quarterdeck.config import PERIOD_FIELDS
from quarterdeck.plans import marts

D = dt.date.fromisoformat


def test_companies_without_a_score_stay(spark):
    day = D("2001-01-01")
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "companies": frame([(1, "A", "a", True), (2, "B", "b", True), (3, "C", "c", False)], "cik long, ticker string, name string, is_active boolean"),
        "company_industry": frame([(1, "x"), (2, "x"), (3, "x")], "cik long, industry_slug string"),
        "market_data": frame([(2, 5.0, day)], "cik long, market_cap double, date date"),
        "scores": frame([(1, day, 50.0, 1.0, "EMERGING")], "cik long, as_of date, score double, completeness double, category string"),
        "score_factors": frame([(1, day, "revenue_growth", 0.5)], "cik long, as_of date, factor_key string, raw double"),
        "red_flags": frame([(1, day, "CRITICAL")], "cik long, as_of date, severity string"),
    }
    rows = marts.company_rows(tables)
    got = {r["cik"]: (r["score"], r["category"], r["market_cap"], r["revenue_growth"], r["critical_count"], r["warning_count"]) for r in rows.collect()}
    assert got == {1: (50.0, "EMERGING", None, 0.5, 1, 0), 2: (None, None, 5.0, None, 0, 0)}
    assert [r["cik"] for r in marts.candidates(rows).collect()] == [1]


def test_companies_never_fetched(spark):
    members = spark.createDataFrame([(1,), (2,), (3,)], "cik long")
    cover = spark.createDataFrame([(1, D("2001-11-01"), D("2001-11-01"), 900), (2, D("2001-11-01"), None, 0)], "cik long, latest date, api_latest date, api_facts long")
    state = spark.createDataFrame([(1, "now"), (2, None)], "cik long, tags_fingerprint string")
    plan = changes.refetch_plan(members, cover, state, "2001-11-15", F.lit("now"), 10)
    assert {r["cik"]: list(r["nets"]) for r in plan.collect()} == {2: ["api_stale", "thin", "tag_set"], 3: ["stale", "api_stale", "tag_set"]}
    assert [r["cik"] for r in changes.stale(members, cover, "2001-11-15").collect()] == [3]
    assert [r["cik"] for r in changes.thin(members, cover, 10).collect()] == [2]


def test_a_missing_quarter_gives_no_trailing_year(spark):
    ends = [D(f"{y}-{m}") for y in (1999, 2000) for m in ("03-31", "06-30", "09-30", "12-31")]
    schema = "cik long, period_end date, period_type string, " + ", ".join(f"{f} double" for f in PERIOD_FIELDS)
    rows = [(cik, end, "Q", *[1.0] * len(PERIOD_FIELDS)) for cik in (1, 2) for end in ends if (cik, end) != (2, D("2000-03-31"))]
    got = {(r["cik"], r["period_end"]) for r in trailing_year(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, end) for end in ends[3:]} | {(2, ends[3])}
