"""Readers, writes, statistics and scoring rules on small invented rows."""
import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from quarterdeck import schemas
from quarterdeck.config import PERIOD_FIELDS, SCORING
from quarterdeck.functions import scalars as sc
from quarterdeck.functions.metrics import measured
from quarterdeck.operators import distribution, factors, quality, valuation
from quarterdeck.plans import normalize, snapshot, writes
from quarterdeck.sources import companyfacts, filings, reference, taxonomy

D = dt.date.fromisoformat


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_curve_edges(spark):
    pts = [(0, 0.0), (10, 1.0), (20, 0.5)]
    xs = [(-1.0, 0.0), (0.0, 0.0), (5.0, 0.5), (10.0, 1.0), (15.0, 0.75), (99.0, 0.5), (None, None)]
    df = spark.createDataFrame(xs, "x double, y double")
    assert all(r.got == r.y for r in df.select("y", sc.curve("x", pts).alias("got")).collect())


def test_guards(spark):
    assert one(spark, sc.yoy(F.lit(5.0), F.lit(0.0))) is None and one(spark, sc.yoy(F.lit(5.0), F.lit(-1.0))) is None
    assert one(spark, sc.cagr(F.lit(-1.0), F.lit(2.0), 3)) is None and one(spark, sc.ratio(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, sc.same_number(F.lit(1000.0), F.lit(1004.0))) and not one(spark, sc.same_number(F.lit(1000.0), F.lit(1006.0)))


def test_exact_statistics_of_a_hot_group(spark):
    rng = random.Random(7)
    rows = [("hot", float(rng.randint(0, 50))) for _ in range(3000)] + [("b", 1.5), ("b", 2.5), ("c", None)] + [("d", 4.0)] * 5
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    med = {r.g: r["median"] for r in distribution.median(df, ["g"], "v").collect()}
    mad = {r.g: r["mad"] for r in distribution.median_deviation(df, ["g"], "v").collect()}
    for g, vs in groups.items():
        assert med[g] == statistics.median(vs)
        assert mad[g] == statistics.median([abs(v - statistics.median(vs)) for v in vs])
    assert set(med) == {"hot", "b", "d"}
    rank = lambda **kw: {(r.g, r.v): (r.n_at, r.n_below, r.n_total) for r in distribution.value_ranks(df, ["g"], "v", **kw).collect()}
    assert rank(slice_rows=7) == rank() == {(g, v): (vs.count(v), sum(x < v for x in vs), len(vs)) for g, vs in groups.items() for v in vs}
    probes = spark.createDataFrame([("hot", 25.3), ("b", 0.0), ("b", 9.0), ("zzz", 1.0)], "g string, v double")
    got = {(r.g, r.v): r.percentile for r in distribution.percentiles(df, ["g"], "v", probes).collect()}
    assert got[("hot", 25.3)] == sum(v < 25.3 for v in groups["hot"]) / 3000
    assert got[("b", 0.0)] == 0 and got[("b", 9.0)] == 1 and got[("zzz", 1.0)] is None


def quarter_files(folder, num, sub="A1\t1\tX\t10-K\t20010301\nA2\tx\tX\t10-K\t20010301\nA3\t9\tX\t10-K\t20010301\n", header="adsh\ttag\tddate\tqtrs\tuom\tsegments\tcoreg\tvalue\n"):
    folder.mkdir()
    (folder / "sub.txt").write_text("adsh\tcik\tname\tform\tfiled\n" + sub)
    (folder / "num.txt").write_text(header + num)


def test_filing_files_and_damaged_quarters(spark, tmp_path):
    fact = "A1\tRevenues\t20001231\t4\tUSD\t\t\t5\n"
    quarter_files(tmp_path / "2001q1", fact + "A1\tRevenues\t20001231\t4\tUSD\tSeg=A\t\t3\nA1\tRevenues\t20001231\t4\tEUR\t\t\t5\nA1\tUnknown\t20001231\t4\tUSD\t\t\t5\n"
                  "A3\tRevenues\t20001231\t4\tUSD\t\t\t5\nA1\tRevenues\t20001231\t\tUSD\t\t\t5\nA1\tNetIncomeLoss\t20001231\nA1\tNetIncomeLoss\t20001231\t4\tUSD\t\t\t5\textra\n")
    quarter_files(tmp_path / "2001q2", fact.replace("\t5\n", "\n"), header="adsh\ttag\tddate\tqtrs\tuom\tsegments\tcoreg\n")
    quarter_files(tmp_path / "2001q3", "A1\tRevenues\n")
    quarter_files(tmp_path / "2001q4", "")
    quarter_files(tmp_path / "2002q1", "")
    (tmp_path / "2002q1" / "num.txt").unlink()
    import gzip
    packed = gzip.compress((("adsh\ttag\tddate\tqtrs\tuom\tsegments\tcoreg\tvalue\n") + fact * 5000).encode())
    (tmp_path / "2002q1" / "num.txt").mkdir()
    (tmp_path / "2002q1" / "num.txt" / "part.gz").write_bytes(packed[: len(packed) // 2])  # cut off in transit
    quarters = [D(x) for x in ("2001-01-01", "2000-10-01", "2001-04-01", "2001-07-01", "2001-10-01", "2002-01-01")]
    facts, report = filings.load_bulk(spark, str(tmp_path), quarters, spark.createDataFrame([(1,)], "cik long"))
    rows = facts.collect()
    assert len(rows) == 1 and rows[0].cik == 1 and rows[0].period_end == D("2000-12-31") and rows[0].source == "bulk"
    got = {r.quarter: r for r in report.collect()}
    assert (got["2001q1"].status, got["2001q1"].lines, got["2001q1"].broken_lines, got["2001q1"].facts) == ("loaded", 8, 2, 1)
    assert {q for q, r in got.items() if r.status == "failed"} == {"2000q4", "2001q2", "2001q3", "2001q4", "2002q1"}
    assert "FileNotFoundError" in got["2000q4"].error and "value" in got["2001q2"].error and "no usable line" in got["2001q3"].error
    none, report = filings.load_bulk(spark, str(tmp_path), quarters[1:2], spark.createDataFrame([(1,)], "cik long"))
    assert none.count() == 0 and report.count() == 1 and none.columns == facts.columns
    with pytest.raises(ValueError, match="value"):
        filings.require_columns(spark.createDataFrame([("a",)], "adsh string"), "num.txt", ["adsh", "value"])


def test_recent_quarters(spark):
    got = one(spark, filings.recent_quarters(F.lit("2026-02-10").cast("date"), 3))
    assert [d.isoformat() for d in got] == ["2025-10-01", "2025-07-01", "2025-04-01"]


def test_company_document(spark, tmp_path):
    doc = tmp_path / "c.json"
    doc.write_text('{"cik": "0000000320", "facts": {"us-gaap": {"Revenues": {"units": {"USD": [{"start": "2000-01-01", "end": "2000-12-31", "val": 9, "form": "10-K", "filed": "2001-02-01", "accn": "z"},'
                   '{"end": "2000-12-31", "val": 9, "form": "10-K", "filed": "2001-02-01"}]}}, "Other": {"units": {"USD": []}}}}}')
    rows = companyfacts.read_company_facts(spark, str(doc)).collect()
    assert [(r.cik, r.tag, r.qtrs, r.value, r.source) for r in rows] == [(320, "Revenues", 4, 9.0, "api")]


def test_listing_lines(spark, tmp_path):
    f = tmp_path / "l.txt"
    f.write_text("Nasdaq Traded|Symbol|Security Name|Listing Exchange|Market Category|ETF|Round Lot Size|Test Issue|Financial Status|CQS|NASDAQ|Next\n"
                 "Y|AA|Alpha - Common Stock|Q|Q|N|100|N||AA|AA|N\n\nshort|line\nFile Creation Time: 1|||||||||||\n")
    rows = reference.read_listings(spark, str(f)).collect()
    assert [(r.ticker, r.is_etf, r.financial_status, r.round_lot) for r in rows] == [("AA", False, None, 100.0)]


def test_taxonomy_is_consistent(spark):
    tax = taxonomy.check_taxonomy(taxonomy.load_taxonomy(spark, ["6770"]))
    assert tax.industries.count() == 49 and tax.sic_map.count() == 91
    tax.sic_map = tax.sic_map.where("sic <> '1090'")
    with pytest.raises(ValueError, match="1090"):
        taxonomy.check_taxonomy(tax)


def test_rerun_replaces_its_date_only(spark, tmp_path):
    flags = lambda rows: spark.createDataFrame(rows, "cik long, as_of date, code string")
    writes.write_run({"red_flags": flags([(1, D("2001-01-01"), "A"), (1, D("2001-02-01"), "A"), (1, D("2001-02-01"), "B")])}, str(tmp_path))
    writes.write_run({"red_flags": flags([(1, D("2001-02-01"), "B")])}, str(tmp_path))
    assert sorted((str(r.as_of), r.code) for r in writes.read_table(spark, f"{tmp_path}/red_flags").collect()) == [("2001-01-01", "A"), ("2001-02-01", "B")]


def test_failure_guard(spark):
    rows = lambda bad, n: spark.createDataFrame([(i, i < bad) for i in range(n)], "cik long, failed boolean")
    normalize.guard_failures(rows(10, 20))
    normalize.guard_failures(rows(19, 19))
    with pytest.raises(RuntimeError, match="11 of 20"):
        normalize.guard_failures(rows(11, 20))


ENDS = [D(f"{y}-{m}") for y in range(1994, 2001) for m in ("03-31", "06-30", "09-30", "12-31")]


def company(spark, cap=3e9, price=10.0, **over):
    """One company with 13 trailing, 8 quarterly and 8 annual rows; ``over`` maps field to a value or to a function of the row's age."""
    base = dict(revenue=1e9, gross_profit=5e8, operating_income=2e8, net_income=1e8, ocf=2e8, capex=5e7, fcf=1.5e8, cash=1e8, total_debt=2e8, equity=9e8,
                shares_diluted=1e8, shares_outstanding=1e8, sbc=1e7, rd_expense=5e7)
    base["revenue"] = lambda i: 1e9 * 0.98 ** i
    base.update(over)
    value = lambda f, i: base[f](i) if callable(base[f]) else base[f]
    rows = [(1, ENDS[-1 - i], kind, *[value(f, i) for f in PERIOD_FIELDS]) for kind, n in (("TTM", 13), ("Q", 8), ("A", 8)) for i in range(n)]
    arrays = __import__("quarterdeck.operators.periods", fromlist=["x"]).period_arrays(spark.createDataFrame(rows, schemas.PERIOD))
    df = arrays.withColumns({"market_cap": F.lit(cap).cast("double"), "price": F.lit(price).cast("double"), "shares_outstanding": F.lit(1e8),
                             "industry_slug": F.lit("x"), "tam_usd": F.lit(None).cast("double"), "tam_cagr": F.lit(0.1), "candidate_count": F.lit(5),
                             "median_gross_margin": F.lit(0.4), "median_revenue_growth": F.lit(0.1)})
    return measured(df)


def factor_points(spark, key, **over):
    return factors.one_factor(quality.with_flags(company(spark, **over)), key).first().points


@pytest.mark.parametrize("reason, over", [
    ("NON_POSITIVE_REVENUE", dict(revenue=0.0)), ("NOT_CASH_GENERATIVE", dict(fcf=-1.0, operating_income=-1.0)),
    ("NO_BALANCE_SHEET_DATA", dict(cash=None)), ("GROWTH_NOT_PROJECTABLE", dict(revenue=lambda i: 1e9 * 0.5 ** i)),
    ("INSUFFICIENT_REVENUE_HISTORY", dict(revenue=lambda i: 1e9 if i < 4 else None)),
    ("MARGIN_NOT_ANCHORABLE", dict(fcf=lambda i: 1.5e8 if i == 0 else -1e8)), (None, {}),
])
def test_refusal_reasons(spark, reason, over):
    r = valuation.with_price_status(valuation.with_fair_value(company(spark, **over))).first()
    assert r.fair_value_reason == reason and (r.per_share is None) == (reason is not None)


def test_moat_and_uncertainty(spark):
    strong = valuation.with_uncertainty(valuation.with_moat(company(spark))).first()
    assert (strong.moat_signal, strong.moat_periods_evaluated, strong.moat_periods_clearing) == ("PERSISTENT", 8, 8)
    losing = valuation.with_moat(company(spark, operating_income=lambda i: 2e8 if i < 4 else -1e8)).first()
    assert losing.moat_signal == "INTERMITTENT" and losing.moat_periods_evaluated == 8
    blind = valuation.with_uncertainty(valuation.with_moat(company(spark, total_debt=None, rd_expense=None))).first()
    assert blind.moat_reason == "MISSING_FINANCIALS" and blind.uncertainty_score > strong.uncertainty_score


def test_evidence_never_lowers_the_balance_sheet_factor(spark):
    full = factor_points(spark, "balance_sheet")
    assert full > factor_points(spark, "balance_sheet", cash=None) and full > factor_points(spark, "balance_sheet", operating_income=-1.0)


def test_damping_never_raises_a_score(spark):
    small = factor_points(spark, "revenue_growth", revenue=lambda i: 6e6 * 0.98 ** i)
    assert small < factor_points(spark, "revenue_growth")


def test_gates_of_the_size_factor(spark):
    key, weight = "market_cap_opportunity", SCORING["market_cap_opportunity"]["weight"]
    assert factor_points(spark, key, cap=5e8) == weight and factor_points(spark, key, cap=5e8, sbc=4e8) == weight / 2
    assert factor_points(spark, key, cap=5e8, revenue=lambda i: 1e9 * 1.1 ** i) == 0 and factor_points(spark, key, cap=None) is None


def test_flags(spark):
    flags = lambda **o: {f.code for f in quality.with_flags(company(spark, **o)).first().flags}
    assert flags() == set()
    assert "NEGATIVE_EQUITY_BURN" in flags(equity=-1.0, fcf=-1e6) and "RUNWAY_CRITICAL" in flags(fcf=-1e9) and "LEVERAGE_HIGH" in flags(total_debt=2e9)
