"""Fair value, price status, persistence and uncertainty (V)."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarterdeck.config import COMPLETENESS_FIELDS, SCORING, VALUATION
from quarterdeck.operators import valuation as val
from quarterdeck.queries.common import INVESTED, GROSS, ORACLE, base, curve_sql, r, yoy_sql
from quarterdeck.queries.registry import query

_mar = "list_filter(list_transform(a[1:8], lambda p: CASE WHEN p.revenue > 0 THEN {} END), lambda v: v IS NOT NULL)"
ORACLE["o_in0"] = f"""
SELECT *, coalesce(0.6::DOUBLE * m_growth + 0.4::DOUBLE * m_cagr, m_growth, m_cagr) AS g0,
       CASE WHEN m_growth IS NOT NULL AND m_cagr IS NOT NULL THEN 'blend' WHEN m_growth IS NOT NULL THEN 'ttm_yoy_only' WHEN m_cagr IS NOT NULL THEN 'cagr_3y_only' END AS g_src,
       CASE WHEN m_fcf_margin > 0 THEN m_fcf_margin ELSE m_operating_margin * (1 - 0.21::DOUBLE) END AS m0,
       CASE WHEN m_fcf_margin > 0 THEN 'fcf' ELSE 'nopat_proxy' END AS m_src,
       CASE WHEN t0.shares_diluted > 0 THEN t0.shares_diluted WHEN mkt_shares > 0 THEN mkt_shares END AS shares,
       t0.cash - t0.total_debt AS net_cash,
       CASE WHEN m_fcf_margin > 0 THEN {_mar.format('p.fcf / p.revenue')} ELSE {_mar.format('p.operating_income / p.revenue * (1 - 0.21::DOUBLE)')} END AS seen
FROM o_met"""
ORACLE["o_in1"] = "SELECT *, coalesce(len(seen), 0) AS periods, list_aggregate(seen, 'median') AS mature FROM o_in0"
_steps, _acc = [], "1"
for _y, _w in enumerate((0.8, 0.6, 0.4, 0.2, 0.0), 1):
    _acc += f" * (1 + (0.025::DOUBLE + {_w}::DOUBLE * (g0 - 0.025::DOUBLE)))"
    _steps.append(f"{_acc} AS x{_y}")
ORACLE["o_in2"] = f"""
SELECT *, CASE WHEN mature > 0 THEN list_aggregate(list_transform(seen, lambda v: abs(v - mature)), 'median') / mature END AS dispersion, {', '.join(_steps)} FROM o_in1"""
_flow = [f"(t0.revenue * x{y} * (mature + {w}::DOUBLE * (m0 - mature)))" for y, w in enumerate((0.8, 0.6, 0.4, 0.2, 0.0), 1)]
_ev = " + ".join(f"{x} / pow(1.09::DOUBLE, {y})" for y, x in enumerate(_flow, 1)) + f" + {_flow[4]} * 1.025::DOUBLE / (0.09::DOUBLE - 0.025::DOUBLE) / pow(1.09::DOUBLE, 5)"
ORACLE["o_fair"] = f"""
SELECT *, CASE WHEN reason IS NULL THEN ev END AS enterprise_value, CASE WHEN reason IS NULL THEN ev + net_cash END AS equity_value,
       CASE WHEN reason IS NULL THEN (ev + net_cash) / shares END AS per_share FROM (
SELECT *, {_ev} AS ev,
       CASE WHEN t0.revenue IS NULL OR t0.revenue <= 0 THEN 'NON_POSITIVE_REVENUE' WHEN g0 IS NULL THEN 'INSUFFICIENT_REVENUE_HISTORY'
            WHEN NOT (coalesce(t0.fcf > 0, false) OR coalesce(t0.operating_income > 0, false)) THEN 'NOT_CASH_GENERATIVE'
            WHEN shares IS NULL THEN 'NO_SHARE_COUNT' WHEN net_cash IS NULL THEN 'NO_BALANCE_SHEET_DATA'
            WHEN x5 > 3 THEN 'GROWTH_NOT_PROJECTABLE'
            WHEN periods < 4 OR mature <= 0 OR dispersion > 1 THEN 'MARGIN_NOT_ANCHORABLE' END AS reason FROM o_in2) x"""


def fair(t):
    return val.with_fair_value(base(t))


@query("V1_mature_margin", """SELECT cik, m_src AS basis, CAST(periods AS INT) AS periods, round(mature, 6) AS mature_margin, round(dispersion, 6) AS dispersion,
  coalesce(periods >= 4 AND mature > 0 AND dispersion <= 1, false) AS anchored FROM o_in2""")
def v1(t):
    return val.with_inputs(base(t)).select("cik", F.col("v_margin_source").alias("basis"), F.col("v_periods").alias("periods"), r("v_mature").alias("mature_margin"),
                                           r("v_dispersion").alias("dispersion"), val.anchored().alias("anchored"))


@query("V2_refusal_reason", "SELECT cik, CASE WHEN reason IS NULL THEN 'OK' ELSE 'INSUFFICIENT_DATA' END AS status, reason FROM o_fair")
def v2(t):
    return fair(t).select("cik", F.col("fair_value_status").alias("status"), F.col("fair_value_reason").alias("reason"))


@query("V3_initial_growth", "SELECT cik, round(g0, 6) AS growth, g_src AS growth_source FROM o_in0")
def v3(t):
    return val.with_inputs(base(t)).select("cik", r("v_growth").alias("growth"), F.col("v_growth_source").alias("growth_source"))


@query("V4_revenue_path", f"SELECT cik, {', '.join(f'round(x{y}, 6) AS multiple_{y}' for y in range(1, 6))} FROM o_in2")
def v4(t):
    return val.with_inputs(base(t)).select("cik", *[r(f"v_multiple_{y}").alias(f"multiple_{y}") for y in range(1, 6)])


@query("V5_initial_margin", "SELECT cik, round(m0, 6) AS margin, m_src AS margin_source FROM o_in0")
def v5(t):
    return val.with_inputs(base(t)).select("cik", r("v_margin").alias("margin"), F.col("v_margin_source").alias("margin_source"))


@query("V6_discounted_cash_flow", "SELECT cik, round(enterprise_value, 0) AS enterprise_value, round(equity_value, 0) AS equity_value, round(per_share, 4) AS per_share FROM o_fair")
def v6(t):
    return fair(t).select("cik", r("enterprise_value", 0).alias("enterprise_value"), r("equity_value", 0).alias("equity_value"), r("per_share", 4).alias("per_share"))


_ROUNDED = {"initial_growth_rate": "g0", "mature_fcf_margin": "mature", "mature_margin_dispersion": "dispersion", "initial_fcf_margin": "m0", "implied_revenue_multiple": "x5"}


@query("V7_assumptions", f"""SELECT cik, 5 AS projection_years, 0.09::DOUBLE AS discount_rate, 0.025::DOUBLE AS terminal_growth_rate, g_src AS initial_growth_source, CAST(periods AS INT) AS mature_margin_periods,
  m_src AS initial_margin_source, 0.21::DOUBLE AS tax_rate, net_cash, shares, CASE WHEN t0.shares_diluted > 0 THEN 'diluted' ELSE 'outstanding' END AS shares_source,
  {', '.join(f'round({x}, 6) AS {n}' for n, x in _ROUNDED.items())} FROM o_fair WHERE reason IS NULL""")
def v7(t):
    return fair(t).where("assumptions IS NOT NULL").select("cik", "assumptions.*").withColumns({n: r(n) for n in _ROUNDED})


ORACLE["o_price"] = """
SELECT cik, ratio, CASE WHEN ratio IS NOT NULL THEN (per_share - price) / per_share END AS safety, CASE WHEN ratio IS NULL THEN 'UNAVAILABLE' ELSE 'OK' END AS status,
       CASE WHEN ratio <= 0.85 THEN 'UNDERVALUED' WHEN ratio >= 1.15 THEN 'OVERVALUED' WHEN ratio IS NOT NULL THEN 'FAIRLY_VALUED' END AS valuation_status
FROM (SELECT *, CASE WHEN per_share > 0 AND price > 0 THEN price / per_share END AS ratio FROM o_fair) x"""


@query("V8_price_to_fair_value", "SELECT cik, status, round(ratio, 6) AS ratio, round(safety, 6) AS margin_of_safety, valuation_status FROM o_price")
def v8(t):
    return val.with_price_status(fair(t)).select("cik", F.col("price_status").alias("status"), r("price_ratio").alias("ratio"), r("margin_of_safety").alias("margin_of_safety"), "valuation_status")


_inv, _gross = INVESTED.format(p="p"), GROSS.format(p="p")
ORACLE["o_moat0"] = f"""
SELECT cik, count(*) AS n_annual, sum((kind IN ('M', 'D'))::INT) AS seen, sum((kind = 'M' AND spread > 0)::INT) AS clear,
       sum((kind = 'MISSING')::INT) AS missing, sum((kind IN ('NONPOS', 'SMALL'))::INT) AS na FROM (
  SELECT cik, operating_income * (1 - 0.21::DOUBLE) / {_inv} - 0.09::DOUBLE AS spread,
         CASE WHEN operating_income IS NULL OR {_inv} IS NULL THEN 'MISSING' WHEN {_inv} <= 0 THEN 'NONPOS' WHEN operating_income <= 0 THEN 'D'
              WHEN {_inv} / {_gross} < 0.1 THEN 'SMALL' ELSE 'M' END AS kind,
         row_number() OVER (PARTITION BY cik ORDER BY period_end DESC) AS rn FROM a_annual p) x WHERE rn <= 8 GROUP BY cik"""
ORACLE["o_moat"] = """
SELECT s.cik, CAST(coalesce(seen, 0) AS INT) AS periods_evaluated, CAST(CASE WHEN coalesce(seen, 0) < 4 THEN 0 ELSE clear END AS INT) AS periods_clearing,
       CASE WHEN coalesce(seen, 0) < 4 THEN 'INSUFFICIENT_DATA' WHEN clear / seen >= 0.75 THEN 'PERSISTENT' WHEN clear / seen >= 0.4 THEN 'INTERMITTENT' ELSE 'ABSENT' END AS signal,
       CASE WHEN coalesce(seen, 0) >= 4 THEN NULL WHEN coalesce(n_annual, 0) < 4 THEN 'TOO_FEW_PERIODS' WHEN na = 0 OR seen + missing >= 4 THEN 'MISSING_FINANCIALS' ELSE 'NOT_APPLICABLE' END AS reason
FROM o_snap s LEFT JOIN o_moat0 m ON m.cik = s.cik"""


@query("V9_moat_persistence", "SELECT cik, signal, periods_evaluated, periods_clearing FROM o_moat")
def v9(t):
    return val.with_moat(base(t)).select("cik", F.col("moat_signal").alias("signal"), F.col("moat_periods_evaluated").alias("periods_evaluated"), F.col("moat_periods_clearing").alias("periods_clearing"))


@query("V10_moat_insufficient_reason", "SELECT cik, reason FROM o_moat")
def v10(t):
    return val.with_moat(base(t)).select("cik", F.col("moat_reason").alias("reason"))


u = VALUATION["uncertainty"]
_yoys = "list_filter([" + ", ".join(yoy_sql(f"t[{i}].revenue", f"t[{i + 4}].revenue") for i in range(1, 9)) + "], lambda v: v IS NOT NULL)"
_margins = "list_filter(list_transform(t[1:8], lambda p: CASE WHEN p.revenue > 0 THEN p.operating_income / p.revenue END), lambda v: v IS NOT NULL)"
_sd = "(CASE WHEN len({0}) >= 4 THEN list_aggregate({0}, 'stddev_samp') END)"
_have = "((" + " + ".join(f"(t0.{f} IS NOT NULL)::INT" for f in COMPLETENESS_FIELDS) + ") / 7::DOUBLE)"
ORACLE["o_risk"] = f"""
SELECT cik, {curve_sql('sd_g', u['revenue_curve'])} AS growth_risk, {curve_sql('sd_m', u['margin_curve'])} AS margin_risk,
       1 - {curve_sql('m_leverage', SCORING['balance_sheet']['leverage_curve'])} AS leverage_risk, {curve_sql('have', u['completeness_curve'])} AS completeness_risk
FROM (SELECT cik, m_leverage, {_sd.format(_yoys)} AS sd_g, {_sd.format(_margins)} AS sd_m, {_have} AS have FROM o_met) x"""
_RISKS = ["growth_risk", "margin_risk", "leverage_risk", "completeness_risk"]
_KEYS = ["revenue_predictability", "operating_leverage", "financial_leverage", "data_completeness"]
ORACLE["o_unc"] = f"""
SELECT cik, CASE WHEN n = 0 THEN 1 ELSE total / n END * (n / 4) + (1 - n / 4) AS score FROM (
  SELECT cik, ({' + '.join(f'({c} IS NOT NULL)::INT' for c in _RISKS)})::DOUBLE AS n, {' + '.join(f'coalesce({c}, 0)' for c in _RISKS)} AS total FROM o_risk) x"""


@query("V11_uncertainty_drivers", f"SELECT cik, {', '.join(f'round({c}, 6) AS {c}' for c in _RISKS)} FROM o_risk")
def v11(t):
    return val.with_risks(base(t)).select("cik", *[r(f"risk_{k}").alias(c) for k, c in zip(_KEYS, _RISKS)])


@query("V12_uncertainty_level", """SELECT cik, round(score, 6) AS score, CASE WHEN score >= 0.75 THEN 'SEVERE' WHEN score >= 0.5 THEN 'ELEVATED'
  WHEN score >= 0.25 THEN 'MODERATE' ELSE 'MINIMAL' END AS level FROM o_unc""")
def v12(t):
    return val.with_uncertainty(base(t)).select("cik", r("uncertainty_score").alias("score"), F.col("uncertainty_level").alias("level"))

