"""Shared frames of the registered queries, and the statements the checks build on."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarterdeck.config import FLOW_FIELDS, PERIOD_FIELDS
from quarterdeck.functions.metrics import measured
from quarterdeck.operators.checkpoint import cut
from quarterdeck.operators.peers import industry_stats
from quarterdeck.operators.periods import trailing_year
from quarterdeck.plans import snapshot as snap
from quarterdeck.queries.adapter import AS_OF
from quarterdeck.queries.registry import ORACLE

DAY = f"DATE '{AS_OF}'"


def r(c, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def periods(t) -> DataFrame:
    """Quarterly, annual and trailing-year rows in one table."""
    return t.a_q.unionByName(t.a_annual).unionByName(trailing_year(t.a_q))


def base(t) -> DataFrame:
    return measured(snap.base_snapshot(t.a_company, t.a_ci, t.a_industry, periods(t), t.a_market))


def full(t) -> DataFrame:
    """The complete snapshot. It is read several times from here on, so it is written out first."""
    rows = cut(base(t))
    return rows.join(industry_stats(rows), "industry_slug", "left")


def curve_sql(x: str, points) -> str:
    """CASE form of a piecewise-linear curve."""
    out = f"CASE WHEN {x} <= {points[0][0]!r} THEN {float(points[0][1])!r}"
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        x0, y0, x1, y1 = map(float, (x0, y0, x1, y1))
        out += f" WHEN {x} <= {x1!r}::DOUBLE THEN {y0!r}::DOUBLE + ({x} - {x0!r}::DOUBLE) / ({x1!r}::DOUBLE - {x0!r}::DOUBLE) * ({y1!r}::DOUBLE - {y0!r}::DOUBLE)"
    return out + f" WHEN {x} IS NOT NULL THEN {float(points[-1][1])!r} END::DOUBLE"


def yoy_sql(a: str, b: str) -> str:
    return f"(CASE WHEN {b} > 0 THEN {a} / {b} - 1 END)"


def ratio_sql(a: str, b: str) -> str:
    return f"(CASE WHEN {b} > 0 THEN {a} / {b} END)"


_lags = ", ".join(f"{f} + lag({f}, 1) OVER w + lag({f}, 2) OVER w + lag({f}, 3) OVER w AS {f}" for f in FLOW_FIELDS)
ORACLE["o_ttm0"] = f"""
SELECT cik, period_end, 'TTM' AS period_type, {_lags}, cash, total_debt, equity, shares_diluted, shares_outstanding,
       date_diff('day', lag(period_end, 3) OVER w, period_end) AS span
FROM a_q WINDOW w AS (PARTITION BY cik ORDER BY period_end)"""
ORACLE["o_ttm"] = f"""
SELECT cik, period_end, period_type, {', '.join('ocf - capex AS fcf' if f == 'fcf' else f for f in PERIOD_FIELDS)}
FROM o_ttm0 WHERE span BETWEEN 240 AND 310"""
_all = f"cik, period_end, period_type, {', '.join(PERIOD_FIELDS)}"
ORACLE["o_periods"] = f"SELECT {_all} FROM a_q UNION ALL SELECT {_all} FROM a_annual UNION ALL SELECT {_all} FROM o_ttm"
ORACLE["o_market"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY date DESC) AS rn FROM a_market) x WHERE rn = 1"""
for _n, _src in {"t": "o_ttm", "q": "a_q", "a": "a_annual"}.items():
    ORACLE[f"o_arr_{_n}"] = f"SELECT cik, list(p ORDER BY p.period_end DESC) AS {_n} FROM {_src} p GROUP BY cik"
ORACLE["o_snap"] = """
SELECT c.cik, c.ticker, c.name, ci.industry_slug, ci.theme_slug, ci.source, i.tam_usd, i.tam_cagr, m.price, m.market_cap,
       m.shares_outstanding AS mkt_shares, m.shares_basis, m.date AS price_date, t.t, q.q, a.a,
       t.t[1] AS t0, t.t[5] AS t4, t.t[13] AS t12
FROM a_company c JOIN a_ci ci ON ci.cik = c.cik LEFT JOIN a_industry i ON i.slug = ci.industry_slug
LEFT JOIN o_market m ON m.cik = c.cik LEFT JOIN o_arr_t t ON t.cik = c.cik LEFT JOIN o_arr_q q ON q.cik = c.cik
LEFT JOIN o_arr_a a ON a.cik = c.cik WHERE c.is_active"""
_g = [yoy_sql(f"q[{i}].revenue", f"q[{i + 4}].revenue") for i in range(1, 5)]
ORACLE["o_trend"] = """
SELECT cik, CASE WHEN count(gm) = 8 THEN regr_slope(gm, 8 - rn) * 4 * 10000 END AS m_trend,
       CASE WHEN count(gm) = 8 AND avg(gm) > 0 THEN 1 - stddev_samp(gm) / avg(gm) END AS gm_stable
FROM (SELECT cik, row_number() OVER (PARTITION BY cik ORDER BY period_end DESC) AS rn,
             CASE WHEN revenue > 0 THEN gross_profit / revenue END AS gm FROM a_q) x WHERE rn <= 8 GROUP BY cik"""
INVESTED = "({p}.total_debt + {p}.equity - {p}.cash)"
GROSS = "(abs({p}.total_debt) + abs({p}.equity) + abs({p}.cash))"


def roic_sql(p: str) -> str:
    inv, gross = INVESTED.format(p=p), GROSS.format(p=p)
    return f"(CASE WHEN {inv} > 0 AND {inv} / {gross} >= 0.1 THEN {p}.operating_income * (1 - 0.21::DOUBLE) / {inv} END)"


ORACLE["o_met"] = f"""
SELECT s.*, {yoy_sql('t0.revenue', 't4.revenue')} AS m_growth,
       CASE WHEN t0.revenue > 0 AND t12.revenue > 0 THEN pow(t0.revenue / t12.revenue, 1.0::DOUBLE / 3) - 1 END AS m_cagr,
       CASE WHEN len(q) >= 8 THEN ({_g[0]} + {_g[1]}) / 2 - ({_g[2]} + {_g[3]}) / 2 END AS m_accel,
       {ratio_sql('t0.gross_profit', 't0.revenue')} AS m_gross_margin,
       {ratio_sql('t0.operating_income', 't0.revenue')} AS m_operating_margin,
       {ratio_sql('t0.fcf', 't0.revenue')} AS m_fcf_margin, o_trend.m_trend, o_trend.gm_stable, {roic_sql('t0')} AS m_roic,
       CASE WHEN t0.fcf < 0 THEN t0.cash / (-t0.fcf / 4) END AS m_runway,
       CASE WHEN market_cap > 0 THEN (t0.cash - t0.total_debt) / market_cap END AS m_net_cash,
       CASE WHEN t0.operating_income > 0 THEN t0.total_debt / t0.operating_income END AS m_leverage,
       {yoy_sql('(t0.gross_profit - t0.operating_income)', '(t4.gross_profit - t4.operating_income)')} AS m_opex_growth
FROM o_snap s LEFT JOIN o_trend ON o_trend.cik = s.cik"""
ORACLE["o_stats"] = """
SELECT industry_slug, count(*) AS candidate_count, median(m_gross_margin) AS median_gross_margin,
       median(m_growth) AS median_revenue_growth FROM o_met GROUP BY industry_slug"""
ORACLE["o_full"] = """
SELECT m.*, s.candidate_count, s.median_gross_margin, s.median_revenue_growth
FROM o_met m JOIN o_stats s ON s.industry_slug = m.industry_slug"""
