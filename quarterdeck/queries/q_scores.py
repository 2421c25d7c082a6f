"""Red flags, factors, totals and peers (Q, G, X)."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarterdeck.config import SCORING

from quarterdeck.operators import factors as fx, peers, quality
from quarterdeck.operators.checkpoint import cut
from quarterdeck.plans import scoring
from quarterdeck.queries.common import ORACLE, base, curve_sql, full, r, ratio_sql, yoy_sql
from quarterdeck.queries.registry import query

S = SCORING
_DIL = yoy_sql("t0.shares_diluted", "t4.shares_diluted")
_DROP = f"({ratio_sql('t4.gross_profit', 't4.revenue')} - m_gross_margin) * 10000"
_SBC = ratio_sql("t0.sbc", "t0.revenue")
FLAGS = {
    "Q1": ("REVENUE_DECLINE_2Y", "CRITICAL", "len(a) >= 3 AND a[1].revenue < a[2].revenue AND a[2].revenue < a[3].revenue", "a[1].revenue", "latest"),
    "Q2": ("NEGATIVE_EQUITY_BURN", "CRITICAL", "t0.equity < 0 AND t0.fcf < 0", "t0.equity", "equity"),
    "Q3": ("RUNWAY_CRITICAL", "CRITICAL", "m_runway < 2", "m_runway", "quarters"),
    "Q4": ("RUNWAY_LOW", "WARNING", "m_runway >= 2 AND m_runway < 6", "m_runway", "quarters"),
    "Q5": ("EXTREME_DILUTION", "CRITICAL", f"{_DIL} > 0.5", _DIL, "ratio"),
    "Q6": ("DILUTION", "WARNING", f"{_DIL} > 0.15 AND {_DIL} <= 0.5", _DIL, "ratio"),
    "Q7": ("GM_COLLAPSE", "WARNING", f"{_DROP} > 500", _DROP, "drop_bps"),
    "Q8": ("SBC_EXCESSIVE", "WARNING", f"{_SBC} > 0.25", _SBC, "ratio"),
    "Q9": ("LEVERAGE_HIGH", "WARNING", "m_leverage > 5", "m_leverage", "ratio"),
}
ORACLE["o_flags"] = "\nUNION ALL\n".join(
    f"SELECT cik, '{code}' AS code, '{severity}' AS severity, {value} AS evidence FROM o_met WHERE {when}"
    for code, severity, when, value, _ in FLAGS.values())


def _flag_query(key, code, severity, when, value, name):
    # every company is listed with the outcome, so that a rule nobody trips is checked as well
    @query(f"{key}_{code.lower()}", f"SELECT cik, coalesce({when}, false) AS raised, round(CASE WHEN {when} THEN {value} END, 4) AS evidence FROM o_met")
    def run(t):
        flag = quality.flag_columns()[key]
        return base(t).select("cik", flag.alias("f")).select("cik", F.col("f").isNotNull().alias("raised"), r(F.col("f.evidence")[name], 4).alias("evidence"))


for _key, _spec in FLAGS.items():
    _flag_query(_key, *_spec)

# ---- factors ---------------------------------------------------------------------------------------------------
DAMP = S["damping_curve"]


def damp_sql(*xs):
    return "least(coalesce(least(" + ", ".join(curve_sql(x, DAMP) for x in xs) + "), 1), 1)"


def qsum(start):
    return "(" + " + ".join(f"q[{i}].revenue" for i in range(start, start + 4)) + ")"


f = S["revenue_growth"]
_yoy = f"({curve_sql('m_growth', f['curve'])} * {damp_sql('t4.revenue', 't0.revenue')})"
_cagr = f"({curve_sql('m_cagr', f['curve'])} * {damp_sql('t12.revenue', 't0.revenue')})"
NORM = {"revenue_growth": (f"coalesce(0.6::DOUBLE * {_yoy} + 0.4::DOUBLE * {_cagr}, {_yoy}, {_cagr})", "coalesce(m_growth, m_cagr)")}
NORM["revenue_acceleration"] = (f"{curve_sql('m_accel', S['revenue_acceleration']['curve'])} * {damp_sql(qsum(5), qsum(1))}", "m_accel")
f = S["tam_industry_growth"]
_tam = "coalesce(tam_cagr, CASE WHEN candidate_count >= 3 THEN median_revenue_growth END)"
_pen = curve_sql("(CASE WHEN tam_usd > 0 THEN t0.revenue / tam_usd END)", f["penetration_curve"])
NORM["tam_industry_growth"] = (f"coalesce(0.6::DOUBLE * {curve_sql(_tam, f['cagr_curve'])} + 0.4::DOUBLE * {_pen}, {curve_sql(_tam, f['cagr_curve'])})", _tam)
f = S["gross_margin"]
_lvl = curve_sql("m_gross_margin", f["level_curve"])
NORM["gross_margin"] = (f"coalesce(0.6::DOUBLE * {_lvl} + 0.4::DOUBLE * {curve_sql('m_trend', f['trend_curve'])}, {_lvl})", "m_gross_margin")
f = S["operating_leverage"]
_delta = f"((m_operating_margin - {ratio_sql('t4.operating_income', 't4.revenue')}) * 100)"
_gap = "(m_growth - m_opex_growth)"
_d, _gp = curve_sql(_delta, f["margin_delta_curve"]), curve_sql(_gap, f["growth_gap_curve"])
NORM["operating_leverage"] = (f"coalesce(0.5::DOUBLE * {_d} + 0.5::DOUBLE * {_gp}, {_d}, {_gp}) * {damp_sql('t4.revenue', 't0.revenue')}", f"coalesce({_delta}, {_gap})")
f = S["competitive_advantage"]
SIGNALS = [curve_sql("(m_roic - 0.09::DOUBLE)", f["roic_spread"]), curve_sql("gm_stable", f["gm_stability"]),
           curve_sql("(CASE WHEN candidate_count >= 3 THEN m_gross_margin - median_gross_margin END)", f["gm_vs_industry"]),
           curve_sql(ratio_sql("t0.rd_expense", "t0.revenue"), f["rd_intensity"])]
ORACLE["o_adv"] = f"""
SELECT cik, CASE WHEN n >= 2 THEN total / n * {curve_sql('(n / k)', f['coverage_curve'])} END AS v FROM (
  SELECT cik, {' + '.join(f'coalesce({x}, 0)' for x in SIGNALS)} AS total, ({' + '.join(f'({x} IS NOT NULL)::INT' for x in SIGNALS)})::DOUBLE AS n,
         CASE WHEN candidate_count >= 3 AND median_gross_margin IS NOT NULL THEN 4.0 ELSE 3.0 END::DOUBLE AS k FROM o_full) x"""
NORM["competitive_advantage"] = ("(SELECT v FROM o_adv WHERE o_adv.cik = o_full.cik)",) * 2
f = S["balance_sheet"]
_nc, _lv, _rw = curve_sql("m_net_cash", f["net_cash_curve"]), curve_sql("m_leverage", f["leverage_curve"]), curve_sql("m_runway", f["runway_curve"])
_pw = "(CASE WHEN m_net_cash IS NOT NULL THEN 0.6 ELSE 0 END + CASE WHEN m_leverage IS NOT NULL THEN 0.4 ELSE 0 END)::DOUBLE"
_aw = "(CASE WHEN market_cap > 0 THEN 1.0 ELSE 0.4 END)::DOUBLE"
NORM["balance_sheet"] = (f"""CASE WHEN m_runway IS NOT NULL THEN {_rw} WHEN {_pw} > 0 THEN
  (coalesce(0.6::DOUBLE * {_nc}, 0) + coalesce(0.4::DOUBLE * {_lv}, 0)) / {_pw} * ({_pw} / {_aw}) END""", "coalesce(m_runway, m_net_cash, m_leverage)")
_rev4 = "list_filter(list_transform({}[1:4], lambda p: p.revenue), lambda v: v IS NOT NULL)[1]"
_obs = f"coalesce(t0.revenue, {_rev4.format('t')}, {_rev4.format('a')})"
_bands = """(CASE WHEN market_cap < 1e9 THEN 15 WHEN market_cap < 3e9 THEN 14 WHEN market_cap < 10e9 THEN 12 WHEN market_cap < 30e9 THEN 8
  WHEN market_cap < 100e9 THEN 4 ELSE 1 END)"""
_warned = "EXISTS (SELECT 1 FROM o_flags w WHERE w.cik = o_full.cik AND w.severity = 'WARNING')"
MCAP = f"""CASE WHEN market_cap > 0 AND {_obs} IS NOT NULL THEN {_bands} * CASE WHEN m_growth < 0 THEN 0 WHEN {_obs} < 10000000 THEN 0
  WHEN {_warned} THEN 0.5 ELSE 1 END END::DOUBLE"""

_parts = []
for _k, _w in [("revenue_growth", 20), ("revenue_acceleration", 10), ("tam_industry_growth", 15), ("gross_margin", 10), ("operating_leverage", 10),
               ("market_cap_opportunity", 15), ("competitive_advantage", 10), ("balance_sheet", 5), ("institutional_insider", 5)]:
    _norm, _raw = NORM.get(_k, (None, None))
    _pts = MCAP if _k == "market_cap_opportunity" else "NULL::DOUBLE" if _norm is None else f"{float(_w)!r}::DOUBLE * ({_norm})"
    _raw = "market_cap" if _k == "market_cap_opportunity" else _raw or "NULL::DOUBLE"
    _parts.append(f"SELECT cik, industry_slug, '{_k}' AS factor_key, {_w} AS weight, {_pts} AS points, {_raw} AS raw0 FROM o_full")
ORACLE["o_factors"] = f"""
SELECT cik, industry_slug, factor_key, weight, points, CASE WHEN points IS NOT NULL THEN raw0 END AS raw,
       CASE WHEN factor_key = 'institutional_insider' THEN 'NOT_IMPLEMENTED' WHEN points IS NULL THEN 'NO_DATA' ELSE 'SCORED' END AS status
FROM ({' UNION ALL '.join(_parts)}) x"""
ORACLE["o_total"] = """
SELECT cik, 100 * sum(points) / nullif(sum(CASE WHEN status = 'SCORED' THEN weight END), 0) AS score,
       coalesce(sum(CASE WHEN status = 'SCORED' THEN weight END), 0)::DOUBLE / sum(CASE WHEN status <> 'NOT_IMPLEMENTED' THEN weight END) AS completeness
FROM o_factors GROUP BY cik"""


def scored(t):
    return cut(fx.with_total(fx.with_factors(quality.with_flags(full(t)))))


@query("G1_revenue_damping", f"SELECT cik, round({damp_sql('t4.revenue', 't0.revenue')}, 6) AS growth_cut, round({damp_sql(qsum(5), qsum(1))}, 6) AS acceleration_cut FROM o_full")
def g1(t):
    return fx.with_parts(full(t)).select("cik", r("p_cut").alias("growth_cut"), r("p_cut_sum").alias("acceleration_cut"))


def _factor_query(n, key):
    @query(f"G{n}_{key}", f"SELECT cik, status, round(points, 6) AS points, round(raw, 6) AS raw FROM o_factors WHERE factor_key = '{key}'")
    def run(t):
        return fx.one_factor(quality.with_flags(full(t)), key).select("cik", "status", r("points").alias("points"), r("raw").alias("raw"))


for _i, _key in enumerate(["revenue_growth", "revenue_acceleration", "tam_industry_growth", "gross_margin", "operating_leverage",
                           "market_cap_opportunity", "competitive_advantage", "balance_sheet", "institutional_insider"], 2):
    _factor_query(_i, _key)


@query("G11_total_score", "SELECT cik, round(score, 6) AS score, round(completeness, 6) AS completeness FROM o_total")
def g11(t):
    return scored(t).select("cik", r("score").alias("score"), r("completeness").alias("completeness"))


_SRC = "CASE f.factor_key WHEN 'revenue_growth' THEN d.m_growth WHEN 'revenue_acceleration' THEN d.m_accel WHEN 'gross_margin' THEN d.m_gross_margin WHEN 'market_cap_opportunity' THEN d.market_cap END"
ORACLE["o_pct"] = f"""
SELECT f.cik, f.factor_key, CASE WHEN count({_SRC}) >= 3 THEN sum(CASE WHEN {_SRC} < f.raw THEN 1 ELSE 0 END)::DOUBLE / count({_SRC}) END AS percentile
FROM o_factors f JOIN o_met d ON d.industry_slug = f.industry_slug
WHERE f.raw IS NOT NULL AND f.factor_key IN ('revenue_growth', 'revenue_acceleration', 'gross_margin', 'market_cap_opportunity')
GROUP BY f.cik, f.factor_key, f.raw"""


@query("G12_factor_percentiles", "SELECT cik, factor_key, round(percentile, 6) AS percentile FROM o_pct")
def g12(t):
    s = scored(t)
    return peers.factor_percentiles(s, fx.factor_rows(s), S["min_industry_candidates"]).select("cik", "factor_key", r("percentile").alias("percentile"))


@query("G13_score_summary", """
SELECT count(*) AS scored, (SELECT count(DISTINCT cik) FROM o_flags WHERE severity = 'CRITICAL') AS red_flagged,
       count(*) FILTER (completeness < 0.6) AS insufficient, (SELECT count(*) FROM o_fair WHERE reason IS NULL) AS fair_valued FROM o_total""")
def g13(t):
    return scoring.summary(scoring.evaluate(full(t)))


# ---- peers -----------------------------------------------------------------------------------------------------
_next = """CASE WHEN market_cap IS NULL OR market_cap < 2e9 THEN 'EMERGING' WHEN market_cap < 5e9 AND (coalesce(t0.operating_income, 0) <= 0
  OR coalesce(t0.revenue, 0) < 5e8) THEN 'EMERGING' ELSE 'CHALLENGER' END"""
ORACLE["o_leader"] = """
SELECT cik FROM (
  SELECT cik, market_cap, row_number() OVER (PARTITION BY industry_slug ORDER BY coalesce(market_cap, -1) DESC, cik) AS rk,
         max(market_cap) OVER (PARTITION BY industry_slug) AS top, count(*) OVER (PARTITION BY industry_slug) AS n FROM o_snap) x
WHERE n >= 3 AND top > 0 AND rk <= 5 AND (market_cap >= top * 0.25 OR rk <= 2)"""
ORACLE["o_category"] = f"""
SELECT s.cik, s.industry_slug, CASE WHEN l.cik IS NOT NULL THEN 'LEADER' ELSE {_next} END AS category
FROM o_snap s LEFT JOIN o_leader l ON l.cik = s.cik"""


@query("X1_industry_leaders", "SELECT cik FROM o_leader")
def x1(t):
    return peers.leaders(cut(base(t)))


@query("X2_follower_category", f"SELECT cik, {_next} AS category FROM o_snap")
def x2(t):
    return base(t).select("cik", peers.follower_category().alias("category"))


@query("X3_category", "SELECT cik, industry_slug, category FROM o_category")
def x3(t):
    return peers.classify(cut(base(t))).select("cik", "industry_slug", "category")


