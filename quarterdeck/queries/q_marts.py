"""Serving tables (A7, T, C13, C16, D)."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarterdeck.operators import quality
from quarterdeck.operators import factors as fx
from quarterdeck.operators import peers
from quarterdeck.operators.checkpoint import cut
from quarterdeck.plans import marts, normalize as norm, scoring
from quarterdeck.queries.adapter import AS_OF
from quarterdeck.queries.common import DAY, ORACLE, full, periods, r
from quarterdeck.queries.registry import query


def _date():
    return F.lit(AS_OF).cast("date")


def tables(t, valuations: bool = False) -> dict:
    """The stored tables the serving queries read, after one scoring run."""
    snapshot = full(t)
    if valuations:
        out = scoring.outputs(scoring.evaluate(snapshot), AS_OF)
    else:
        # the valuation columns are not asked for, so they are not computed
        scored = cut(peers.classify(cut(fx.with_total(fx.with_factors(quality.with_flags(snapshot))))))
        day = _date().alias("as_of")
        out = {"scores": scored.select("cik", day, "score", "completeness", "category"),
               "score_factors": fx.factor_rows(scored).select("cik", day, "factor_key", "raw", "points", "weight", "status", "detail"),
               "red_flags": quality.flag_rows(scored).select("cik", day, "code", "severity")}
    return {**out, "companies": t.a_company, "company_industry": t.a_ci, "market_data": t.a_market, "industries": t.a_industry, "themes": t.a_theme}


def rows(t):
    return cut(marts.company_rows(tables(t)))


ORACLE["o_rows"] = f"""
SELECT s.cik, s.ticker, s.name, s.industry_slug, s.market_cap, t.score, t.completeness,
  c.category, coalesce(m_growth, m_cagr) AS revenue_growth,
  m_accel AS acceleration,
  coalesce(f.critical, 0) AS critical_count,
  coalesce(f.warning, 0) AS warning_count, s.t0
FROM o_met s LEFT JOIN o_total t ON t.cik = s.cik LEFT JOIN o_category c ON c.cik = s.cik
LEFT JOIN (SELECT cik, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'WARNING') AS warning FROM o_flags GROUP BY cik) f ON f.cik = s.cik"""
_OK = "(completeness IS NULL OR completeness >= 0.6)"
ORACLE["o_cand"] = f"SELECT * FROM o_rows WHERE score IS NOT NULL AND category IS DISTINCT FROM 'LEADER' AND {_OK}"
ORACLE["o_indrow"] = f"""
SELECT r.industry_slug, count(*) AS candidate_count, median(revenue_growth) AS median_revenue_growth, median(market_cap) AS median_market_cap, median(acceleration) AS momentum,
  avg(r.score) FILTER ({_OK}) AS avg_score, count(*) FILTER (critical_count > 0)::DOUBLE / count(*) AS risk_ratio, any_value(b.ticker) AS top_ticker, any_value(b.score) AS top_score
FROM o_rows r LEFT JOIN (SELECT industry_slug, ticker, score, row_number() OVER (PARTITION BY industry_slug ORDER BY score DESC, cik) AS rn FROM o_cand) b
  ON b.industry_slug = r.industry_slug AND b.rn = 1 GROUP BY r.industry_slug"""
_IND = """industry_slug, candidate_count, round(median_revenue_growth, 6) AS median_revenue_growth, median_market_cap, round(momentum, 6) AS momentum,
  round(avg_score, 6) AS avg_score, round(risk_ratio, 6) AS risk_ratio, top_ticker, round(top_score, 6) AS top_score"""


def _ind(df):
    return df.select("industry_slug", "candidate_count", r("median_revenue_growth").alias("median_revenue_growth"), "median_market_cap", r("momentum").alias("momentum"),
                     r("avg_score").alias("avg_score"), r("risk_ratio").alias("risk_ratio"), "top_ticker", r("top_score").alias("top_score"))


@query("A7_industry_rows", f"SELECT {_IND} FROM o_indrow")
def a7(t):
    return _ind(marts.industry_rows(rows(t)))


@query("T1_top_candidates", "SELECT cik, ticker, industry_slug, round(score, 6) AS score FROM o_cand ORDER BY o_cand.score DESC, cik LIMIT 5")
def t1(t):
    return marts.candidates(rows(t)).orderBy(F.desc("score"), "cik").limit(5).select("cik", "ticker", "industry_slug", r("score").alias("score"))


@query("T2_top_per_industry", "SELECT industry_slug, top_ticker, round(top_score, 6) AS top_score FROM o_indrow WHERE top_ticker IS NOT NULL")
def t2(t):
    return marts.industry_rows(rows(t)).where("top_ticker IS NOT NULL").select("industry_slug", "top_ticker", r("top_score").alias("top_score"))


ORACLE["o_table"] = f"""
SELECT *, CAST(CASE grp WHEN 'LEADER' THEN 1 WHEN 'CHALLENGER' THEN 2 WHEN 'EMERGING' THEN 3 WHEN 'INSUFFICIENT' THEN 4 ELSE 5 END AS INT) AS group_rank,
  CASE WHEN grp = 'UNSCORED' THEN coalesce(market_cap, -1) ELSE coalesce(score, -1) END AS sort_value FROM (
  SELECT *, CASE WHEN category IS NULL THEN 'UNSCORED' WHEN NOT {_OK} THEN 'INSUFFICIENT' ELSE category END AS grp FROM o_rows) x"""


def table(t):
    from quarterdeck.operators.periods import trailing_year
    return marts.industry_table(rows(t), trailing_year(t.a_q))


@query("T3_candidate_groups", "SELECT cik, industry_slug, grp AS group, group_rank, round(sort_value, 6) AS sort_value FROM o_table")
def t3(t):
    return table(t).select("cik", "industry_slug", "group", "group_rank", r("sort_value").alias("sort_value"))


@query("T4_industry_order", """
SELECT i.theme_slug, o.industry_slug, CAST(row_number() OVER (PARTITION BY i.theme_slug ORDER BY coalesce(avg_score, -1) DESC, o.industry_slug) AS INT) AS place
FROM o_indrow o JOIN a_industry i ON i.slug = o.industry_slug""")
def t4(t):
    from pyspark.sql import Window
    ordered = marts.opportunity_map(rows(t), t.a_industry, t.a_theme).where("industry_slug IS NOT NULL")
    w = Window.partitionBy("theme_slug").orderBy(F.coalesce("avg_score", F.lit(-1.0)).desc(), "industry_slug")
    return ordered.select("theme_slug", "industry_slug", F.row_number().over(w).alias("place"))


ORACLE["o_fill"] = f"SELECT *, points / weight AS fill FROM o_factors WHERE status = 'SCORED'"


def factor_table(t):
    return tables(t)["score_factors"]


@query("T5_factor_fill", "SELECT cik, factor_key, round(fill, 6) AS fill FROM o_fill")
def t5(t):
    return marts.fills(factor_table(t)).select("cik", "factor_key", r("fill").alias("fill"))


@query("T6_strengths_and_weaknesses", """
SELECT cik, coalesce(string_agg(factor_key, ',' ORDER BY up) FILTER (up <= k), '') AS top, coalesce(string_agg(factor_key, ',' ORDER BY up DESC) FILTER (up > n - k), '') AS bottom FROM (
  SELECT *, least(3, n // 2) AS k FROM (SELECT cik, factor_key, row_number() OVER (PARTITION BY cik ORDER BY fill DESC, factor_key) AS up, count(*) OVER (PARTITION BY cik) AS n FROM o_fill) x) y GROUP BY cik""")
def t6(t):
    return marts.strengths(factor_table(t)).select("cik", F.concat_ws(",", "top").alias("top"), F.concat_ws(",", "bottom").alias("bottom"))


@query("T7_group_preview", """SELECT industry_slug, grp AS group, cik, CAST(rn AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY industry_slug, grp ORDER BY sort_value DESC, cik) AS rn FROM o_table) x WHERE rn <= 10""")
def t7(t):
    return marts.preview(table(t)).select("industry_slug", "group", "cik", "rank")


@query("T8_headlines", """SELECT (SELECT industry_slug FROM o_indrow ORDER BY avg_score DESC NULLS LAST, industry_slug DESC LIMIT 1) AS strongest,
  (SELECT industry_slug FROM o_indrow ORDER BY median_revenue_growth DESC NULLS LAST, industry_slug DESC LIMIT 1) AS fastest""")
def t8(t):
    return marts.headlines(cut(marts.industry_rows(rows(t))))


ORACLE["o_rationale"] = """
SELECT cik, CASE WHEN length(said) > 140 THEN rtrim(substring(said, 1, 139)) || '…' ELSE said END AS rationale FROM (
  SELECT cik, string_agg(factor_key || coalesce(' ' || printf('%.4f', raw), ''), ' · ' ORDER BY fill DESC, factor_key) AS said FROM (
    SELECT *, row_number() OVER (PARTITION BY cik ORDER BY fill DESC, factor_key) AS rn FROM o_fill) x WHERE rn <= 3 GROUP BY cik) y"""


@query("C13_rationale", f"SELECT cik, {DAY} AS as_of, rationale FROM o_rationale")
def c13(t):
    return marts.rationale(factor_table(t))


@query("C16_json_columns", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM a_quotes""")
def c16(t):
    from quarterdeck.functions.text import json_map
    return t.a_quotes.select("event_id", json_map("props", "map<string,double>")["k"].alias("k"))


@query("D1_snapshot", "SELECT cik, ticker, industry_slug, theme_slug, source AS classification_source, price, market_cap, shares_basis, candidate_count, len(t) AS ttm_rows, len(q) AS quarter_rows, len(a) AS annual_rows, round(median_revenue_growth, 6) AS median_growth FROM o_full")
def d1(t):
    s = full(t)
    size = lambda c: F.size(c).cast("long")
    return s.select("cik", "ticker", "industry_slug", "theme_slug", "classification_source", "price", "market_cap", "shares_basis", "candidate_count",
                    size("ttm").alias("ttm_rows"), size("q").alias("quarter_rows"), size("a").alias("annual_rows"), r("median_revenue_growth").alias("median_growth"))


@query("D2_opportunity_map", f"""SELECT t.slug AS theme_slug, t.name AS theme_name, t.display_order, i.name AS industry_name, {_IND}
  FROM a_theme t LEFT JOIN (SELECT i.name, i.theme_slug, o.* FROM a_industry i JOIN o_indrow o ON o.industry_slug = i.slug) i ON i.theme_slug = t.slug""".replace("FROM a_theme t LEFT", "FROM a_theme t LEFT"))
def d2(t):
    m = marts.opportunity_map(rows(t), t.a_industry, t.a_theme)
    return m.select("theme_slug", "theme_name", "display_order", "industry_name", "industry_slug", "candidate_count", r("median_revenue_growth").alias("median_revenue_growth"),
                    "median_market_cap", r("momentum").alias("momentum"), r("avg_score").alias("avg_score"), r("risk_ratio").alias("risk_ratio"), "top_ticker", r("top_score").alias("top_score"))


@query("D3_industry_table", """SELECT industry_slug, grp AS group, cik, ticker, category, market_cap, round(revenue_growth, 6) AS revenue_growth, round(CASE WHEN t0.revenue > 0 THEN t0.gross_profit / t0.revenue END, 6) AS gross_margin,
  round(CASE WHEN t0.revenue > 0 THEN t0.fcf / t0.revenue END, 6) AS fcf_margin, t0.total_debt AS total_debt, round(score, 6) AS score, round(completeness, 6) AS completeness, critical_count, warning_count FROM o_table""")
def d3(t):
    return table(t).select("industry_slug", "group", "cik", "ticker", "category", "market_cap", r("revenue_growth").alias("revenue_growth"), r("gross_margin").alias("gross_margin"),
                           r("fcf_margin").alias("fcf_margin"), "total_debt", r("score").alias("score"), r("completeness").alias("completeness"), "critical_count", "warning_count")


_SCORE_VERSION, _VALUE_VERSION = scoring.engine_versions()
_scored = lambda x, name: f"CASE WHEN w.score IS NOT NULL THEN {x} END AS {name}"


@query("D4_stock_detail", f"""
SELECT c.cik, c.ticker, c.name, c.sic, c.sic_description, c.exchange, c.fiscal_year_end, c.state, c.state_description, ci.industry_slug, ci.source AS classification_source, i.name AS industry_name, th.name AS theme_name,
  round(w.score, 6) AS score, round(w.completeness, 6) AS completeness, w.category, {_scored(DAY, 'score_as_of')}, {_scored(f"'{_SCORE_VERSION}'", 'score_engine_version')}, m.price, m.market_cap, m.date, m.shares_basis,
  x.t[1].period_end AS period_end, x.t[1].revenue AS revenue, round(CASE WHEN x.t[1].revenue > 0 THEN x.t[1].gross_profit / x.t[1].revenue END, 6) AS gross_margin,
  round(CASE WHEN x.t[1].revenue > 0 THEN x.t[1].operating_income / x.t[1].revenue END, 6) AS operating_margin, round(CASE WHEN x.t[1].revenue > 0 THEN x.t[1].fcf / x.t[1].revenue END, 6) AS fcf_margin,
  CASE WHEN m.date IS NULL THEN 'UNKNOWN' WHEN date_diff('day', m.date, {DAY}) > 5 THEN 'STALE' ELSE 'FRESH' END AS price_state,
  CASE WHEN x.t[1].period_end IS NULL THEN 'UNKNOWN' WHEN date_diff('day', x.t[1].period_end, {DAY}) > 120 THEN 'STALE' ELSE 'FRESH' END AS financials_state,
  CASE WHEN w.score IS NULL THEN 'UNKNOWN' ELSE 'FRESH' END AS score_state, {_scored(DAY, 'valuation_as_of')}, {_scored(f"'{_VALUE_VERSION}'", 'valuation_engine_version')},
  {_scored("CASE WHEN v.reason IS NULL THEN 'OK' ELSE 'INSUFFICIENT_DATA' END", 'fair_value_status')}, {_scored('v.reason', 'fair_value_reason')}, {_scored('round(v.per_share, 4)', 'fair_value_per_share')},
  {_scored('p.status', 'price_status')}, {_scored('round(p.ratio, 6)', 'price_ratio')}, {_scored('round(p.safety, 6)', 'margin_of_safety')}, {_scored('p.valuation_status', 'valuation_status')},
  {_scored('mo.signal', 'moat_signal')}, {_scored('mo.periods_evaluated', 'moat_periods_evaluated')}, {_scored('mo.periods_clearing', 'moat_periods_clearing')}, {_scored('mo.reason', 'moat_reason')},
  {_scored("CASE WHEN u.score >= 0.75 THEN 'SEVERE' WHEN u.score >= 0.5 THEN 'ELEVATED' WHEN u.score >= 0.25 THEN 'MODERATE' ELSE 'MINIMAL' END", 'uncertainty_level')}, {_scored('round(u.score, 6)', 'uncertainty_score')},
  CAST(coalesce(f.n, 0) AS INT) AS n_factors, CAST(w.critical_count + w.warning_count AS INT) AS n_flags
FROM a_company c JOIN a_ci ci ON ci.cik = c.cik JOIN a_industry i ON i.slug = ci.industry_slug JOIN a_theme th ON th.slug = i.theme_slug LEFT JOIN o_rows w ON w.cik = c.cik LEFT JOIN o_market m ON m.cik = c.cik
LEFT JOIN o_arr_t x ON x.cik = c.cik LEFT JOIN o_fair v ON v.cik = c.cik LEFT JOIN o_price p ON p.cik = c.cik LEFT JOIN o_moat mo ON mo.cik = c.cik LEFT JOIN o_unc u ON u.cik = c.cik
LEFT JOIN (SELECT cik, count(*) AS n FROM o_factors GROUP BY cik) f ON f.cik = c.cik""")
def d4(t):
    d = marts.stock_detail(tables(t, True), periods(t), _date())
    rounded = {c: r(c, 4 if c == "fair_value_per_share" else 6) for c in ("score", "completeness", "gross_margin", "operating_margin", "fcf_margin", "fair_value_per_share", "price_ratio", "margin_of_safety", "uncertainty_score")}
    d = d.withColumns({**rounded, "n_factors": F.when(F.col("factors").isNotNull(), F.size("factors")).otherwise(0), "n_flags": F.when(F.col("score_as_of").isNotNull(), F.when(F.col("flags").isNotNull(), F.size("flags")).otherwise(0))})
    return d.drop("gross_profit", "operating_income", "fcf", "cash", "total_debt", "assumptions", "moat_evidence", "uncertainty_drivers", "factors", "flags")


_DERIVED = """SELECT *, CASE WHEN (cik + year(period_end) * 4 + quarter(period_end)) % 6 = 0 THEN 'cumulative_diff' ELSE 'Revenues' END AS mark FROM {0}"""
ORACLE["o_mark_t"] = "SELECT cik, list(p ORDER BY p.period_end DESC) AS t FROM (" + _DERIVED.format("o_ttm") + ") p GROUP BY cik"
ORACLE["o_mark_q"] = "SELECT cik, list(p ORDER BY p.period_end DESC) AS q FROM (" + _DERIVED.format("a_q") + ") p GROUP BY cik"


@query("D5_derived_markers", """
SELECT t.cik, coalesce(m.m_growth, m.m_cagr) IS NOT NULL AND coalesce(t[1].mark = 'cumulative_diff' OR CASE WHEN t[5].revenue > 0 AND t[1].revenue IS NOT NULL THEN t[5].mark ELSE t[13].mark END = 'cumulative_diff', false) AS growth_derived,
  m.m_accel IS NOT NULL AND len(list_filter(q[1:8], lambda p: p.mark = 'cumulative_diff')) > 0 AS acceleration_derived,
  coalesce(t[1].revenue > 0 AND t[1].gross_profit IS NOT NULL AND t[1].mark = 'cumulative_diff', false) AS gross_margin_derived, t[1].revenue IS NOT NULL AND t[1].mark = 'cumulative_diff' AS revenue_derived
FROM o_mark_t t LEFT JOIN o_mark_q q ON q.cik = t.cik LEFT JOIN o_met m ON m.cik = t.cik""".replace("(t[", "(t.t[").replace(" t[", " t.t[").replace("q[1:8]", "q.q[1:8]"))
def d5(t):
    from quarterdeck.queries.common import base
    marked = periods(t).where("period_type <> 'A'").withColumn("source_tags", F.expr(
        "map('revenue', CASE WHEN (cik + year(period_end) * 4 + quarter(period_end)) % 6 = 0 THEN 'cumulative_diff' ELSE 'Revenues' END)"))
    raws = base(t).select("cik", F.explode(F.array(F.struct(F.lit("revenue_growth").alias("k"), F.coalesce("m_growth", "m_cagr").alias("v")),
                                                   F.struct(F.lit("revenue_acceleration").alias("k"), F.col("m_accel").alias("v")))).alias("f"))
    marks = marts.derived_marks(marked, cut(raws.select("cik", F.col("f.k").alias("factor_key"), F.col("f.v").alias("raw"))))
    return marks.select("cik", "growth_derived", "acceleration_derived", "gross_margin_derived", "revenue_derived")


@query("D6_top_candidates", "SELECT cik, ticker, name, industry_slug, round(score, 6) AS score, critical_count > 0 AS has_critical FROM o_cand ORDER BY o_cand.score DESC, cik LIMIT 5")
def d6(t):
    src = tables(t)
    top = marts.top_candidates(cut(marts.company_rows(src)), src["score_factors"])
    return top.select("cik", "ticker", "name", "industry_slug", r("score").alias("score"), "has_critical")


@query("D6_rationale_texts", "SELECT c.cik, r.rationale FROM (SELECT cik FROM o_cand ORDER BY o_cand.score DESC, cik LIMIT 5) c LEFT JOIN o_rationale r ON r.cik = c.cik")
def d6b(t):
    src = tables(t)
    return marts.top_candidates(cut(marts.company_rows(src)), src["score_factors"]).select("cik", "rationale")


@query("D7_freshness_panel", f"""SELECT *, CASE WHEN date_diff('day', price_date, {DAY}) > 5 THEN 'STALE' ELSE 'FRESH' END AS price_date_state,
  CASE WHEN date_diff('day', financials_at, {DAY}) > 120 THEN 'STALE' ELSE 'FRESH' END AS financials_at_state, CASE WHEN date_diff('day', score_as_of, {DAY}) > 14 THEN 'STALE' ELSE 'FRESH' END AS score_as_of_state
  FROM (SELECT (SELECT max(date) FROM a_market) AS price_date, (SELECT max(filed_date) FROM a_facts) AS financials_at, (SELECT max(period_end) FROM a_q) AS score_as_of) x""")
def d7(t):
    latest = marts.newest({"price_date": (t.a_market, "date"), "financials_at": (t.a_facts, "filed_date"), "score_as_of": (t.a_q, "period_end")})
    return marts.freshness(latest, _date())


@query("D8_industry_slugs", "SELECT DISTINCT i.slug FROM a_industry i JOIN a_theme t ON t.slug = i.theme_slug")
def d8(t):
    return t.a_industry.join(t.a_theme.select(F.col("slug").alias("theme_slug")), "theme_slug").select("slug").distinct().orderBy("slug")


@query("D9_adhoc_sql", "SELECT ci.industry_slug, count(*) AS companies, max(m.price) AS highest_price FROM a_company c JOIN a_ci ci ON ci.cik = c.cik JOIN a_market m ON m.cik = c.cik GROUP BY 1")
def d9(t):
    marts.register_views({"companies": t.a_company, "company_industry": t.a_ci, "market_data": t.a_market})
    return t.spark.sql("""SELECT ci.industry_slug, count(*) AS companies, max(m.price) AS highest_price FROM companies c
      JOIN company_industry ci ON ci.cik = c.cik JOIN market_data m ON m.cik = c.cik GROUP BY ci.industry_slug""")


# the statements of the ranking, on the periods of the chain instead of the mapped ones
_CHAIN = {"a_q": "SELECT * FROM o_norm WHERE period_type = 'Q'", "a_annual": "SELECT * FROM o_norm WHERE period_type = 'A'", "o_ttm": "SELECT * FROM o_norm WHERE period_type = 'TTM'"}


@query("D0_facts_to_ranking", """
SELECT s.cik, s.industry_slug, c.category, round(t.score, 6) AS score, round(t.completeness, 6) AS completeness, CASE WHEN v.reason IS NULL THEN 'OK' ELSE 'INSUFFICIENT_DATA' END AS fair_value_status,
  mo.signal AS moat_signal, CASE WHEN u.score >= 0.75 THEN 'SEVERE' WHEN u.score >= 0.5 THEN 'ELEVATED' WHEN u.score >= 0.25 THEN 'MODERATE' ELSE 'MINIMAL' END AS uncertainty_level
FROM o_met s LEFT JOIN o_total t ON t.cik = s.cik LEFT JOIN o_category c ON c.cik = s.cik LEFT JOIN o_fair v ON v.cik = s.cik LEFT JOIN o_moat mo ON mo.cik = s.cik LEFT JOIN o_unc u ON u.cik = s.cik""", _CHAIN)
def d0(t):
    """The whole chain: fact log, reconciliation, periods, scores, ranking."""
    from quarterdeck.functions.metrics import measured
    from quarterdeck.operators.peers import industry_stats
    from quarterdeck.plans.snapshot import base_snapshot
    normalized = norm.normalize(t.a_facts).periods
    base = cut(measured(base_snapshot(t.a_company, t.a_ci, t.a_industry, normalized.drop("source_tags"), t.a_market)))
    scored = scoring.evaluate(base.join(industry_stats(base), "industry_slug", "left"))
    return scored.select("cik", "industry_slug", "category", r("score").alias("score"), r("completeness").alias("completeness"), "fair_value_status", "moat_signal", "uncertainty_level")
