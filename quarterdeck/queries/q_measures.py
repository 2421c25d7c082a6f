"""Scalar expressions and company measures (C, M)."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarterdeck.config import SCORING, STALENESS
from quarterdeck.functions import metrics, scalars as sc
from quarterdeck.operators.pick import first_rows
from quarterdeck.plans.snapshot import price_rows
from quarterdeck.queries.adapter import AS_OF
from quarterdeck.queries.common import GROSS, INVESTED, base, curve_sql, periods, r, ratio_sql, roic_sql, yoy_sql
from quarterdeck.queries.registry import query

GROWTH = SCORING["revenue_growth"]["curve"]
SCORE = curve_sql("m_growth", GROWTH)


@query("A0_flagship_growth_leaders", f"""
SELECT industry_slug, cik, ticker, growth, score, rank FROM (
  SELECT industry_slug, cik, ticker, round(m_growth, 6) AS growth, round({SCORE}, 6) AS score,
         CAST(row_number() OVER (PARTITION BY industry_slug ORDER BY {SCORE} DESC, cik) AS INT) AS rank
  FROM o_met WHERE m_growth IS NOT NULL) x WHERE rank <= 3""")
def flagship(t):
    rows = base(t).where("m_growth IS NOT NULL").select("industry_slug", "cik", "ticker", "m_growth", sc.curve("m_growth", GROWTH).alias("s"))
    top = first_rows(rows, ["industry_slug"], [F.desc("s"), F.asc("cik")], 3)
    return top.select("industry_slug", "cik", "ticker", r("m_growth").alias("growth"), r("s").alias("score"), "rank")


@query("C1_curve", f"SELECT cik, period_end, round({curve_sql('x', SCORING['damping_curve'])}, 6) AS y FROM (SELECT cik, period_end, revenue AS x FROM a_q) v")
def c1(t):
    return t.a_q.select("cik", "period_end", r(sc.curve("revenue", SCORING["damping_curve"])).alias("y"))


@query("C2_yoy", f"""SELECT cik, period_end, round({yoy_sql('ocf', 'p')}, 6) AS growth
FROM (SELECT cik, period_end, ocf, lag(operating_income, 4) OVER (PARTITION BY cik ORDER BY period_end) AS p FROM a_q) x""")
def c2(t):
    from pyspark.sql import Window
    w = Window.partitionBy("cik").orderBy("period_end")
    return t.a_q.select("cik", "period_end", r(sc.yoy("ocf", F.lag("operating_income", 4).over(w))).alias("growth"))


@query("C3_cagr", """SELECT cik, period_end, round(CASE WHEN operating_income > 0 AND p > 0 THEN pow(operating_income / p, 1.0::DOUBLE / 2) - 1 END, 6) AS growth
FROM (SELECT cik, period_end, operating_income, lag(operating_income, 8) OVER (PARTITION BY cik ORDER BY period_end) AS p FROM a_q) x""")
def c3(t):
    from pyspark.sql import Window
    w = Window.partitionBy("cik").orderBy("period_end")
    return t.a_q.select("cik", "period_end", r(sc.cagr("operating_income", F.lag("operating_income", 8).over(w), 2)).alias("growth"))


@query("C4_guarded_ratio", f"SELECT cik, period_end, round({ratio_sql('fcf', 'operating_income')}, 6) AS ratio FROM a_q")
def c4(t):
    return t.a_q.select("cik", "period_end", r(sc.ratio("fcf", "operating_income")).alias("ratio"))


@query("C5_first_of", """SELECT cik, period_end, coalesce(rd_expense, sbc, capex) AS value,
  CASE WHEN rd_expense IS NOT NULL THEN 'rd' WHEN sbc IS NOT NULL THEN 'sbc' WHEN capex IS NOT NULL THEN 'capex' END AS label FROM a_q""")
def c5(t):
    v, label = sc.first_of([("rd_expense", "rd"), ("sbc", "sbc"), ("capex", "capex")])
    return t.a_q.select("cik", "period_end", v.alias("value"), label.alias("label"))


@query("C6_largest_of", """SELECT cik, period_end, greatest(rd_expense, sbc, capex) AS value,
  CASE greatest(rd_expense, sbc, capex) WHEN rd_expense THEN 'rd' WHEN sbc THEN 'sbc' WHEN capex THEN 'capex' END AS label FROM a_q""")
def c6(t):
    v, label = sc.largest_of([("rd_expense", "rd"), ("sbc", "sbc"), ("capex", "capex")])
    return t.a_q.select("cik", "period_end", v.alias("value"), label.alias("label"))


@query("C7_same_number", """SELECT cik, period_end, abs(revenue - p) <= 0.005::DOUBLE * greatest(abs(revenue), abs(p), 1) AS same
FROM (SELECT cik, period_end, floor(revenue / 20000000) * 20000000 AS revenue, floor(lag(revenue) OVER (PARTITION BY cik ORDER BY period_end) / 20000000) * 20000000 AS p FROM a_q) x""")
def c7(t):
    from pyspark.sql import Window
    w = Window.partitionBy("cik").orderBy("period_end")
    step = lambda c: (F.floor(c / 2e7) * 2e7).cast("double")
    return (t.a_q.select("cik", "period_end", step(F.col("revenue")).alias("x"), step(F.lag("revenue").over(w)).alias("p"))
            .select("cik", "period_end", sc.same_number("x", "p").alias("same")))


@query("C8_same_number_scaled", """SELECT q.cik, period_end, abs(revenue - ocf) <= 0.005::DOUBLE * greatest(abs(revenue), abs(ocf), s * 50) AS same
FROM a_q q JOIN (SELECT cik, max(abs(revenue)) AS s FROM a_q GROUP BY cik) m ON m.cik = q.cik""")
def c8(t):
    scale = t.a_q.groupBy("cik").agg(F.max(F.abs("revenue")).alias("s"))
    return t.a_q.join(scale, "cik").select("cik", "period_end", sc.same_number("revenue", "ocf", F.col("s") * 50).alias("same"))


@query("C9_band", """SELECT cik, CAST(date AS DATE) AS date, CASE WHEN market_cap < 1e9 THEN 15.0 WHEN market_cap < 3e9 THEN 14.0 WHEN market_cap < 10e9 THEN 12.0
  WHEN market_cap < 30e9 THEN 8.0 WHEN market_cap < 100e9 THEN 4.0 WHEN market_cap IS NOT NULL THEN 1.0 END::DOUBLE AS points FROM a_market""")
def c9(t):
    return t.a_market.select("cik", "date", sc.band("market_cap", SCORING["market_cap_opportunity"]["bands"]).alias("points"))


@query("C10_days_between", """SELECT cik, tag, period_end, qtrs, form, accession, source, CAST(abs(date_diff('day', period_end, filed_date)) AS INT) AS days,
  filed_date < DATE '2001-11-15' - 120 AS old FROM a_facts""")
def c10(t):
    return t.a_facts.select("cik", "tag", "period_end", "qtrs", "form", "accession", "source", sc.days_between("filed_date", "period_end").alias("days"),
                            (F.col("filed_date") < F.date_sub(F.lit(AS_OF).cast("date"), 120)).alias("old"))


@query("C11_staleness", f"""SELECT cik, CASE WHEN d IS NULL THEN 'UNKNOWN' WHEN date_diff('day', d, DATE '{AS_OF}') > {STALENESS['price_days']} THEN 'STALE' ELSE 'FRESH' END AS state
FROM (SELECT c.cik, CASE WHEN c.cik % 5 = 0 THEN NULL ELSE min(m.date) END AS d FROM a_company c LEFT JOIN a_market m ON m.cik = c.cik GROUP BY c.cik) x""")
def c11(t):
    d = t.a_company.join(t.a_market.groupBy("cik").agg(F.min("date").alias("d")), "cik", "left").withColumn("d", F.expr("CASE WHEN cik % 5 = 0 THEN NULL ELSE d END"))
    return d.select("cik", sc.staleness("d", F.lit(AS_OF).cast("date"), STALENESS["price_days"]).alias("state"))


def _measure(id_, column, digits=6, sql=None):
    @query(id_, f"SELECT cik, round({sql or column}, {digits}) AS value FROM o_met")
    def run(t, column=column):
        return base(t).select("cik", r(column, digits).alias("value"))


_measure("M1_revenue_growth", "m_growth")
_measure("M2_revenue_cagr", "m_cagr")
_measure("M3_acceleration", "m_accel")


@query("M4_margins", "SELECT cik, round(m_gross_margin, 6) AS gross_margin, round(m_operating_margin, 6) AS operating_margin, round(m_fcf_margin, 6) AS fcf_margin FROM o_met")
def m4(t):
    return base(t).select("cik", *[r(f"m_{c}").alias(c) for c in ("gross_margin", "operating_margin", "fcf_margin")])


_measure("M5_gross_margin_trend", "m_trend", 4)

_T0 = {"i": INVESTED.format(p="t0"), "g": GROSS.format(p="t0")}
_GAP = f"""CASE WHEN t0.operating_income IS NULL OR {_T0['i']} IS NULL THEN 'MISSING_FIELDS' WHEN {_T0['i']} <= 0 THEN 'NON_POSITIVE_INVESTED_CAPITAL'
  WHEN {_T0['i']} / {_T0['g']} < 0.1 THEN 'IMMATERIAL_INVESTED_CAPITAL' END"""


def _now():
    return F.get("ttm", F.lit(0))


@query("M6_invested_capital_ratio", f"SELECT cik, round({_T0['i']} / {_T0['g']}, 6) AS value FROM o_met")
def m6(t):
    return base(t).select("cik", r(metrics.invested_ratio(_now())).alias("value"))


_measure("M7_roic", "m_roic")


@query("M8_roic_gap", f"SELECT cik, {_GAP} AS gap FROM o_met")
def m8(t):
    return base(t).select("cik", metrics.roic_gap(_now()).alias("gap"))


@query("M9_roic_verdict", f"""
SELECT cik, kind, CASE WHEN kind = 'MEASURED' THEN round(spread, 6) END AS spread, kind = 'MEASURED' AND coalesce(spread > 0, false) AS clears,
       CASE WHEN kind = 'UNDEFINED' THEN gap END AS gap FROM (
  SELECT cik, gap, {roic_sql('t0')} - 0.09::DOUBLE AS spread,
         CASE WHEN gap IN ('MISSING_FIELDS', 'NON_POSITIVE_INVESTED_CAPITAL') THEN 'UNDEFINED' WHEN t0.operating_income <= 0 THEN 'DETERMINATE_MISS'
              WHEN gap IS NOT NULL THEN 'UNDEFINED' ELSE 'MEASURED' END AS kind
  FROM (SELECT *, {_GAP} AS gap FROM o_met) x) y""")
def m9(t):
    v = base(t).select("cik", metrics.roic_verdict(_now()).alias("v"))
    return v.select("cik", "v.kind", r("v.spread").alias("spread"), "v.clears", "v.gap")


_measure("M10_cash_runway", "m_runway")
_measure("M11_net_cash_share", "m_net_cash")
_measure("M12_debt_to_operating_income", "m_leverage")
_measure("M13_opex_growth", "m_opex_growth")

_SHARES = """(SELECT f.{c} FROM o_periods f WHERE f.cik = c.cik AND f.{c} IS NOT NULL AND f.period_end >= l.period_end - 400
  ORDER BY f.period_end DESC, CASE f.period_type WHEN 'Q' THEN 0 WHEN 'TTM' THEN 1 ELSE 2 END LIMIT 1)"""


@query("M14_market_cap", f"""
SELECT cik, CAST(price AS DOUBLE) AS price, CASE WHEN rep IS NOT NULL THEN 'reported' WHEN dil IS NOT NULL THEN 'diluted_fallback' END AS shares_basis,
       price * coalesce(rep, dil) AS market_cap FROM (
  SELECT c.cik, m.price, {_SHARES.format(c='shares_outstanding')} AS rep, {_SHARES.format(c='shares_diluted')} AS dil
  FROM a_company c JOIN a_ci ci ON ci.cik = c.cik JOIN o_market m ON m.cik = c.cik
  LEFT JOIN (SELECT cik, max(period_end) AS period_end FROM o_periods GROUP BY cik) l ON l.cik = c.cik WHERE c.is_active) x""")
def m14(t):
    from quarterdeck.plans.snapshot import latest_market
    quotes = latest_market(t.a_market).join(t.a_company.select("cik", "ticker"), "cik").select("ticker", "price", "date")
    return price_rows(t.a_company, t.a_ci, periods(t), quotes).select("cik", "price", "shares_basis", "market_cap")


