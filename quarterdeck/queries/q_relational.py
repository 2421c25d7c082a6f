"""Joins, aggregations, windows, top-k and set operations (J, A, W, T, U)."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from quarterdeck.config import COMPLETENESS_FIELDS, FLOW_FIELDS
from quarterdeck.functions import metrics, scalars as sc
from quarterdeck.operators import changes, distribution as dist, peers, periods as pf, upsert
from quarterdeck.operators.checkpoint import cut
from quarterdeck.operators.pick import best_row
from quarterdeck.plans import marts, snapshot as snap
from quarterdeck.queries.common import ORACLE, base, periods, r, ratio_sql, yoy_sql
from quarterdeck.queries.registry import query

# ---- joins ------------------------------------------------------------------------------------------------------


@query("J1_dimension_chain", """SELECT c.cik, c.ticker, ci.industry_slug, i.name AS industry_name, t.name AS theme_name FROM a_company c JOIN a_ci ci ON ci.cik = c.cik
  JOIN a_industry i ON i.slug = ci.industry_slug JOIN a_theme t ON t.slug = i.theme_slug""")
def j1(t):
    return marts.dimension_chain(t.a_company, t.a_ci, t.a_industry, t.a_theme).select("cik", "ticker", "industry_slug", "industry_name", "theme_name")


@query("J2_left_latest", """SELECT c.cik, c.ticker, m.price, q.period_end AS latest_quarter FROM a_company c LEFT JOIN o_market m ON m.cik = c.cik
  LEFT JOIN (SELECT cik, max(period_end) AS period_end FROM a_q GROUP BY cik) q ON q.cik = c.cik""")
def j2(t):
    market = snap.latest_market(t.a_market).select("cik", "price")
    newest = t.a_q.groupBy("cik").agg(F.max("period_end").alias("latest_quarter"))
    return t.a_company.select("cik", "ticker").join(market, "cik", "left").join(newest, "cik", "left")


@query("J3_without_facts", "SELECT c.cik FROM a_ticker c LEFT JOIN (SELECT DISTINCT cik FROM a_facts) f ON f.cik = c.cik WHERE f.cik IS NULL")
def j3(t):
    facts = changes.coverage(t.a_facts)
    return t.a_ticker.join(facts, "cik", "left").where("latest IS NULL").select("cik")


@query("J4_universe_facts", "SELECT f.cik, tag, count(*) AS n FROM a_facts f WHERE f.cik IN (SELECT c.cik FROM a_company c JOIN a_ci ci ON ci.cik = c.cik WHERE c.is_active) GROUP BY f.cik, tag")
def j4(t):
    kept = t.a_facts.join(changes.universe(t.a_company, t.a_ci).select("cik"), "cik", "left_semi")
    return kept.groupBy("cik", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("J5_bulk_without_api", """SELECT cik, tag, period_end, qtrs, count(*) AS n FROM a_facts b WHERE source = 'bulk'
  AND NOT EXISTS (SELECT 1 FROM a_facts a WHERE a.source = 'api' AND a.cik = b.cik AND a.tag = b.tag AND a.period_end = b.period_end AND a.qtrs = b.qtrs) GROUP BY ALL""")
def j5(t):
    keys = ["cik", "tag", "period_end", "qtrs"]
    f = t.a_facts
    return f.where("source = 'bulk'").join(f.where("source = 'api'").select(*keys), keys, "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query("J6_latest_row", "SELECT cik, period_end, revenue FROM a_q q WHERE period_end = (SELECT max(period_end) FROM a_q x WHERE x.cik = q.cik)")
def j6(t):
    return best_row(t.a_q.select("cik", "period_end", "revenue"), ["cik"], [F.col("period_end")])


@query("J7_latest_market_cap", "SELECT cik, x.market_cap FROM a_company LEFT JOIN (SELECT cik, arg_max_null(market_cap, date) AS market_cap FROM a_market GROUP BY cik) x USING (cik)")
def j7(t):
    caps = t.a_market.groupBy("cik").agg(F.max_by("market_cap", "date").alias("market_cap"))
    return t.a_company.select("cik").join(caps, "cik", "left")


@query("J8_flag_counts", """SELECT cik, coalesce(x.critical, 0) AS critical, coalesce(x.warning, 0) AS warning FROM o_snap LEFT JOIN (
  SELECT cik, count_if(severity = 'CRITICAL')::BIGINT AS critical, count_if(severity = 'WARNING')::BIGINT AS warning FROM o_flags GROUP BY cik) x USING (cik)""")
def j8(t):
    from quarterdeck.operators import quality
    rows = quality.with_flags(base(t))
    return rows.select("cik", marts.flag_count("CRITICAL").alias("critical"), marts.flag_count("WARNING").alias("warning"))


@query("J9_factor_lookup", """SELECT cik, round(x.growth, 6) AS growth, round(x.acceleration, 6) AS acceleration FROM o_snap LEFT JOIN (
  SELECT cik, max(raw) FILTER (factor_key = 'revenue_growth') AS growth, max(raw) FILTER (factor_key = 'revenue_acceleration') AS acceleration
  FROM o_factors GROUP BY cik) x USING (cik)""")
def j9(t):
    from quarterdeck.operators import factors as fx
    from quarterdeck.queries.q_scores import scored
    rows = fx.factor_rows(scored(t))
    pick = lambda k: r(F.max(F.when(F.col("factor_key") == k, F.col("raw"))))
    return rows.groupBy("cik").agg(pick("revenue_growth").alias("growth"), pick("revenue_acceleration").alias("acceleration"))


@query("J13_industry_meta", "SELECT c.cik, i.tam_usd, round(i.tam_cagr, 6) AS tam_cagr FROM a_company c JOIN a_ci ci ON ci.cik = c.cik LEFT JOIN a_industry i ON i.slug = ci.industry_slug WHERE c.is_active")
def j13(t):
    return snap.base_snapshot(t.a_company, t.a_ci, t.a_industry, periods(t), t.a_market).select("cik", "tam_usd", r("tam_cagr").alias("tam_cagr"))


_PICK = """(SELECT f.{0} FROM o_periods f WHERE f.cik = c.cik AND f.{0} IS NOT NULL AND f.period_end >= c.newest - 400
  ORDER BY f.period_end DESC, CASE f.period_type WHEN 'Q' THEN 0 WHEN 'TTM' THEN 1 ELSE 2 END LIMIT 1)"""


@query("J14_shares_as_of", f"SELECT cik, {_PICK.format('shares_outstanding')} AS shares_reported, {_PICK.format('shares_diluted')} AS shares_diluted FROM (SELECT cik, max(period_end) AS newest FROM o_periods GROUP BY cik) c")
def j14(t):
    return snap.shares_as_of(periods(t))


@query("J15_theme_industries", """SELECT t.slug, t.display_order, count(i.slug) AS industries, coalesce(string_agg(i.slug, ',' ORDER BY i.slug), '') AS listed
  FROM a_theme t LEFT JOIN a_industry i ON i.theme_slug = t.slug GROUP BY ALL""")
def j15(t):
    listed = marts.theme_lists(t.a_theme, t.a_industry)
    return listed.select("slug", "display_order", F.size("industries").cast("long").alias("industries"), F.concat_ws(",", "industries").alias("listed"))


# ---- aggregations -----------------------------------------------------------------------------------------------
_LONG = "SELECT ci.industry_slug, q.revenue, q.ocf, q.rd_expense FROM a_q q JOIN a_ci ci ON ci.cik = q.cik"
ORACLE["o_long"] = _LONG


@query("A1_exact_median", "SELECT industry_slug, median(rd_expense) AS median FROM o_long WHERE rd_expense IS NOT NULL GROUP BY 1")
def a1(t):
    return dist.median(t.sql(_LONG), ["industry_slug"], "rd_expense")


@query("A2_median_absolute_deviation", "SELECT industry_slug, mad(ocf) AS mad FROM o_long GROUP BY 1")
def a2(t):
    return dist.median_deviation(t.sql(_LONG), ["industry_slug"], "ocf")


@query("A3_sample_stdev", "SELECT cik, round(stddev_samp(g), 6) AS sd FROM (SELECT cik, CASE WHEN revenue > 0 THEN ocf / revenue END AS g FROM a_q) x GROUP BY cik")
def a3(t):
    rows = t.a_q.select("cik", sc.ratio("ocf", "revenue").alias("g"))
    return rows.groupBy("cik").agg(r(F.stddev_samp("g")).alias("sd"))


@query("A4_ols_slope", """SELECT cik, round(regr_slope(g, -rn), 6) AS slope FROM (
  SELECT cik, row_number() OVER (PARTITION BY cik ORDER BY period_end DESC) AS rn, ocf / revenue AS g FROM a_q) x WHERE rn <= 8 GROUP BY cik""")
def a4(t):
    rows = pf.period_arrays(t.a_q, ["Q"]).withColumn("s", pf.trailing("q", 8, lambda p: p["ocf"] / p["revenue"]))
    return rows.select("cik", r(sc.slope_of(F.col("s"))).alias("slope"))


@query("A5_strict_percentile", """SELECT p.cik, p.industry_slug, round(count(*) FILTER (o.revenue < p.probe)::DOUBLE / count(*), 6) AS percentile
  FROM (SELECT q.cik, ci.industry_slug, max(q.ocf) * 4 AS probe FROM a_q q JOIN a_ci ci ON ci.cik = q.cik GROUP BY 1, 2) p JOIN o_long o ON o.industry_slug = p.industry_slug GROUP BY 1, 2""")
def a5(t):
    probes = t.a_q.join(t.a_ci, "cik").groupBy("cik", "industry_slug").agg((F.max("ocf") * 4).alias("revenue"))
    return dist.percentiles(t.sql(_LONG), ["industry_slug"], "revenue", probes).select("cik", "industry_slug", r("percentile").alias("percentile"))


@query("A6_industry_stats", "SELECT industry_slug, candidate_count, round(median_gross_margin, 6) AS median_gross_margin, round(median_revenue_growth, 6) AS median_revenue_growth FROM o_stats")
def a6(t):
    return peers.industry_stats(cut(base(t))).select("industry_slug", "candidate_count", r("median_gross_margin").alias("median_gross_margin"), r("median_revenue_growth").alias("median_revenue_growth"))


_DIST = " UNION ALL ".join(f"SELECT industry_slug, '{k}' AS key, {c} AS value FROM o_met WHERE {c} IS NOT NULL" for k, c in peers.DISTRIBUTIONS.items())


@query("A6_distributions", f"SELECT industry_slug, key, count(*) AS n, round(min(value), 4) AS lowest, round(max(value), 4) AS highest FROM ({_DIST}) x GROUP BY 1, 2")
def a6b(t):
    d = peers.distributions(base(t))
    return d.groupBy("industry_slug", "key").agg(F.count(F.lit(1)).alias("n"), r(F.min("value"), 4).alias("lowest"), r(F.max("value"), 4).alias("highest"))


@query("A8_freshness", "SELECT (SELECT max(date) FROM a_market) AS price_date, (SELECT max(filed_date) FROM a_facts) AS financials_at, (SELECT max(period_end) FROM o_periods) AS score_as_of")
def a8(t):
    return marts.newest({"price_date": (t.a_market, "date"), "financials_at": (t.a_facts, "filed_date"), "score_as_of": (periods(t), "period_end")})


_NEW = "SELECT cik, period_end, CASE WHEN (cik + quarter(period_end)) % 7 = 0 THEN NULL ELSE revenue END AS revenue FROM a_q"


@query("A9_null_strict_sum", f"""SELECT cik, period_end, revenue + lag(revenue, 1) OVER w + lag(revenue, 2) OVER w + lag(revenue, 3) OVER w AS total FROM ({_NEW}) x
  WINDOW w AS (PARTITION BY cik ORDER BY period_end)""")
def a9(t):
    w = Window.partitionBy("cik").orderBy("period_end")
    return t.sql(_NEW).select("cik", "period_end", sc.total(["revenue", *[F.lag("revenue", k).over(w) for k in (1, 2, 3)]]).alias("total"))


@query("A10_fact_coverage", "SELECT cik, max(filed_date) AS latest, max(filed_date) FILTER (source = 'api') AS api_latest, count(*) FILTER (source = 'api') AS api_facts FROM a_facts GROUP BY cik")
def a10(t):
    return changes.coverage(t.a_facts)


@query("A11_decision_counts", """SELECT decision, count(*) AS companies, string_agg(ticker, ',' ORDER BY ticker) FILTER (rn <= 10) AS sample FROM (
  SELECT *, row_number() OVER (PARTITION BY decision ORDER BY ticker) AS rn FROM o_decide) x GROUP BY decision""")
def a11(t):
    from quarterdeck.queries.q_sources import decisions
    return marts.outcome_counts(decisions(t), "decision", "ticker").select("decision", F.col("n").alias("companies"), F.concat_ws(",", "sample").alias("sample"))


_TAGS = """SELECT cik, period_end, (cik + quarter(period_end)) % 3 = 0 AS derived, CASE WHEN (cik + quarter(period_end)) % 5 = 0 THEN NULL ELSE concat('T', quarter(period_end)) END AS tag FROM a_q"""


@query("A12_merged_provenance", f"""SELECT cik, period_end, coalesce(tag, lag(tag, 1) OVER w, lag(tag, 2) OVER w, lag(tag, 3) OVER w) AS revenue_tag,
  CASE WHEN derived OR coalesce(lag(derived, 1) OVER w, false) OR coalesce(lag(derived, 2) OVER w, false) OR coalesce(lag(derived, 3) OVER w, false) THEN 'cumulative_diff@' || concat_ws(',', CASE WHEN derived THEN period_end::VARCHAR END,
    CASE WHEN lag(derived, 1) OVER w THEN (lag(period_end, 1) OVER w)::VARCHAR END, CASE WHEN lag(derived, 2) OVER w THEN (lag(period_end, 2) OVER w)::VARCHAR END,
    CASE WHEN lag(derived, 3) OVER w THEN (lag(period_end, 3) OVER w)::VARCHAR END) END AS derived FROM ({_TAGS}) x WINDOW w AS (PARTITION BY cik ORDER BY period_end)""")
def a12(t):
    rows = t.sql(_TAGS).selectExpr("cik", "period_end", """map_filter(map('revenue', tag, 'derived', CASE WHEN derived THEN 'cumulative_diff' END), (k, v) -> v IS NOT NULL) AS source_tags""")
    w = Window.partitionBy("cik").orderBy("period_end")
    out = rows.select("cik", "period_end", pf.window_tags(w).alias("m"))
    return out.select("cik", "period_end", F.col("m")["revenue"].alias("revenue_tag"), F.col("m")["derived"].alias("derived"))


@query("A13_valid_tickers", "SELECT DISTINCT c.ticker FROM a_company c JOIN a_ci ci ON ci.cik = c.cik JOIN a_industry i ON i.slug = ci.industry_slug JOIN a_theme t ON t.slug = i.theme_slug")
def a13(t):
    return marts.dimension_chain(t.a_company, t.a_ci, t.a_industry, t.a_theme).select("ticker").distinct()


# ---- windows ----------------------------------------------------------------------------------------------------
_FL = ", ".join(FLOW_FIELDS)


@query("W1_trailing_year", f"SELECT cik, period_end, {_FL}, fcf, cash, total_debt, equity, shares_diluted, shares_outstanding FROM o_ttm")
def w1(t):
    return pf.trailing_year(t.a_q).drop("period_type")


@query("W2_newest_first_position", "SELECT cik, period_type, period_end, CAST(row_number() OVER (PARTITION BY cik, period_type ORDER BY period_end DESC) - 1 AS INT) AS pos FROM o_periods")
def w2(t):
    return pf.newest_first(periods(t)).select("cik", "period_type", "period_end", "pos")


@query("W3_growth_by_position", f"""SELECT cik, period_end, round({yoy_sql('revenue', 'p4')}, 6) AS yoy, round(CASE WHEN revenue > 0 AND p12 > 0 THEN pow(revenue / p12, 1.0::DOUBLE / 3) - 1 END, 6) AS cagr
  FROM (SELECT *, lag(revenue, 4) OVER w AS p4, lag(revenue, 12) OVER w AS p12 FROM o_ttm WINDOW w AS (PARTITION BY cik ORDER BY period_end)) x""")
def w3(t):
    w = Window.partitionBy("cik").orderBy("period_end")
    return pf.trailing_year(t.a_q).select("cik", "period_end", r(sc.yoy("revenue", F.lag("revenue", 4).over(w))).alias("yoy"), r(sc.cagr("revenue", F.lag("revenue", 12).over(w), 3)).alias("cagr"))


@query("W4_latest_quote", "SELECT cik, date, price FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY date DESC, event_id DESC) AS rn FROM a_quotes) x WHERE rn = 1")
def w4(t):
    log = t.a_quotes.select("cik", "date", "price", F.col("event_id").alias("load_seq"))
    return snap.latest_market(upsert.upsert_market(log)).select("cik", "date", "price")


@query("W8_declining_streak", "SELECT cik, coalesce(len(q) >= 3 AND q[1].revenue < q[2].revenue AND q[2].revenue < q[3].revenue, false) AS declining FROM o_arr_q")
def w8(t):
    return pf.period_arrays(t.a_q, ["Q"]).select("cik", pf.declining("q", 2).alias("declining"))


@query("W9_trailing_series", f"""SELECT cik, count(g) AS n, round(max(g), 6) AS highest, round(max_by(g, rn) FILTER (g IS NOT NULL), 6) AS oldest FROM (
  SELECT cik, row_number() OVER (PARTITION BY cik ORDER BY period_end DESC) AS rn, {ratio_sql('gross_profit', 'revenue')} AS g FROM a_q) x WHERE rn <= 8 GROUP BY cik""")
def w9(t):
    s = pf.period_arrays(t.a_q, ["Q"]).select("cik", metrics.gross_margins().alias("s"))
    return s.select("cik", F.size("s").cast("long").alias("n"), r(F.array_max("s")).alias("highest"), r(F.get("s", F.lit(0))).alias("oldest"))


# ---- set operations ---------------------------------------------------------------------------------------------


@query("U2_all_periods", "SELECT period_type, count(*) AS n, sum(revenue) AS revenue, count(DISTINCT cik) AS companies FROM o_periods GROUP BY 1")
def u2(t):
    return periods(t).groupBy("period_type").agg(F.count(F.lit(1)).alias("n"), F.sum("revenue").alias("revenue"), F.count_distinct("cik").alias("companies"))


@query("U5_completeness", f"""SELECT cik, period_end, {' + '.join(f'({f} IS NOT NULL)::INT' for f in COMPLETENESS_FIELDS)} AS present FROM o_ttm""")
def u5(t):
    return pf.trailing_year(t.a_q).select("cik", "period_end", sc.total([F.col(f).isNotNull().cast("int") for f in COMPLETENESS_FIELDS]).alias("present"))


