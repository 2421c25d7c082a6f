"""Parsers on texts that Spark derives from the tables, and universe decisions (S, F)."""
from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from quarterdeck.config import UNIVERSE
from quarterdeck.functions.scalars import finite, sufficient
from quarterdeck.operators import changes, periods as period_ops, universe as uni
from quarterdeck.operators.checkpoint import cut, new_path
from quarterdeck.plans import snapshot as snap
from quarterdeck.queries.adapter import AS_OF
from quarterdeck.queries.common import DAY, ORACLE
from quarterdeck.queries.registry import query
from quarterdeck.sources import companyfacts, filings, reference, taxonomy
from quarterdeck.tags import TRACKED_TAGS

# ---- raw texts --------------------------------------------------------------------------------------------------
_SUB = """SELECT {d} accession AS adsh, CASE WHEN cik % 19 = 4 THEN '' WHEN cik % 19 = 7 THEN 'x1' ELSE concat('', cik) END AS cik, form,
  CASE WHEN cik % 13 = 6 THEN '2001' ELSE replace(concat('', filed_date), '-', '') END AS filed FROM a_fact1"""
ORACLE["o_sub_raw"] = _SUB.format(d="DISTINCT")
ORACLE["o_sub"] = """SELECT adsh, TRY_CAST(cik AS BIGINT) AS cik, form, CAST(strptime(filed, '%Y%m%d') AS DATE) AS filed FROM o_sub_raw
  WHERE TRY_CAST(cik AS BIGINT) IS NOT NULL AND length(filed) = 8"""
ORACLE["o_num"] = """SELECT accession AS adsh, tag, replace(concat('', period_end), '-', '') AS ddate, qtrs, unit AS uom, value,
  CASE WHEN cik % 11 = 3 THEN 'SUBSIDIARY' ELSE '' END AS coreg, CASE WHEN cik % 11 = 5 AND qtrs = 1 THEN 'Segment=A' ELSE '' END AS segments
  FROM a_fact1 WHERE NOT (cik % 9 = 2 AND tag = 'Revenues') AND NOT (cik % 9 = 3 AND qtrs = 2)"""


def sub_raw(t):
    return t.sql(_SUB.format(d="DISTINCT"))


def num_raw(t):
    """All-text rows of a number file, with empty, non-numeric and infinite cells."""
    return t.a_fact1.selectExpr(
        "accession AS adsh", "tag", "replace(concat('', period_end), '-', '') AS ddate",
        "CASE WHEN cik % 9 = 3 AND qtrs = 2 THEN '' ELSE concat('', qtrs) END AS qtrs", "unit AS uom",
        "CASE WHEN cik % 9 = 2 AND tag = 'Revenues' THEN CASE WHEN cik % 2 = 0 THEN 'Infinity' ELSE 'n/a' END ELSE concat('', value) END AS value",
        "CASE WHEN cik % 11 = 3 THEN 'SUBSIDIARY' END AS coreg", "CASE WHEN cik % 11 = 5 AND qtrs = 1 THEN 'Segment=A' ELSE '' END AS segments")


@query("S1_filing_headers", "SELECT adsh, cik, form, filed FROM o_sub")
def s1(t):
    return filings.parse_sub(sub_raw(t))


@query("S2_numeric_facts", "SELECT * FROM o_num")
def s2(t):
    return filings.parse_num(num_raw(t))


_EMPTY = {"qtrs": "cik % 9 = 3 AND qtrs = 2", "coreg": "cik % 11 <> 3", "segments": "NOT (cik % 11 = 5 AND qtrs = 1)"}


@query("S3_required_columns", f"SELECT {', '.join(f'count(*) FILTER ({_EMPTY.get(c, False)}) AS {c}_empty' for c in filings.NUM_COLUMNS)} FROM a_fact1")
def s3(t):
    checked = filings.require_columns(num_raw(t), "num.txt", filings.NUM_COLUMNS)
    return checked.agg(*[F.count_if(F.coalesce(F.col(c), F.lit("")) == "").alias(f"{c}_empty") for c in filings.NUM_COLUMNS])


_MEMBERS = "SELECT c.cik FROM a_company c JOIN a_ci ci ON ci.cik = c.cik WHERE c.is_active"


@query("S4_consolidated_facts", f"""
SELECT s.cik, tag, uom AS unit, CAST(strptime(ddate, '%Y%m%d') AS DATE) AS period_end, qtrs, value, form, filed AS filed_date, n.adsh AS accession
FROM o_num n JOIN o_sub s ON s.adsh = n.adsh WHERE coreg = '' AND segments = '' AND tag IN ({', '.join(repr(x) for x in TRACKED_TAGS)}) AND s.cik IN ({_MEMBERS})""")
def s4(t):
    return filings.extract_facts(filings.parse_num(num_raw(t)), filings.parse_sub(sub_raw(t)), changes.universe(t.a_company, t.a_ci)).drop("period_start", "source")


# every quarter of the log as two files; one lost its value column, some lines have a cell too many, and one quarter was never published
_LOST, _NEVER = "2000q3", "2003q1"
_QUARTER = "concat('', year(filed_date), 'q', quarter(filed_date))"


def _lines(df, cells):
    """Rows as whole lines under a header line, so that a cell may hold the separator."""
    line = F.concat_ws("\t", *[F.coalesce(F.col(c), F.lit("")) for c in cells])
    return df.select("quarter", line.alias("\t".join(cells)))


def _quarter_files(t) -> str:
    root = new_path(t.spark, "bulk")
    lines = {"header": True, "sep": "\u0001", "quote": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    num = cut(t.sql(f"""SELECT {_QUARTER} AS quarter, accession AS adsh, tag, replace(concat('', period_end), '-', '') AS ddate, concat('', qtrs) AS qtrs, unit AS uom,
      CASE WHEN cik % 11 = 5 AND qtrs = 1 THEN 'Segment=A' WHEN cik % 13 = 4 AND tag = 'NetIncomeLoss' THEN concat('a', chr(9), 'b') END AS segments, CASE WHEN cik % 11 = 3 THEN 'SUBSIDIARY' END AS coreg, concat('', value) AS value FROM a_fact1"""))
    sub = t.sql(f"SELECT DISTINCT {_QUARTER} AS quarter, accession AS adsh, concat('', cik) AS cik, form, replace(concat('', filed_date), '-', '') AS filed FROM a_fact1")
    _lines(num, filings.NUM_COLUMNS).write.partitionBy("quarter").options(**lines).csv(f"{root}/num.txt")
    _lines(sub, filings.SUB_COLUMNS).write.partitionBy("quarter").options(**lines).csv(f"{root}/sub.txt")
    lost = _lines(num.where(F.col("quarter") == _LOST), [c for c in filings.NUM_COLUMNS if c != "value"])
    lost.drop("quarter").write.mode("overwrite").options(**lines).csv(f"{root}/num.txt/quarter={_LOST}")
    return root


def bulk(t):
    quarters = [d for y in range(1995, 2004) for d in (date(y, 1, 1), date(y, 4, 1), date(y, 7, 1), date(y, 10, 1))]
    held = {r[0] for r in t.sql(f"SELECT DISTINCT {_QUARTER} AS quarter FROM a_fact1").collect()} | {_NEVER}
    return filings.load_bulk(t.spark, _quarter_files(t), [q for q in quarters if filings.quarter_label(q) in held], changes.universe(t.a_company, t.a_ci), "{root}/{file}/quarter={quarter}")


_MEMBER_FACTS = f"""SELECT {_QUARTER} AS quarter, cik, tag, unit, period_end, qtrs, value, form, filed_date, accession FROM a_fact1
WHERE cik % 11 <> 3 AND NOT (cik % 11 = 5 AND qtrs = 1) AND NOT (cik % 13 = 4 AND tag = 'NetIncomeLoss') AND cik IN ({_MEMBERS}) AND tag IN ({', '.join(repr(x) for x in TRACKED_TAGS)})"""


@query("S15_bulk_quarters", f"SELECT * EXCLUDE (quarter) FROM ({_MEMBER_FACTS}) x WHERE quarter <> '{_LOST}'")
def s15(t):
    return bulk(t)[0].drop("period_start", "source")


@query("S15_quarter_report", f"""
SELECT q.quarter, CASE WHEN q.quarter = '{_LOST}' THEN 'failed' ELSE 'loaded' END AS status, CASE WHEN q.quarter <> '{_LOST}' THEN q.lines END AS lines, CASE WHEN q.quarter <> '{_LOST}' THEN q.broken END AS broken_lines,
  CASE WHEN q.quarter <> '{_LOST}' THEN coalesce(m.facts, 0) END AS facts
FROM (SELECT {_QUARTER} AS quarter, count(*) AS lines, count(*) FILTER (cik % 13 = 4 AND tag = 'NetIncomeLoss' AND NOT (cik % 11 = 5 AND qtrs = 1)) AS broken FROM a_fact1 GROUP BY 1) q
LEFT JOIN (SELECT quarter, count(*) AS facts FROM ({_MEMBER_FACTS}) x GROUP BY 1) m ON m.quarter = q.quarter
UNION ALL SELECT '{_NEVER}', 'failed', NULL, NULL, NULL""")
def s15_report(t):
    return bulk(t)[1].drop("error")


_QTRS = """CASE WHEN period_start IS NULL OR period_end <= period_start THEN 0 ELSE greatest(1, CAST(round(date_diff('day', period_start, period_end) / 91.31::DOUBLE) AS INT)) END"""


@query("S5_company_facts", f"""
SELECT cik, tag, unit, period_start, period_end, value, form, filed_date, accession, 'api' AS source, {_QTRS} AS qtrs
FROM a_fact1 WHERE cik % 3 <> 0 AND NOT (cik % 5 = 1 AND qtrs = 0)""")
def s5(t):
    # one document per company and tag; entries of some companies lack the accession or the form
    facts = t.a_fact1.where("source = 'api'").selectExpr(
        "cik", "tag", "unit", "named_struct('start', concat('', period_start), 'end', concat('', period_end), 'val', value, 'form', form, 'filed', "
        "concat('', filed_date), 'accn', CASE WHEN cik % 5 = 1 AND qtrs = 0 THEN NULL ELSE accession END) AS e")
    docs = facts.groupBy("cik", "tag", "unit").agg(F.collect_list("e").alias("es"))
    docs = docs.select(F.to_json(F.struct(
        F.when(F.expr("cik % 2 = 0"), F.lpad(F.col("cik").cast("string"), 10, "0")).otherwise(F.col("cik").cast("string")).alias("cik"),
        F.create_map(F.lit("us-gaap"), F.create_map(F.col("tag"), F.struct(F.create_map(F.col("unit"), F.col("es")).alias("units")))).alias("facts"))).alias("value"))
    return companyfacts.parse_company_facts(docs)


@query("S6_period_length", f"SELECT cik, tag, period_end, qtrs, load_seq, form, accession, {_QTRS} AS derived FROM a_facts")
def s6(t):
    return t.a_facts.select("cik", "tag", "period_end", "qtrs", "load_seq", "form", "accession", filings.derive_qtrs("period_start", "period_end").alias("derived"))


@query("S7_listings", "SELECT ticker, exchange, security_name, is_etf, is_test_issue, financial_status, CASE WHEN p_partkey % 10 = 9 THEN NULL ELSE round_lot END AS round_lot FROM a_listing WHERE p_partkey % 17 <> 6")
def s7(t):
    lines = t.a_listing.selectExpr("""CASE WHEN p_partkey % 17 = 6 THEN CASE p_partkey % 3 WHEN 0 THEN 'File Creation Time: 1115200121:33|||||||||||' WHEN 1 THEN '  ' ELSE concat('Y|', ticker, '|short') END
      ELSE concat_ws('|', 'Y', concat(ticker, ' '), security_name, exchange, ' ', CASE WHEN is_etf THEN 'Y' ELSE 'N' END, CASE WHEN p_partkey % 10 = 9 THEN 'n/a' ELSE '100' END,
        CASE WHEN is_test_issue THEN 'Y' ELSE 'N' END, coalesce(financial_status, ''), '', ticker, 'N') END AS value""")
    header = t.a_listing.where("p_partkey % 17 = 6 AND p_partkey % 3 = 2").selectExpr("'Nasdaq Traded|Symbol|Security Name|Listing Exchange|Market Category|ETF|Round Lot Size|Test Issue|Financial Status' AS value")
    return reference.parse_listings(lines.union(header))


@query("S8_ticker_map", "SELECT cik, ticker, title FROM a_ticker WHERE cik % 16 NOT IN (3, 9)")
def s8(t):
    docs = t.a_ticker.selectExpr("""concat('{"', cik, '":{"cik_str":', CASE WHEN cik % 16 = 3 THEN '"none"' ELSE concat('', cik) END, ',"ticker":"',
      CASE WHEN cik % 16 = 9 THEN '' ELSE ticker END, '","title":"', title, '"}}') AS value""")
    return reference.parse_ticker_map(docs)


@query("S9_company_reference", "SELECT cik, name, sic, sic_description, entity_type FROM a_reference")
def s9(t):
    docs = t.a_reference.select(F.to_json(F.struct(
        F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik"), "name", F.coalesce("sic", F.lit("")).alias("sic"),
        F.coalesce("sic_description", F.lit("")).alias("sicDescription"), F.col("entity_type").alias("entityType"))).alias("value"))
    return reference.parse_submissions(docs).select("cik", "name", "sic", "sic_description", "entity_type")


@query("S10_quotes", "SELECT concat('U', cik) AS ticker, price, date FROM a_quotes WHERE price > 0")
def s10(t):
    return reference.parse_quotes(t.a_quotes.select(F.concat(F.lit("U"), "cik").alias("ticker"), "price", F.unix_timestamp("ts").alias("time")))




def tax(t):
    return taxonomy.load_taxonomy(t.spark, ["6770", "3100"])


ORACLE["o_ind"] = "SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{th}', '{n}')" for s, th, n in taxonomy.INDUSTRIES) + ") v(slug, theme, name)"
ORACLE["o_sic"] = ("SELECT v.sic, i.theme, v.industry FROM (VALUES " + ", ".join(f"('{c}', '{i}')" for c, i in taxonomy.SIC_CODES)
                   + ") v(sic, industry) JOIN o_ind i ON i.slug = v.industry")
ORACLE["o_ovr"] = "SELECT * FROM (VALUES " + ", ".join(f"('{x}', '{i}')" for x, i in taxonomy.OVERRIDES) + ") v(ticker, industry)"
ORACLE["o_rev"] = "SELECT * FROM (VALUES " + ", ".join(f"('{x}')" for x in taxonomy.RESIDUAL_REVIEWED) + ") v(sic)"
ORACLE["o_class"] = """
SELECT r.*, upper(k.ticker) AS ticker, coalesce(o.industry, s.industry) AS industry_slug, CASE WHEN o.industry IS NOT NULL THEN oi.theme ELSE s.theme END AS theme_slug,
       CASE WHEN o.industry IS NOT NULL THEN 'override' WHEN s.industry IS NOT NULL THEN 'sic' END AS source
FROM a_reference r JOIN a_ticker k ON k.cik = r.cik LEFT JOIN o_ovr o ON o.ticker = upper(k.ticker) LEFT JOIN o_ind oi ON oi.slug = o.industry LEFT JOIN o_sic s ON s.sic = r.sic"""


@query("S12_taxonomy_coverage", """
SELECT coalesce(i.theme, 'unmapped') AS theme, coalesce(s.industry, 'unmapped') AS industry, count(*) AS companies FROM a_reference r
LEFT JOIN o_sic s ON s.sic = r.sic LEFT JOIN o_ind i ON i.slug = s.industry GROUP BY 1, 2""")
def s12(t):
    codes = tax(t).sic_map
    return (t.a_reference.join(codes, "sic", "left").groupBy(F.coalesce("theme", F.lit("unmapped")).alias("theme"), F.coalesce("industry", F.lit("unmapped")).alias("industry"))
            .agg(F.count(F.lit(1)).alias("companies")))


@query("S13_taxonomy_violations", """
SELECT 'industry.theme' AS rule, slug AS subject FROM a_industry WHERE theme_slug NOT IN (SELECT replace(slug, 'ASIA', 'FAR EAST') FROM a_theme) UNION ALL
SELECT 'map.industry', concat('', 3000 + s_nationkey) FROM (SELECT DISTINCT s_nationkey FROM a_size WHERE s_nationkey % 5 = 0) x UNION ALL
SELECT 'tam_source', slug FROM a_industry WHERE tam_usd IS NOT NULL""")
def s13(t):
    industries = t.a_industry.withColumn("tam_source", F.lit(None).cast("string"))
    codes = t.a_size.join(t.sql("SELECT n_nationkey AS s_nationkey, n_name AS industry, r_name AS theme FROM nation JOIN region ON r_regionkey = n_regionkey"), "s_nationkey")
    sic_map = codes.selectExpr("concat('', 3000 + s_nationkey) AS sic", "CASE WHEN s_nationkey % 5 = 0 THEN 'gone' ELSE industry END AS industry", "CAST(NULL AS STRING) AS theme").distinct()
    built = taxonomy.Taxonomy(t.a_theme.withColumn("slug", F.expr("replace(slug, 'ASIA', 'FAR EAST')")), industries, sic_map, tax(t).overrides.where("FALSE"), sic_map.select("sic"), tax(t).unmapped)
    return taxonomy.taxonomy_violations(built)


@query("S14_recent_quarter_facts", f"""
SELECT date_trunc('quarter', filed_date)::DATE AS quarter, count(*) AS facts FROM a_facts
WHERE date_trunc('quarter', filed_date) BETWEEN date_trunc('quarter', {DAY} - 45) - INTERVAL 21 MONTH AND date_trunc('quarter', {DAY} - 45) GROUP BY 1""")
def s14(t):
    wanted = filings.recent_quarters(F.lit(AS_OF).cast("date"))
    quarter = F.date_trunc("quarter", "filed_date").cast("date")
    return t.a_facts.where(F.array_contains(wanted, quarter)).groupBy(quarter.alias("quarter")).agg(F.count(F.lit(1)).alias("facts"))


# ---- universe ---------------------------------------------------------------------------------------------------
_TYPE = "CASE WHEN contains(security_name, ' - ') THEN split_part(security_name, ' - ', -1) END"


@query("F1_security_type", f"SELECT ticker, {_TYPE} AS security_type FROM a_listing")
def f1(t):
    return t.a_listing.select("ticker", uni.security_type("security_name").alias("security_type"))


_any = lambda words: "(" + " OR ".join(f"contains({_TYPE}, '{w}')" for w in words) + ")"
_WHY = f"""CASE WHEN is_etf THEN 'ETF' WHEN is_test_issue THEN 'TEST_ISSUE' WHEN exchange NOT IN ('N', 'Q', 'A') THEN 'EXCHANGE'
  WHEN financial_status IN ('D', 'E', 'Q') THEN 'FINANCIAL_STATUS' WHEN {_TYPE} IS NULL THEN 'UNKNOWN_SECURITY_TYPE'
  WHEN {_any(UNIVERSE['name_exclude'])} OR NOT {_any(UNIVERSE['name_include'])} THEN 'NOT_COMMON_STOCK' END"""


@query("F2_listing_filter", f"SELECT ticker, {_WHY} AS reason FROM a_listing")
def f2(t):
    return t.a_listing.select("ticker", uni.listing_rejection().alias("reason"))


_RES = r"""(coalesce(regexp_full_match(sic, '\d{2}00'), false) OR coalesce(regexp_matches(sic_description, '\bNEC\b') OR regexp_matches(sic_description, '(?i)not elsewhere classified')
  OR regexp_matches(sic_description, '(?i)\bmisc(ellaneous)?\b') OR regexp_matches(sic_description, '(?i),\s*etc\.?\s*$'), false))"""


@query("F3_residual_sic", f"SELECT cik, {_RES} AS residual FROM a_reference")
def f3(t):
    return t.a_reference.select("cik", uni.residual_sic("sic", "sic_description").alias("residual"))


ORACLE["o_decide"] = f"""
SELECT k.cik, upper(k.ticker) AS ticker, c.sic, c.industry_slug, CASE WHEN c.cik IS NULL THEN 'LOOKUP_FAILED' WHEN c.entity_type <> 'operating' THEN 'NOT_OPERATING'
  WHEN c.sic = '6770' THEN 'EXCLUDED_SIC' WHEN c.industry_slug IS NULL THEN 'UNCLASSIFIABLE'
  WHEN c.source = 'sic' AND c.sic NOT IN (SELECT sic FROM o_rev) AND {_RES.replace('sic_description', 'c.sic_description').replace('(sic,', '(c.sic,')} THEN 'RESIDUAL_SIC' ELSE 'ACCEPTED' END AS decision
FROM a_ticker k JOIN (SELECT ticker FROM a_listing WHERE ({_WHY}) IS NULL) l ON upper(l.ticker) = upper(k.ticker) LEFT JOIN o_class c ON c.cik = k.cik"""


def decisions(t):
    return uni.decide(t.a_ticker, t.a_listing, t.a_reference, tax(t))


@query("F4_universe_decision", "SELECT cik, ticker, industry_slug, decision FROM o_decide")
def f4(t):
    return decisions(t).select("cik", "ticker", "industry_slug", "decision")


@query("F4_settled_companies", "SELECT cik, max(decision <> 'ACCEPTED') AS rejected, max(decision = 'ACCEPTED') AS accepted FROM o_decide WHERE decision <> 'LOOKUP_FAILED' GROUP BY cik")
def f4b(t):
    return uni.settle(decisions(t))


@query("F5_classification", "SELECT cik, ticker, industry_slug, theme_slug, source FROM o_class")
def f5(t):
    rows = t.a_reference.join(t.a_ticker.select("cik", F.upper("ticker").alias("ticker")), "cik")
    return uni.classify(rows, tax(t)).select("cik", "ticker", "industry_slug", "theme_slug", "source")


@query("F6_unmapped_sics", "SELECT DISTINCT sic FROM o_decide WHERE decision = 'UNCLASSIFIABLE' AND sic IS NOT NULL AND sic NOT IN ('6770', '3100')")
def f6(t):
    return uni.unmapped_codes(decisions(t), tax(t)).orderBy("sic")


_BAD = "SELECT cik, period_end, period_type, CASE WHEN cik % 10 = 1 THEN -revenue ELSE revenue END AS revenue, CASE WHEN cik % 10 = 2 THEN revenue * 2 ELSE gross_profit END AS gross_profit FROM a_q"


@query("F7_validated_periods", f"""SELECT cik, period_end, CASE WHEN revenue >= 0 THEN revenue END AS revenue,
  CASE WHEN revenue >= 0 AND gross_profit > revenue THEN NULL ELSE gross_profit END AS gross_profit FROM ({_BAD}) x""")
def f7(t):
    return period_ops.validate(t.sql(_BAD)).select("cik", "period_end", "revenue", "gross_profit")


@query("F7_rejections", f"""SELECT cik, period_end, period_type, 'revenue' AS field, 'revenue_negative' AS reason, revenue AS value FROM ({_BAD}) x WHERE revenue < 0 UNION ALL
  SELECT cik, period_end, period_type, 'gross_profit', 'gross_profit_exceeds_revenue', gross_profit FROM ({_BAD}) x WHERE revenue >= 0 AND gross_profit > revenue""")
def f7b(t):
    return period_ops.rejections(period_ops.validate(t.sql(_BAD)))


@query("F8_sufficient_data", "SELECT cik, completeness IS NULL OR completeness >= 0.6 AS sufficient FROM (SELECT cik, CASE WHEN max(cash) IS NULL THEN NULL ELSE count(CASE WHEN cik % 3 <> 2 OR quarter(period_end) = 4 THEN gross_profit END) / count(*) END AS completeness FROM a_q GROUP BY cik) x")
def f8(t):
    held = F.when(F.expr("cik % 3 <> 2 OR quarter(period_end) = 4"), F.col("gross_profit"))
    rows = t.a_q.groupBy("cik").agg(F.when(F.max("cash").isNotNull(), F.count(held) / F.count(F.lit(1))).alias("c"))
    return rows.select("cik", sufficient("c", 0.6).alias("sufficient"))


@query("F9_finite_values", "SELECT cik, count(*) AS n, sum(rd_expense) AS total FROM a_q WHERE rd_expense IS NOT NULL AND quarter(period_end) <> 2 GROUP BY cik")
def f9(t):
    v = t.a_q.selectExpr("cik", "CASE WHEN quarter(period_end) = 2 THEN CASE WHEN cik % 2 = 0 THEN double('NaN') ELSE double('Infinity') END ELSE rd_expense END AS v")
    return v.where(finite("v")).groupBy("cik").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@query("F10_universe", _MEMBERS.replace("c.cik", "c.cik, c.ticker", 1))
def f10(t):
    return changes.universe(t.a_company, t.a_ci).select("cik", "ticker")


@query("F11_unknown_slugs", "SELECT cik, 'GONE' AS industry_slug FROM a_ci WHERE cik % 4 = 1")
def f11(t):
    return snap.unknown_slugs(t.a_ci.withColumn("industry_slug", F.expr("CASE WHEN cik % 4 = 1 THEN 'GONE' ELSE industry_slug END")), t.a_industry).select("cik", "industry_slug")


