"""Maps the driver tables onto the fundamentals schema.

Supplier = company, nation = industry, region = theme, lineitem by ship quarter = reported facts. Each mapping is one
SELECT in the SQL both engines understand, so the library and its check read the same rows. Amounts are whole numbers
held as doubles, which makes every sum and difference exact in any order.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from quarterdeck import tags as t
from quarterdeck.operators.checkpoint import cut

AS_OF = "2001-11-15"

CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"
DISC = "CAST(round(l_discount * 100) AS BIGINT)"
TAX = "CAST(round(l_tax * 100) AS BIGINT)"
NET = f"{CENTS} * (100 - {DISC})"


def _whole(expr):
    return f"CAST(floor({expr}) AS DOUBLE)"


def _sum(expr):
    return f"CAST(SUM({expr}) AS DOUBLE)"


CTES: dict[str, str] = {}

CTES["a_line"] = f"""
SELECT l_suppkey AS cik,
       CAST(last_day(date_trunc('quarter', l_shipdate) + INTERVAL '2' MONTH) AS DATE) AS period_end,
       {_sum(NET)} AS net,
       {_sum(f"CASE WHEN l_returnflag = 'R' THEN {NET} ELSE 0 END")} AS net_r,
       {_sum(f"CASE WHEN l_returnflag = 'N' THEN {NET} ELSE 0 END")} AS net_n,
       {_sum(f"{CENTS} * {TAX}")} AS tax,
       {_sum(f"CASE WHEN l_linestatus = 'O' THEN {CENTS} * {TAX} ELSE 0 END")} AS tax_o,
       {_sum(f"{CENTS} * {DISC}")} AS disc,
       {_sum("CAST(l_quantity AS BIGINT)")} AS qty
FROM lineitem GROUP BY 1, 2"""

CTES["a_size"] = """
SELECT s_suppkey AS cik, s_nationkey, s_name, CAST(power(4, s_suppkey % 6) AS DOUBLE) AS m,
       CAST(round(s_acctbal * 100) AS DOUBLE) AS bal,
       CAST(1000000 * (10 + s_suppkey % 40) AS DOUBLE) * CAST(power(2, s_suppkey % 6) AS DOUBLE) AS base_shares
FROM supplier"""

# every quarter of every company, the running one included, with the fields some companies never report
CTES["a_full"] = f"""
SELECT l.cik, l.period_end, CAST((year(l.period_end) - 1995) * 4 + quarter(l.period_end) AS INT) AS qi,
       {_whole('net * m / 10000')} AS revenue,
       CASE WHEN l.cik % 17 = 3 THEN NULL ELSE {_whole('(8 * net - 10 * net_r) * m / 100000')} END AS gross_profit,
       {_whole('(100 * net_n - 25 * net) * m / 1000000')} AS operating_income,
       {_whole('(80 * net_n - 20 * net) * m / 1000000')} AS net_income,
       {_whole('net_n * m / 20000')} AS ocf,
       {_whole('3 * tax * m / 10000')} AS capex,
       CASE WHEN l.cik % 19 = 5 THEN NULL ELSE qty * 2000 * m END AS cash,
       CASE WHEN l.cik % 23 = 7 THEN NULL ELSE {_whole('4 * tax * m / 10000')} + abs(bal) * m END AS total_debt,
       (bal - 50000) * 3 * m AS equity,
       CASE WHEN l.cik % 21 = 8 THEN NULL ELSE base_shares *
            (CASE WHEN l.period_end > DATE '2000-09-30' AND l.cik % 8 = 7 THEN 1.75
                  WHEN l.period_end > DATE '2000-09-30' AND l.cik % 8 = 6 THEN 1.25 ELSE 1.0 END) END AS shares_diluted,
       CASE WHEN l.cik % 29 = 11 THEN NULL ELSE base_shares END AS shares_outstanding,
       CASE WHEN l.cik % 6 = 5 THEN NULL ELSE {_whole('2 * disc * m / 10000')} END AS sbc,
       CASE WHEN l.cik % 5 = 4 THEN NULL ELSE {_whole('4 * tax_o * m / 10000')} END AS rd_expense,
       {_whole('4 * tax * m / 10000')} AS short_debt, abs(bal) * m AS long_debt
FROM a_line l JOIN a_size s ON s.cik = l.cik"""

_P = ("revenue, gross_profit, operating_income, net_income, ocf, capex, ocf - capex AS fcf, cash, total_debt, equity, "
      "shares_diluted, shares_outstanding, sbc, rd_expense")

CTES["a_q"] = f"""
SELECT cik, period_end, 'Q' AS period_type, {_P}
FROM a_full"""

_Q4 = ["cash", "total_debt", "equity", "shares_diluted", "shares_outstanding"]
CTES["a_annual"] = f"""
SELECT cik, MAX(period_end) AS period_end, 'A' AS period_type,
       SUM(revenue) AS revenue, SUM(gross_profit) AS gross_profit, SUM(operating_income) AS operating_income,
       SUM(net_income) AS net_income, SUM(ocf) AS ocf, SUM(capex) AS capex, SUM(ocf) - SUM(capex) AS fcf,
       {', '.join(f'MAX(CASE WHEN quarter(period_end) = 4 THEN {c} END) AS {c}' for c in _Q4)},
       SUM(sbc) AS sbc, SUM(rd_expense) AS rd_expense
FROM a_full GROUP BY cik, year(period_end) HAVING COUNT(*) = 4"""

CTES["a_company"] = """
SELECT cik, concat('S', cik) AS ticker, s_name AS name, concat('', 3000 + s_nationkey) AS sic,
       CASE WHEN s_nationkey % 7 = 3 THEN concat('NATION ', s_nationkey, ', NEC')
            ELSE concat('NATION ', s_nationkey) END AS sic_description,
       'Q' AS exchange, CASE WHEN s_nationkey % 3 = 1 THEN '0630' WHEN s_nationkey % 3 = 2 THEN '1231' END AS fiscal_year_end, concat('N', s_nationkey) AS state,
       concat('NATION ', s_nationkey) AS state_description, 'operating' AS entity_type, cik % 37 <> 5 AS is_active,
       DATE '1999-01-01' AS first_seen, DATE '2001-01-01' AS last_updated
FROM a_size"""

CTES["a_ci"] = """
SELECT s.cik, n.n_name AS industry_slug, r.r_name AS theme_slug,
       CASE WHEN s.cik % 10 = 3 THEN 'override' ELSE 'sic' END AS source
FROM a_size s JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey"""

CTES["a_industry"] = """
SELECT n.n_name AS slug, r.r_name AS theme_slug, n.n_name AS name,
       CASE WHEN n.n_nationkey % 4 = 1 THEN 5e9 * (n.n_nationkey + 1) END AS tam_usd,
       CASE WHEN n.n_nationkey % 3 = 1 THEN 0.01 * n.n_nationkey END AS tam_cagr
FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey"""
CTES["a_industry"] = CTES["a_industry"].replace("5e9 * (n.n_nationkey + 1)", "CAST(5000000000 AS DOUBLE) * (n.n_nationkey + 1)")
CTES["a_industry"] = CTES["a_industry"].replace("0.01 * n.n_nationkey", "CAST(n.n_nationkey AS DOUBLE) / 100")

CTES["a_theme"] = "SELECT r_name AS slug, r_name AS name, CAST(r_regionkey AS INT) AS display_order FROM region"

CTES["a_market"] = f"""
SELECT cik, d.date, price, shares_outstanding, price * shares_outstanding AS market_cap,
       CASE WHEN shares_outstanding IS NOT NULL THEN 'reported' END AS shares_basis, CAST(0 AS BIGINT) AS load_seq
FROM (SELECT cik, CASE WHEN cik % 29 = 11 THEN NULL ELSE base_shares END AS shares_outstanding,
             floor(1000 + abs(bal) / 100) / 100 AS price FROM a_size) p
JOIN (SELECT CAST(DATE '2001-11-12' AS DATE) AS date, 1 AS k UNION ALL SELECT CAST(DATE '2001-11-05' AS DATE), 2) d
  ON d.k <= 1 + p.cik % 2"""

# ---- the fact log -----------------------------------------------------------------------------------------------
_DURATION = {
    t.REVENUES: "revenue",
    t.REVENUE_EXCL_TAX: f"CASE WHEN cik % 8 = 1 THEN {_whole('revenue * 99 / 100')} END",
    t.GROSS_PROFIT: "CASE WHEN cik % 8 NOT IN (2, 4) THEN gross_profit END",
    "CostOfRevenue": "CASE WHEN cik % 8 = 2 THEN revenue - gross_profit END",
    t.OPERATING_INCOME: "CASE WHEN cik % 8 NOT IN (3, 4) THEN operating_income END",
    t.OPERATING_EXPENSES: "CASE WHEN cik % 8 = 3 THEN gross_profit - operating_income END",
    t.COSTS_AND_EXPENSES: "CASE WHEN cik % 8 = 4 THEN revenue - operating_income END",
    t.NET_INCOME: "net_income",
    t.OCF_CHAIN[0]: "ocf",
    t.CAPEX_CHAIN[0]: "capex",
    t.SBC: "sbc",
    t.RD: "rd_expense",
}
_AVERAGE = {t.DILUTED_SHARES: "shares_diluted",
            t.BASIC_SHARES_CHAIN[0]: "shares_outstanding"}
_INSTANT = {
    t.CASH: "cash",
    t.SHORT_TERM_INVESTMENTS: f"CASE WHEN cik % 3 = 1 AND quarter(period_end) IN (2, 4) THEN {_whole('cash / 10')} END",
    t.EQUITY: "equity",
    t.COVER_SHARES: f"""CASE WHEN cik % 12 = 5 THEN {_whole('shares_outstanding * 3 / 10')}
                             WHEN cik % 12 = 7 THEN {_whole('shares_outstanding / 500')} ELSE shares_outstanding END""",
    t.DEBT_CURRENT: "CASE WHEN cik % 16 NOT IN (9, 10, 12, 13, 14) THEN short_debt END",
    t.LTD_NONCURRENT: """CASE WHEN cik % 16 = 12 THEN long_debt
                              WHEN cik % 16 NOT IN (9, 10, 11, 13, 14) AND quarter(period_end) = 4
                                   AND NOT (cik % 4 = 1 AND period_end > DATE '1999-12-31') THEN long_debt END""",
    t.LTD_CURRENT: "CASE WHEN cik % 16 = 12 THEN short_debt END",
    t.LTD: """CASE WHEN cik % 16 = 12 THEN long_debt + short_debt WHEN cik % 16 = 14 THEN long_debt
                   WHEN cik % 16 = 3 AND quarter(period_end) = 2 THEN long_debt END""",
    "ShortTermBorrowings": "CASE WHEN cik % 16 IN (12, 14) THEN short_debt END",
    "NotesPayable": "CASE WHEN cik % 16 = 9 AND quarter(period_end) IN (2, 4) THEN long_debt + short_debt END",
    "NotesPayableNoncurrent": "CASE WHEN cik % 16 = 9 AND quarter(period_end) IN (1, 3) THEN long_debt END",
    "NotesPayableCurrent": "CASE WHEN cik % 16 = 9 THEN short_debt END",
    t.DEBT_COMBINED: "CASE WHEN cik % 16 = 13 THEN long_debt + short_debt END",
    t.LEASED_SPANNING: "CASE WHEN cik % 16 = 10 THEN long_debt + short_debt END",
    "FinanceLeaseLiability": f"CASE WHEN cik % 16 = 10 THEN {_whole('long_debt / 4')} END",
    t.LEASED_NONCURRENT: "CASE WHEN cik % 16 = 11 THEN long_debt END",
    "FinanceLeaseLiabilityNoncurrent": f"CASE WHEN cik % 16 = 11 THEN {_whole('long_debt / 5')} END",
    "FinanceLeaseLiabilityCurrent": f"CASE WHEN cik % 16 = 11 THEN {_whole('short_debt / 5')} END",
}


def _ytd(expr, bump):
    run = f"SUM({expr}) OVER (PARTITION BY cik, year(period_end) ORDER BY period_end ROWS UNBOUNDED PRECEDING)"
    return f"CASE WHEN cik % 10 = 0 AND quarter(period_end) = 2 THEN {run} * 1.5 ELSE {run} END" if bump else run


_single = ", ".join(f"{e} AS {n}" for n, e in {**_DURATION, **_AVERAGE}.items())
_span = ", ".join([*[f"CAST({_ytd(e, n in (t.REVENUES, t.OCF_CHAIN[0]))} AS DOUBLE) AS {n}" for n, e in _DURATION.items()],
                   *[f"{e} AS {n}" for n, e in _AVERAGE.items()]])

CTES["a_fact0"] = f"""
SELECT cik, tag, period_end, qtrs, value FROM (
  SELECT cik, period_end, 1 AS qtrs, {_single} FROM a_full WHERE NOT (quarter(period_end) = 4 AND cik % 2 = 0)
  UNION ALL
  SELECT * FROM (SELECT cik, period_end, CAST(quarter(period_end) AS INT) AS qtrs, {_span} FROM a_full) y WHERE qtrs > 1
) w UNPIVOT (value FOR tag IN ({', '.join([*_DURATION, *_AVERAGE])}))
WHERE TRUE
UNION ALL
SELECT cik, tag, period_end, 0 AS qtrs, value FROM (
  SELECT cik, period_end, {', '.join(f'{e} AS {n}' for n, e in _INSTANT.items())} FROM a_full
) w UNPIVOT (value FOR tag IN ({', '.join(_INSTANT)}))"""

CTES["a_fact1"] = """
SELECT cik, tag, CASE WHEN tag LIKE '%hares%' AND tag <> 'ShareBasedCompensation' THEN 'shares' ELSE 'USD' END AS unit,
       CASE WHEN cik % 3 = 0 OR qtrs = 0 THEN NULL
            WHEN qtrs = 1 THEN CAST(date_trunc('quarter', period_end) AS DATE)
            ELSE CAST(date_trunc('year', period_end) AS DATE) END AS period_start,
       period_end, qtrs, value, CASE WHEN quarter(period_end) = 4 THEN '10-K' ELSE '10-Q' END AS form,
       period_end + CAST(40 + cik % 5 AS INT) AS filed_date, concat(cik, '-', period_end) AS accession,
       CASE WHEN cik % 3 = 0 THEN 'bulk' ELSE 'api' END AS source
FROM a_fact0"""


_COLS = ["cik", "tag", "unit", "period_start", "period_end", "qtrs", "value", "form", "filed_date", "accession", "source"]
_API = "cik % 3 <> 0"
_TWO = "tag IN ('Revenues', 'NetIncomeLoss')"
_NO_START = {"period_start": "CAST(NULL AS DATE)", "source": "'bulk'"}
# load sequence -> (which facts are filed again, what differs then)
VARIANTS = {
    0: ("TRUE", {}),
    10: ("tag = 'Revenues' AND qtrs = 1 AND (cik + quarter(period_end)) % 4 = 0",
         {"value": _whole("value * 101 / 100"), "filed_date": "filed_date + 60", "accession": "concat('R', accession)"}),
    20: (f"cik % 5 = 0 AND {_API} AND qtrs = 1", {"value": _whole("value * 102 / 100"), **_NO_START}),
    30: (f"cik % 7 = 0 AND {_API} AND qtrs < 2", {"period_end": "period_end + 3", **_NO_START}),
    40: (f"cik % 11 = 0 AND {_API} AND qtrs = 1 AND quarter(period_end) = 2 AND {_TWO}",
         {"period_end": "period_end - 2", "accession": "concat('N', accession)"}),
    50: (f"cik % 13 = 0 AND {_API} AND qtrs = 1 AND quarter(period_end) = 3 AND {_TWO}",
         {"period_end": "period_end + 5", "value": "value * 2", "accession": "concat('D', accession)"}),
    60: ("cik % 4 IN (1, 2) AND qtrs = 0 AND quarter(period_end) = 4 AND year(period_end) < 2000",
         {"filed_date": "filed_date + 365", "accession": "concat(cik, '-', year(period_end) + 1, '-12-31')"}),
}
CTES["a_facts"] = "\nUNION ALL\n".join(
    f"SELECT {', '.join(f'{over[c]} AS {c}' if c in over else c for c in _COLS)}, CAST({seq} AS BIGINT) AS load_seq "
    f"FROM a_fact1 WHERE {where}" for seq, (where, over) in VARIANTS.items())


# ---- listings, tickers and company references from parts ---------------------------------------------------------
CTES["a_listing"] = """
SELECT CASE p_partkey WHEN 7 THEN 'CRWD' WHEN 57 THEN 'NVDA' WHEN 107 THEN 'TSLA' ELSE concat('P', p_partkey) END AS ticker,
       CASE p_partkey % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'Q' WHEN 2 THEN 'A' ELSE 'P' END AS exchange,
       concat(p_name, CASE p_size % 6 WHEN 0 THEN ' - Common Stock' WHEN 1 THEN ' - Class A Ordinary Shares'
                                      WHEN 2 THEN ' - Warrant' WHEN 3 THEN ' - Preferred Series A'
                                      WHEN 4 THEN ' - Series B - Common Stock' ELSE '' END) AS security_name,
       p_partkey % 11 = 0 AS is_etf, p_partkey % 13 = 0 AS is_test_issue,
       CASE p_partkey % 9 WHEN 0 THEN 'D' WHEN 1 THEN 'E' WHEN 2 THEN 'Q' WHEN 3 THEN 'N' END AS financial_status,
       CASE WHEN p_partkey % 10 = 9 THEN NULL ELSE CAST(100 AS DOUBLE) END AS round_lot, p_partkey
FROM part"""

CTES["a_ticker"] = """
SELECT CAST(p_partkey AS BIGINT) AS cik,
       CASE p_partkey WHEN 7 THEN 'crwd' WHEN 57 THEN 'nvda' WHEN 107 THEN 'tsla' ELSE concat('p', p_partkey) END AS ticker,
       p_name AS title
FROM part"""

CTES["a_reference"] = """
SELECT CAST(p_partkey AS BIGINT) AS cik, CASE WHEN p_partkey % 6 = 4 THEN '' ELSE upper(p_name) END AS name,
       CASE p_partkey % 13 WHEN 0 THEN '3674' WHEN 1 THEN '7372' WHEN 2 THEN '2836' WHEN 3 THEN '7370' WHEN 4 THEN '3577'
            WHEN 5 THEN '6770' WHEN 6 THEN '1234' WHEN 7 THEN '2890' WHEN 8 THEN '3679' WHEN 9 THEN '4900'
            WHEN 10 THEN '3825' WHEN 11 THEN '3100' ELSE NULL END AS sic,
       CASE p_size % 5 WHEN 0 THEN 'Special Machinery, NEC' WHEN 1 THEN 'Misc Metal Ores' WHEN 2 THEN 'Data Processing, Etc.'
            WHEN 3 THEN 'Connections' ELSE NULL END AS sic_description,
       CASE p_partkey % 14 WHEN 3 THEN 'investment' WHEN 8 THEN NULL ELSE 'operating' END AS entity_type
FROM part"""

CTES["a_quotes"] = """
SELECT user_id AS cik, event_id, ts, CAST(ts AS DATE) AS date, value AS price, event_type, props FROM events"""

_NAME = re.compile(r"\b[ao]_\w+\b")


def expand(sql: str, registry: dict[str, str]) -> str:
    """Put the named mappings a statement uses in front of it as WITH clauses, in dependency order."""
    order: list[str] = []
    open_: set[str] = set()

    def visit(text):
        for name in dict.fromkeys(_NAME.findall(text)):
            if name in registry and name not in order and name not in open_:
                open_.add(name)
                visit(registry[name])
                order.append(name)

    visit(sql)
    recursive = "RECURSIVE " if any(re.search(rf"FROM {n}\b", registry[n]) for n in order) else ""
    return sql if not order else f"WITH {recursive}" + ",\n".join(f"{n} AS ({registry[n]})" for n in order) + "\n" + sql


class Tables:
    """The mapped tables of one data directory as DataFrames, for example ``Tables(spark, dir).a_facts``."""

    BASE = ("region", "nation", "supplier", "part", "lineitem", "events")

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._full = spark, None
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        for name in self.BASE:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)

    def sql(self, text: str) -> DataFrame:
        """The statement on the mapped tables. What it reads of the quarters of all companies comes from one materialised frame, so the line items
        are read and grouped once, however many tables are built from them."""
        whole = expand(text, CTES)
        if "a_full AS (" not in whole:
            return self.spark.sql(whole)
        if self._full is None:
            self._full = cut(self.spark.sql(expand("SELECT * FROM a_full", CTES)))
        self._full.createOrReplaceTempView("a_full")
        return self.spark.sql(expand(text, {name: body for name, body in CTES.items() if name != "a_full"}))

    @property
    def a_facts(self) -> DataFrame:
        """The fact log in one pass over the base facts: each fact fans out to the filings that carry it."""
        seqs = ", ".join(f"CASE WHEN {where} THEN CAST({seq} AS BIGINT) END" for seq, (where, _) in VARIANTS.items())
        fanned = self.a_fact1.selectExpr("*", f"explode(array_compact(array({seqs}))) AS load_seq")

        def pick(c):
            cases = " ".join(f"WHEN {seq} THEN {over[c]}" for seq, (_, over) in VARIANTS.items() if c in over)
            return f"CASE load_seq {cases} ELSE {c} END AS {c}" if cases else c

        return fanned.selectExpr(*[pick(c) for c in _COLS], "load_seq")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in CTES:
            raise AttributeError(name)
        return self.sql(f"SELECT * FROM {name}")
