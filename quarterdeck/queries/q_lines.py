"""Statement lines."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarterdeck import tags as tg
from quarterdeck.functions import lineitems as li
from quarterdeck.operators import carry
from quarterdeck.queries.common import ORACLE
from quarterdeck.queries.q_reconcile import carried, flows
from quarterdeck.queries.registry import query

_piv = lambda tags, src="value": ", ".join(f"max({src}) FILTER (tag = '{x}') AS {x}" for x in tags)
ORACLE["o_wide"] = f"SELECT cik, qtrs, period_end, {_piv(tg.FLOW_TAGS)} FROM o_value WHERE qtrs > 0 AND tag IN ({', '.join(repr(x) for x in tg.FLOW_TAGS)}) GROUP BY ALL"
_E, _R, (_I1, _I2) = tg.REVENUE_EXCL_TAX, tg.REVENUES, tg.INDUSTRY_TOTALS
_COST = f"coalesce({tg.COST_CHAIN[0]}, {tg.COST_CHAIN[1]})"
_COSTT = f"CASE WHEN {tg.COST_CHAIN[0]} IS NOT NULL THEN '{tg.COST_CHAIN[0]}' WHEN {tg.COST_CHAIN[1]} IS NOT NULL THEN '{tg.COST_CHAIN[1]}' END"
_CANDS = [_E, _R, _I1, _I2, f"(GrossProfit + {_COST})"]
_CANDT = [f"'{_E}'", f"'{_R}'", f"'{_I1}'", f"'{_I2}'", f"'GrossProfit+' || {_COSTT}"]
_MAX = f"greatest({', '.join(_CANDS)})"
_N = "(" + " + ".join(f"({c} IS NOT NULL)::INT" for c in _CANDS) + ")"
ORACLE["o_revenue"] = f"""
SELECT *, {_COST} AS cost, {_COSTT} AS cost_tag,
  CASE WHEN {_N} > 1 THEN {_MAX} ELSE coalesce({', '.join(tg.REVENUE_CHAIN)}, {_I1}, {_I2}) END AS revenue,
  CASE WHEN {_N} > 1 THEN CASE {' '.join(f'WHEN {c} = {_MAX} THEN {x}' for c, x in zip(_CANDS, _CANDT))} END
       ELSE CASE {' '.join(f"WHEN {x} IS NOT NULL THEN '{x}'" for x in [*tg.REVENUE_CHAIN, _I1, _I2])} END END AS revenue_tag FROM o_wide"""
ORACLE["o_flow"] = f"""
SELECT cik, qtrs, period_end, revenue, revenue_tag, coalesce(GrossProfit, revenue - cost) AS gross_profit,
  CASE WHEN GrossProfit IS NOT NULL THEN 'GrossProfit' WHEN revenue - cost IS NOT NULL THEN revenue_tag || '-' || cost_tag END AS gross_profit_tag,
  coalesce({tg.OPERATING_INCOME}, GrossProfit - OperatingExpenses, revenue - CostsAndExpenses) AS operating_income,
  CASE WHEN {tg.OPERATING_INCOME} IS NOT NULL THEN '{tg.OPERATING_INCOME}' WHEN GrossProfit - OperatingExpenses IS NOT NULL THEN 'GrossProfit-OperatingExpenses'
       WHEN revenue - CostsAndExpenses IS NOT NULL THEN revenue_tag || '-CostsAndExpenses' END AS operating_income_tag,
  {tg.NET_INCOME} AS net_income, coalesce({', '.join(tg.OCF_CHAIN)}) AS ocf,
  CASE WHEN {tg.OCF_CHAIN[0]} IS NOT NULL THEN '{tg.OCF_CHAIN[0]}' WHEN {tg.OCF_CHAIN[1]} IS NOT NULL THEN '{tg.OCF_CHAIN[1]}' END AS ocf_tag,
  coalesce({', '.join(tg.CAPEX_CHAIN)}) AS capex, {tg.SBC} AS sbc, {tg.RD} AS rd_expense, {tg.DILUTED_SHARES} AS shares_diluted,
  {', '.join(f"CASE WHEN {x} IS NOT NULL THEN '{x}' END AS {f}_tag" for f, x in (('net_income', tg.NET_INCOME), ('sbc', tg.SBC), ('rd_expense', tg.RD), ('shares_diluted', tg.DILUTED_SHARES)))},
  CASE WHEN {tg.CAPEX_CHAIN[0]} IS NOT NULL THEN '{tg.CAPEX_CHAIN[0]}' WHEN {tg.CAPEX_CHAIN[1]} IS NOT NULL THEN '{tg.CAPEX_CHAIN[1]}' END AS capex_tag FROM o_revenue"""


def _flow(id_, *columns):
    @query(id_, f"SELECT cik, qtrs, period_end, {', '.join(columns)} FROM o_flow")
    def run(t):
        return flows(t).select("cik", "qtrs", "period_end", *columns)


_flow("L1_revenue", "revenue", "revenue_tag")
_flow("L2_gross_profit", "gross_profit", "gross_profit_tag")
_flow("L3_operating_income", "operating_income", "operating_income_tag")
_flow("L4_single_tag_lines", "net_income", "sbc", "rd_expense", "shares_diluted")


@query("L5_cash_flow_lines", "SELECT cik, qtrs, period_end, ocf, capex, ocf - capex AS fcf FROM o_flow")
def l5(t):
    return flows(t).select("cik", "qtrs", "period_end", "ocf", "capex", (F.col("ocf") - F.col("capex")).alias("fcf"))


# ---- balance sheet ----------------------------------------------------------------------------------------------
_GT = [*tg.DEBT_SHAPES, *tg.CASH_SHAPES]
_AT = [tg.EQUITY, tg.COVER_SHARES, tg.LEASED_SPANNING, tg.LEASED_NONCURRENT, *[x for v in tg.FINANCE_LEASES.values() for x in v], tg.DEBT_CURRENT]
ORACLE["o_usew"] = f"SELECT cik, period_end, {_piv(_GT)} FROM o_use GROUP BY ALL"
ORACLE["o_asw"] = f"""SELECT cik, period_end, {', '.join(f"max(value) FILTER (tag = '{x}') AS z_{x}, max(d) FILTER (tag = '{x}') AS d_{x}" for x in _AT)} FROM o_asof GROUP BY ALL"""
_fam = {}
for _f, (_t, _n, _c) in tg.SPECIFIC_FAMILIES.items():
    co = lambda xs: "NULL::DOUBLE" if not xs else f"coalesce({', '.join(xs)})" if len(xs) > 1 else xs[0]
    _fam[_f] = f"greatest({co(_t)}, CASE WHEN {co(_n)} IS NOT NULL OR {co(_c)} IS NOT NULL THEN coalesce({co(_n)}, 0) + coalesce({co(_c)}, 0) END)"
_short = f"coalesce({', '.join(tg.SHORT_TERM_BORROWINGS)})"


def _lease(anchor, region):
    a, b = tg.FINANCE_LEASES[region]
    ok = lambda x: f"CASE WHEN coalesce(d_{x} = d_{anchor}, true) THEN z_{x} END"
    return f"coalesce({ok(a)}, {ok(b)})"


ORACLE["o_debt0"] = f"""
SELECT p.cik, p.period_end, u.* EXCLUDE (cik, period_end), s.* EXCLUDE (cik, period_end), {', '.join(f'{x} AS fam_{f}' for f, x in _fam.items())}, {_short} AS st,
       z_{tg.LEASED_SPANNING} - coalesce({_lease(tg.LEASED_SPANNING, 'spanning')}, 0) AS sp, z_{tg.LEASED_NONCURRENT} - coalesce({_lease(tg.LEASED_NONCURRENT, 'noncurrent')}, 0) AS nc,
       {_lease(tg.DEBT_CURRENT, 'current')} AS cl
FROM o_probe p LEFT JOIN o_usew u ON u.cik = p.cik AND u.period_end = p.period_end LEFT JOIN o_asw s ON s.cik = p.cik AND s.period_end = p.period_end"""
_fams = [f"fam_{f}" for f in _fam]
_contained = """(coalesce(LongTermDebt = LongTermDebtNoncurrent + st, false) OR (NOT coalesce(LongTermDebt = LongTermDebtNoncurrent + LongTermDebtCurrent, false)
  AND abs(LongTermDebtCurrent - st) <= 0.005::DOUBLE * greatest(abs(LongTermDebtCurrent), abs(st), 1)))"""
ORACLE["o_debt1"] = f"""
SELECT *, CASE WHEN coalesce({', '.join(_fams)}) IS NOT NULL THEN {' + '.join(f'coalesce({x}, 0)' for x in _fams)} END AS spec,
  CASE WHEN LongTermDebtCurrent IS NOT NULL AND st IS NOT NULL THEN CASE WHEN {_contained} THEN greatest(LongTermDebtCurrent, st) ELSE LongTermDebtCurrent + st END ELSE coalesce(LongTermDebtCurrent, st) END AS parts,
  CASE WHEN LongTermDebtCurrent IS NULL THEN 0 WHEN st IS NOT NULL AND {_contained} THEN greatest(LongTermDebtCurrent, st) ELSE LongTermDebtCurrent END AS parts_inside FROM o_debt0"""
ORACLE["o_debt2"] = """
SELECT *, greatest(DebtCurrent, parts) AS cur, CASE WHEN DebtCurrent IS NOT NULL AND coalesce(parts <= DebtCurrent, true) THEN CASE WHEN LongTermDebtCurrent IS NULL THEN 0 ELSE least(LongTermDebtCurrent, DebtCurrent) END ELSE parts_inside END AS inside,
  DebtCurrent IS NOT NULL AND coalesce(parts <= DebtCurrent, true) AS by_rollup FROM o_debt1"""
ORACLE["o_debt"] = """
SELECT *, nullif(CASE WHEN DebtLongtermAndShorttermCombinedAmount IS NOT NULL THEN DebtLongtermAndShorttermCombinedAmount
  WHEN LongTermDebtNoncurrent IS NULL AND LongTermDebt IS NULL AND sp > 0 AND (spec IS NULL OR sp >= spec) THEN sp
  WHEN LongTermDebtNoncurrent IS NULL AND LongTermDebt IS NULL AND nc > 0 AND (spec IS NULL OR nc >= spec) THEN nc + coalesce(CASE WHEN by_rollup AND cl IS NOT NULL THEN greatest(0, cur - cl) ELSE cur END, 0)
  WHEN LongTermDebtNoncurrent IS NOT NULL THEN greatest(coalesce(LongTermDebt, 0), LongTermDebtNoncurrent + coalesce(LongTermDebtCurrent, 0)) + coalesce(greatest(0, cur - inside), 0)
  WHEN LongTermDebt IS NOT NULL THEN greatest(LongTermDebt, spec) + coalesce(cur, 0)
  WHEN LongTermDebtCurrent IS NOT NULL OR DebtCurrent IS NOT NULL THEN greatest(cur, spec)
  WHEN spec IS NOT NULL OR st IS NOT NULL THEN coalesce(spec, 0) + coalesce(st, 0) END, 0) AS total_debt FROM o_debt2"""


# ---- the names behind each amount -------------------------------------------------------------------------------
def _named(xs):
    return "NULL::VARCHAR" if not xs else "CASE " + " ".join(f"WHEN {x} IS NOT NULL THEN '{x}'" for x in xs) + " END"


def _family_name(lists):
    total, *parts = lists
    names = ", ".join(_named(x) for x in parts)
    whole = f"coalesce({', '.join(total)})" if total else "NULL::DOUBLE"
    both = " + ".join(f"coalesce({', '.join([*x, '0'])})" for x in parts)
    return f"CASE WHEN {whole} >= {both} OR coalesce({', '.join([*parts[0], *parts[1]])}) IS NULL THEN {_named(total)} ELSE concat_ws('+', {names}) END"


def _leased_name(anchor, region):
    a, b = tg.FINANCE_LEASES[region]
    ok = lambda x: f"z_{x} IS NOT NULL AND coalesce(d_{x} = d_{anchor}, true)"
    return f"CASE WHEN {ok(a)} THEN '{a}' WHEN {ok(b)} THEN '{b}' END"


def _joined_names(*parts):
    """One '+' list of the names in all parts, each once, in their order."""
    return f"array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split(concat_ws('+', {', '.join(parts)}), '+'), lambda n: [n])), lambda acc, n: CASE WHEN list_contains(acc, n[1]) THEN acc ELSE acc || n END), '+')"


_no_long = "LongTermDebtNoncurrent IS NULL AND LongTermDebt IS NULL"
ORACLE["o_debt3"] = f"""
SELECT *, concat_ws('+', {', '.join(f'CASE WHEN fam_{f} IS NOT NULL THEN {_family_name(x)} END' for f, x in tg.SPECIFIC_FAMILIES.items())}) AS spec_name, {_named(tg.SHORT_TERM_BORROWINGS)} AS st_name,
  {_leased_name(tg.LEASED_SPANNING, 'spanning')} AS sp_lease, {_leased_name(tg.LEASED_NONCURRENT, 'noncurrent')} AS nc_lease, {_leased_name(tg.DEBT_CURRENT, 'current')} AS cl_lease FROM o_debt"""
ORACLE["o_debt4"] = f"""
SELECT *, CASE WHEN by_rollup THEN '{tg.DEBT_CURRENT}' WHEN LongTermDebtCurrent IS NOT NULL AND st IS NOT NULL THEN
    CASE WHEN NOT {_contained} THEN 'LongTermDebtCurrent+' || st_name WHEN LongTermDebtCurrent >= st THEN 'LongTermDebtCurrent' ELSE st_name END
    WHEN LongTermDebtCurrent IS NOT NULL THEN 'LongTermDebtCurrent' WHEN st IS NOT NULL THEN st_name END AS cur_name FROM o_debt3"""
ORACLE["o_debt_name"] = f"""
SELECT cik, period_end, CASE WHEN total_debt IS NULL THEN NULL WHEN {tg.DEBT_COMBINED} IS NOT NULL THEN '{tg.DEBT_COMBINED}'
  WHEN {_no_long} AND sp > 0 AND (spec IS NULL OR sp >= spec) THEN concat_ws('-', '{tg.LEASED_SPANNING}', sp_lease)
  WHEN {_no_long} AND nc > 0 AND (spec IS NULL OR nc >= spec) THEN {_joined_names(f"concat_ws('-', '{tg.LEASED_NONCURRENT}', nc_lease)", "CASE WHEN by_rollup AND cl IS NOT NULL THEN CASE WHEN cur > cl THEN cur_name || '-' || cl_lease END ELSE cur_name END")}
  WHEN LongTermDebtNoncurrent IS NOT NULL THEN {_joined_names("CASE WHEN coalesce(LongTermDebt, 0) > LongTermDebtNoncurrent + coalesce(LongTermDebtCurrent, 0) THEN 'LongTermDebt' WHEN LongTermDebtCurrent IS NOT NULL THEN 'LongTermDebtNoncurrent+LongTermDebtCurrent' ELSE 'LongTermDebtNoncurrent' END", "CASE WHEN cur > inside THEN cur_name END")}
  WHEN LongTermDebt IS NOT NULL THEN {_joined_names("CASE WHEN spec > LongTermDebt THEN spec_name ELSE 'LongTermDebt' END", "cur_name")}
  WHEN LongTermDebtCurrent IS NOT NULL OR DebtCurrent IS NOT NULL THEN CASE WHEN spec > cur THEN spec_name ELSE cur_name END
  ELSE concat_ws('+', nullif(spec_name, ''), st_name) END AS total_debt_tag FROM o_debt4"""


@query("L6_cash", f"SELECT cik, period_end, {tg.CASH} + coalesce({tg.SHORT_TERM_INVESTMENTS}, 0) AS cash FROM o_debt")
def l6(t):
    return carry.stock_lines(carried(t)).select("cik", "period_end", "cash")


@query("L7_equity_and_shares", f"SELECT cik, period_end, z_{tg.EQUITY} AS equity, z_{tg.COVER_SHARES} AS cover_shares FROM o_debt")
def l7(t):
    value = lambda x: F.col(f"{x}.value")
    return carried(t).select("cik", "period_end", value(tg.EQUITY).alias("equity"), value(tg.COVER_SHARES).alias("cover_shares"))


def usable(t):
    rows = carried(t)
    return rows.withColumns({f"u_{x}": carry.usable(x, "debt") for x in tg.DEBT_SHAPES})


def value(x):
    return F.col(f"u_{x}")


@query("L8_product_families", "SELECT cik, period_end, spec AS specific FROM o_debt")
def l8(t):
    return li.specific_families(usable(t), value).select("cik", "period_end", "specific")


@query("L9_current_portion", "SELECT cik, period_end, cur AS current, CASE WHEN cur IS NOT NULL THEN inside::DOUBLE END AS inside FROM o_debt")
def l9(t):
    return li.current_portion(usable(t), value).select("cik", "period_end", "current", F.col("current_inside").alias("inside"))


@query("L10_lease_free_rollups", "SELECT cik, period_end, CASE WHEN sp > 0 THEN sp END AS spanning, CASE WHEN nc > 0 THEN nc END AS noncurrent FROM o_debt")
def l10(t):
    as_of = lambda x: F.col(f"{x}.value.value") if x in tg.DEBT_SHAPES else F.col(f"{x}.value")
    date_of = lambda x: F.col(f"{x}.date")
    return carried(t).select("cik", "period_end", li.lease_free(as_of, date_of, tg.LEASED_SPANNING, "spanning")[0].alias("spanning"),
                             li.lease_free(as_of, date_of, tg.LEASED_NONCURRENT, "noncurrent")[0].alias("noncurrent"))


@query("L11_total_debt", "SELECT cik, period_end, total_debt FROM o_debt")
def l11(t):
    return carry.stock_lines(carried(t)).select("cik", "period_end", "total_debt")
