"""Measures of a company from its newest-first period arrays ``ttm``, ``q`` and ``a``."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarterdeck.config import SCORING
from quarterdeck.functions.scalars import cagr, ratio, slope_of, total, yoy
from quarterdeck.operators.periods import field, trailing

TAX, WACC, MIN_INVESTED = SCORING["tax_rate"], SCORING["wacc"], SCORING["min_invested_capital_ratio"]


def ttm(name: str, i: int = 0) -> Column:
    return field("ttm", i, name)


def revenue_growth() -> Column:
    """M1."""
    return yoy(ttm("revenue"), ttm("revenue", 4))


def revenue_cagr() -> Column:
    """M2."""
    return cagr(ttm("revenue"), ttm("revenue", 12), 3)


def acceleration() -> Column:
    """M3."""
    g = [yoy(field("q", i, "revenue"), field("q", i + 4, "revenue")) for i in range(4)]
    return F.when(F.size("q") >= 8, (g[0] + g[1]) / 2 - (g[2] + g[3]) / 2)


def margin(p: Column, name: str) -> Column:
    """M4."""
    return ratio(p[name], p["revenue"])


def gross_margins(n: int = SCORING["gross_margin"]["trend_quarters"]) -> Column:
    """Gross margins of the newest n quarters that have one, oldest first."""
    return trailing("q", n, lambda p: margin(p, "gross_profit"))


def gross_margin_trend(series, n: int = SCORING["gross_margin"]["trend_quarters"]) -> Column:
    """M5: basis points a year."""
    return F.when(F.size(series) >= n, slope_of(F.col(series)) * 4 * 10000)


def invested(p: Column) -> Column:
    return p["total_debt"] + p["equity"] - p["cash"]


def invested_ratio(p: Column) -> Column:
    """M6."""
    gross = F.abs(p["total_debt"]) + F.abs(p["equity"]) + F.abs(p["cash"])
    return F.when(gross > 0, invested(p) / gross)


def roic(p: Column) -> Column:
    """M7."""
    return F.when((invested(p) > 0) & (invested_ratio(p) >= MIN_INVESTED), p["operating_income"] * (1 - TAX) / invested(p))


def roic_gap(p: Column) -> Column:
    """M8: why there is no return on capital."""
    return (F.when((p["operating_income"] + invested(p)).isNull(), "MISSING_FIELDS")
            .when(invested(p) <= 0, "NON_POSITIVE_INVESTED_CAPITAL")
            .when(invested_ratio(p).isNull() | (invested_ratio(p) < MIN_INVESTED), "IMMATERIAL_INVESTED_CAPITAL"))


def roic_verdict(p: Column) -> Column:
    """M9: (kind, spread, clears, gap). An operating loss misses the cost of capital whatever the denominator."""
    gap = roic_gap(p)
    undefined = F.coalesce(gap.isin("MISSING_FIELDS", "NON_POSITIVE_INVESTED_CAPITAL"), F.lit(False))
    loss = p["operating_income"] <= 0
    kind = F.when(undefined, "UNDEFINED").when(loss, "DETERMINATE_MISS").when(gap.isNotNull(), "UNDEFINED").otherwise("MEASURED")
    spread = F.when(kind == "MEASURED", p["operating_income"] * (1 - TAX) / invested(p) - WACC)
    return F.struct(kind.alias("kind"), spread.alias("spread"), F.coalesce(spread > 0, F.lit(False)).alias("clears"),
                    F.when(kind == "UNDEFINED", gap).alias("gap"))


def cash_runway() -> Column:
    """Quarters."""
    return F.when(ttm("fcf") < 0, ttm("cash") / (-ttm("fcf") / 4))


def net_cash_share() -> Column:
    """M11."""
    return F.when(F.col("market_cap") > 0, (ttm("cash") - ttm("total_debt")) / F.col("market_cap"))


def leverage() -> Column:
    """M12."""
    return F.when(ttm("operating_income") > 0, ttm("total_debt") / ttm("operating_income"))


def opex_growth() -> Column:
    """M13."""
    opex = lambda i: ttm("gross_profit", i) - ttm("operating_income", i)
    return yoy(opex(0), opex(4))


def choose_shares(reported, diluted) -> tuple[Column, Column]:
    """(shares, basis)."""
    r, d = F.col(reported), F.col(diluted)
    return F.coalesce(r, d), F.when(r.isNotNull(), "reported").when(d.isNotNull(), "diluted_fallback")


def revenue_sum(start: int, n: int = 4) -> Column:
    return total([field("q", i, "revenue") for i in range(start, start + n)])


MEASURES = {
    "m_growth": revenue_growth, "m_cagr": revenue_cagr, "m_accel": acceleration,
    "m_gross_margin": lambda: margin(F.get("ttm", F.lit(0)), "gross_profit"),
    "m_operating_margin": lambda: margin(F.get("ttm", F.lit(0)), "operating_income"),
    "m_fcf_margin": lambda: margin(F.get("ttm", F.lit(0)), "fcf"),
    "m_trend": lambda: gross_margin_trend("gm_series"), "m_roic": lambda: roic(F.get("ttm", F.lit(0))),
    "m_runway": cash_runway, "m_net_cash": net_cash_share, "m_leverage": leverage, "m_opex_growth": opex_growth,
}


def measured(snapshot: DataFrame) -> DataFrame:
    """Adds all measures. Series come first, so that later rules read a column and the plan stays small."""
    return snapshot.withColumn("gm_series", gross_margins()).withColumns({name: make() for name, make in MEASURES.items()})
