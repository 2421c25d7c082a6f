"""Discounted cash-flow value, price against it, persistence of returns, uncertainty."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarterdeck.config import COMPLETENESS_FIELDS, SCORING, VALUATION
from quarterdeck.functions.metrics import roic_verdict, ttm
from quarterdeck.functions.scalars import array_sum, curve, mean_of, median_of, null, ratio, stdev_of, total, yoy

C = F.col
TAX, WACC, G_END = SCORING["tax_rate"], SCORING["wacc"], VALUATION["terminal_growth_rate"]
YEARS = range(1, VALUATION["projection_years"] + 1)


def _fade(year: int) -> float:
    """Weight of the first-year estimate that is left in a projected year."""
    points = VALUATION["fade_curve"]
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        if year <= x1:
            return y0 + (year - x0) / (x1 - x0) * (y1 - y0)
    return points[-1][1]


def _observed(array, n: int, value) -> Column:
    return F.filter(F.transform(F.slice(array, 1, n), value), lambda v: v.isNotNull())


def with_inputs(df: DataFrame) -> DataFrame:
    """V1, V3-V5: growth and margin the projection starts from, and the margin it converges to."""
    blend, cfg = SCORING["revenue_growth"]["blend"], VALUATION["mature_margin"]
    on_fcf = F.coalesce(C("m_fcf_margin") > 0, F.lit(False))
    both = C("m_growth").isNotNull() & C("m_cagr").isNotNull()
    df = df.withColumns({
        "v_growth": F.coalesce(blend["ttm_yoy"] * C("m_growth") + blend["cagr_3y"] * C("m_cagr"), C("m_growth"), C("m_cagr")),
        "v_growth_source": F.when(both, "blend").when(C("m_growth").isNotNull(), "ttm_yoy_only").when(C("m_cagr").isNotNull(), "cagr_3y_only"),
        "v_margin": F.when(on_fcf, C("m_fcf_margin")).otherwise(C("m_operating_margin") * (1 - TAX)),
        "v_margin_source": F.when(on_fcf, "fcf").otherwise("nopat_proxy"),
        "v_shares": F.when(ttm("shares_diluted") > 0, ttm("shares_diluted")).when(C("shares_outstanding") > 0, C("shares_outstanding")),
        "v_shares_source": F.when(ttm("shares_diluted") > 0, "diluted").when(C("shares_outstanding") > 0, "outstanding"),
        "v_net_cash": ttm("cash") - ttm("total_debt"),
        "_seen": F.when(on_fcf, _observed("a", cfg["lookback_periods"], lambda p: ratio(p["fcf"], p["revenue"])))
                  .otherwise(_observed("a", cfg["lookback_periods"], lambda p: ratio(p["operating_income"], p["revenue"]) * (1 - TAX))),
    })
    df = df.withColumn("v_mature", median_of(C("_seen"))).withColumn("v_periods", F.size("_seen"))
    away = F.transform("_seen", lambda x: F.abs(x - C("v_mature")))
    df = df.withColumn("v_dispersion", F.when(C("v_mature") > 0, median_of(away) / C("v_mature"))).drop("_seen")
    growth = [F.lit(G_END) + F.lit(_fade(y)) * (C("v_growth") - F.lit(G_END)) for y in YEARS]
    multiples = []
    for g in growth:
        multiples.append((multiples[-1] if multiples else F.lit(1.0)) * (1 + g))
    return df.withColumns({f"v_multiple_{y}": m for y, m in zip(YEARS, multiples)})


def anchored() -> Column:
    cfg = VALUATION["mature_margin"]
    return F.coalesce((C("v_periods") >= cfg["min_periods"]) & (C("v_mature") > 0) & (C("v_dispersion") <= cfg["max_dispersion"]), F.lit(False))


def refusal() -> Column:
    """V2: the first reason there is no value, NULL when there is one."""
    generates = F.coalesce(ttm("fcf") > 0, F.lit(False)) | F.coalesce(ttm("operating_income") > 0, F.lit(False))
    return (F.when(F.coalesce(ttm("revenue") <= 0, F.lit(True)), "NON_POSITIVE_REVENUE")
            .when(C("v_growth").isNull(), "INSUFFICIENT_REVENUE_HISTORY")
            .when(~generates, "NOT_CASH_GENERATIVE")
            .when(C("v_shares").isNull(), "NO_SHARE_COUNT")
            .when(C("v_net_cash").isNull(), "NO_BALANCE_SHEET_DATA")
            .when(F.lit(WACC <= G_END), "INVALID_ASSUMPTIONS")
            .when(C(f"v_multiple_{YEARS[-1]}") > VALUATION["max_implied_revenue_multiple"], "GROWTH_NOT_PROJECTABLE")
            .when(~anchored(), "MARGIN_NOT_ANCHORABLE"))


def with_fair_value(df: DataFrame) -> DataFrame:
    """V2, V6, V7: adds fair_value_status, fair_value_reason, enterprise_value, equity_value, per_share, assumptions."""
    df = with_inputs(df).withColumn("fair_value_reason", refusal())
    flows = [ttm("revenue") * C(f"v_multiple_{y}") * (C("v_mature") + F.lit(_fade(y)) * (C("v_margin") - C("v_mature"))) for y in YEARS]
    present = total([flow / F.lit((1 + WACC) ** y) for y, flow in zip(YEARS, flows)])
    terminal = flows[-1] * (1 + G_END) / F.lit(WACC - G_END) / F.lit((1 + WACC) ** YEARS[-1])
    ok = C("fair_value_reason").isNull()
    df = df.withColumn("enterprise_value", F.when(ok, present + terminal))
    df = df.withColumn("equity_value", C("enterprise_value") + C("v_net_cash"))
    assumed = F.struct(
        F.lit(len(YEARS)).alias("projection_years"), F.lit(WACC).alias("discount_rate"), F.lit(G_END).alias("terminal_growth_rate"),
        C("v_growth").alias("initial_growth_rate"), C("v_growth_source").alias("initial_growth_source"),
        C("v_mature").alias("mature_fcf_margin"), C("v_periods").alias("mature_margin_periods"),
        C("v_dispersion").alias("mature_margin_dispersion"), C("v_margin").alias("initial_fcf_margin"),
        C("v_margin_source").alias("initial_margin_source"), C(f"v_multiple_{YEARS[-1]}").alias("implied_revenue_multiple"),
        F.lit(TAX).alias("tax_rate"), C("v_net_cash").alias("net_cash"), C("v_shares").alias("shares"),
        C("v_shares_source").alias("shares_source"))
    return df.withColumns({"per_share": C("equity_value") / C("v_shares"),
                           "fair_value_status": F.when(ok, "OK").otherwise("INSUFFICIENT_DATA"),
                           "assumptions": F.when(ok, assumed)})


def with_price_status(df: DataFrame) -> DataFrame:
    """V8."""
    usable = F.coalesce((C("fair_value_status") == "OK") & (C("per_share") > 0) & (C("price") > 0), F.lit(False))
    df = df.withColumns({"price_status": F.when(usable, "OK").otherwise("UNAVAILABLE"),
                         "price_ratio": F.when(usable, C("price") / C("per_share")),
                         "margin_of_safety": F.when(usable, (C("per_share") - C("price")) / C("per_share"))})
    return df.withColumn("valuation_status", F.when(C("price_ratio") <= VALUATION["undervalued_max_ratio"], "UNDERVALUED")
                         .when(C("price_ratio") >= VALUATION["overvalued_min_ratio"], "OVERVALUED")
                         .when(C("price_ratio").isNotNull(), "FAIRLY_VALUED"))


def with_moat(df: DataFrame) -> DataFrame:
    """Persistence of returns above the cost of capital over the newest annual periods."""
    cfg = VALUATION["moat"]
    need = cfg["min_periods"]
    df = df.withColumn("_v", F.transform(F.slice("a", 1, cfg["lookback_periods"]), roic_verdict))
    count = lambda cond: F.size(F.filter("_v", cond))
    df = df.withColumns({"_seen": count(lambda v: v["kind"] != "UNDEFINED"), "_clear": count(lambda v: v["clears"]),
                         "_missing": count(lambda v: v["gap"] == "MISSING_FIELDS"),
                         "_na": count(lambda v: v["gap"].isin("NON_POSITIVE_INVESTED_CAPITAL", "IMMATERIAL_INVESTED_CAPITAL"))})
    thin = C("_seen") < need
    share = F.try_divide(C("_clear"), C("_seen"))
    reason = (F.when(F.size("a") < need, "TOO_FEW_PERIODS")
              .when((C("_na") == 0) | (C("_seen") + C("_missing") >= need), "MISSING_FINANCIALS").otherwise("NOT_APPLICABLE"))
    over = F.transform(F.filter("_v", lambda v: v["clears"]), lambda v: v["spread"])
    return df.withColumns({
        "moat_signal": F.when(thin, "INSUFFICIENT_DATA").when(share >= cfg["persistent"], "PERSISTENT")
                        .when(share >= cfg["intermittent"], "INTERMITTENT").otherwise("ABSENT"),
        "moat_periods_evaluated": C("_seen"), "moat_periods_clearing": F.when(thin, 0).otherwise(C("_clear")),
        "moat_reason": F.when(thin, reason),
        "moat_evidence": F.array_compact(F.array(
            F.format_string("evaluated %d", C("_seen")), F.when(~thin, F.format_string("clearing %d", C("_clear"))),
            F.when(~thin & (C("_clear") > 0), F.format_string("mean spread %.4f", F.try_divide(array_sum(over), F.size(over)))))),
    }).drop("_v", "_seen", "_clear", "_missing", "_na")


def with_risks(df: DataFrame) -> DataFrame:
    """Adds ``risk_<driver>``, NULL when the driver cannot be measured."""
    u = VALUATION["uncertainty"]
    n, need = u["lookback_quarters"], u["min_periods"]
    growth = F.array(*[yoy(ttm("revenue", i), ttm("revenue", i + 4)) for i in range(n)])
    df = df.withColumns({"_yoys": F.filter(growth, lambda v: v.isNotNull()),
                         "_margins": _observed("ttm", n, lambda p: ratio(p["operating_income"], p["revenue"])),
                         "_have": total([ttm(f).isNotNull().cast("int") for f in COMPLETENESS_FIELDS]) / len(COMPLETENESS_FIELDS)})
    spread = lambda c: F.when(F.size(c) >= need, stdev_of(C(c)))
    df = df.withColumns({"_yoy_sd": spread("_yoys"), "_margin_sd": spread("_margins")})
    return df.withColumns({
        "risk_revenue_predictability": curve("_yoy_sd", u["revenue_curve"]),
        "risk_operating_leverage": curve("_margin_sd", u["margin_curve"]),
        "risk_financial_leverage": 1 - curve("m_leverage", SCORING["balance_sheet"]["leverage_curve"]),
        "risk_data_completeness": curve("_have", u["completeness_curve"]),
        "risk_business_concentration": null(),
    }).drop("_yoys", "_margins", "_have", "_yoy_sd", "_margin_sd")


DRIVERS = ["revenue_predictability", "operating_leverage", "financial_leverage", "data_completeness", "business_concentration"]


def with_uncertainty(df: DataFrame) -> DataFrame:
    """What could not be measured counts as the highest risk."""
    u = VALUATION["uncertainty"]
    df = with_risks(df)
    mean, n = mean_of([C(f"risk_{k}") for k in DRIVERS])
    df = df.withColumns({"_mean": F.coalesce(mean, F.lit(1.0)), "_covered": n / (len(DRIVERS) - 1)})
    trust = curve("_covered", u["coverage_curve"])
    drivers = F.array(*[F.struct(F.lit(k).alias("key"), F.when(C(f"risk_{k}").isNull(), "UNAVAILABLE").otherwise("MEASURED").alias("status"),
                                 C(f"risk_{k}").alias("risk")) for k in DRIVERS])
    df = df.withColumns({"uncertainty_score": C("_mean") * trust + (1 - trust), "uncertainty_drivers": drivers})
    s, lv = C("uncertainty_score"), u["levels"]
    return df.withColumn("uncertainty_level", F.when(s >= lv["severe"], "SEVERE").when(s >= lv["elevated"], "ELEVATED")
                         .when(s >= lv["moderate"], "MODERATE").otherwise("MINIMAL")).drop("_mean", "_covered", *[f"risk_{k}" for k in DRIVERS])


def with_valuation(measured: DataFrame) -> DataFrame:
    return with_uncertainty(with_moat(with_price_status(with_fair_value(measured))))
