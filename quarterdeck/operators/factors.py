"""Score factors and total.

A factor is a rule giving (points, raw) from snapshot columns; FACTORS lists them by key. Each becomes a struct
(key, weight, points, raw, status, detail).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarterdeck.config import SCORING
from quarterdeck.functions.metrics import revenue_sum, ttm
from quarterdeck.functions.scalars import array_sum, band, curve, mean_of, null, ratio, stdev_of
from quarterdeck.operators.quality import has

C = F.col


def _scored(key: str, normalized, raw) -> tuple[Column, Column]:
    return F.lit(float(SCORING[key]["weight"])) * normalized, raw


def damping(*revenues) -> Column:
    """G1: the strongest cut among the given revenues; unknown ones do not count."""
    worst = F.least(*[curve(r, SCORING["damping_curve"]) for r in revenues])
    return F.least(F.coalesce(worst, F.lit(1.0)), F.lit(1.0))


def parts() -> list[dict[str, Column]]:
    """Intermediate columns of the factors, in stages: each is computed once and read by name afterwards."""
    growth, tam = SCORING["revenue_growth"], SCORING["tam_industry_growth"]
    comparable = C("candidate_count") >= SCORING["min_industry_candidates"]
    series, n = C("gm_series"), SCORING["competitive_advantage"]["stability_quarters"]
    mean = F.try_divide(array_sum(series), F.size(series))
    prior = ratio(ttm("operating_income", 4), ttm("revenue", 4))
    return [
        {"p_now": ttm("revenue"), "p_year": ttm("revenue", 4), "p_three": ttm("revenue", 12), "p_sum": revenue_sum(0), "p_sum_year": revenue_sum(4),
         "p_tam": F.coalesce("tam_cagr", F.when(comparable, C("median_revenue_growth"))),
         "p_reach": F.when(C("tam_usd") > 0, ttm("revenue") / C("tam_usd")),
         "p_delta": (C("m_operating_margin") - prior) * 100, "p_gap": C("m_growth") - C("m_opex_growth"),
         "p_stable": F.when(F.size(series) == n, F.when(mean > 0, 1 - stdev_of(series) / mean)),
         "p_rd": ratio(ttm("rd_expense"), ttm("revenue")),
         "p_observed": observed_revenue(SCORING["market_cap_opportunity"]["revenue_fallback_periods"])},
        {"p_cut": damping("p_year", "p_now"), "p_cut_three": damping("p_three", "p_now"), "p_cut_sum": damping("p_sum_year", "p_sum"),
         "p_tam_score": curve("p_tam", tam["cagr_curve"]), "p_reach_score": curve("p_reach", tam["penetration_curve"]),
         "p_yoy": curve("m_growth", growth["curve"]), "p_cagr": curve("m_cagr", growth["curve"]),
         "p_level": curve("m_gross_margin", SCORING["gross_margin"]["level_curve"]),
         "p_trend": curve("m_trend", SCORING["gross_margin"]["trend_curve"]),
         "p_delta_score": curve("p_delta", SCORING["operating_leverage"]["margin_delta_curve"]),
         "p_gap_score": curve("p_gap", SCORING["operating_leverage"]["growth_gap_curve"]),
         "p_cash": curve("m_net_cash", SCORING["balance_sheet"]["net_cash_curve"]),
         "p_lev": curve("m_leverage", SCORING["balance_sheet"]["leverage_curve"]),
         **{f"s_{i}": s for i, s in enumerate(advantage_signals())}},
    ]


def revenue_growth() -> tuple[Column, Column]:
    """G2."""
    f = SCORING["revenue_growth"]["blend"]
    yoy_part, cagr_part = C("p_yoy") * C("p_cut"), C("p_cagr") * C("p_cut_three")
    both = f["ttm_yoy"] * yoy_part + f["cagr_3y"] * cagr_part
    return _scored("revenue_growth", F.coalesce(both, yoy_part, cagr_part), F.coalesce("m_growth", "m_cagr"))


def revenue_acceleration() -> tuple[Column, Column]:
    """G3."""
    return _scored("revenue_acceleration", curve("m_accel", SCORING["revenue_acceleration"]["curve"]) * C("p_cut_sum"), C("m_accel"))


def tam_growth() -> tuple[Column, Column]:
    """G4."""
    f = SCORING["tam_industry_growth"]["blend"]
    blended = f["tam_cagr"] * C("p_tam_score") + f["penetration"] * C("p_reach_score")
    return _scored("tam_industry_growth", F.coalesce(blended, C("p_tam_score")), C("p_tam"))


def gross_margin() -> tuple[Column, Column]:
    """G5."""
    f = SCORING["gross_margin"]["blend"]
    return _scored("gross_margin", F.coalesce(f["level"] * C("p_level") + f["trend"] * C("p_trend"), C("p_level")), C("m_gross_margin"))


def operating_leverage() -> tuple[Column, Column]:
    """G6."""
    f = SCORING["operating_leverage"]["blend"]
    d, g = C("p_delta_score"), C("p_gap_score")
    blended = f["margin_delta"] * d + f["growth_gap"] * g
    return _scored("operating_leverage", F.coalesce(blended, d, g) * C("p_cut"), F.coalesce("p_delta", "p_gap"))


def observed_revenue(n: int) -> Column:
    """Newest revenue: this year's, else the first known of the last n trailing or annual periods."""
    first = lambda arr: F.get(F.filter(F.transform(F.slice(arr, 1, n), lambda p: p["revenue"]), lambda v: v.isNotNull()), F.lit(0))
    return F.coalesce(ttm("revenue"), first("ttm"), first("a"))


def market_cap_opportunity() -> tuple[Column, Column]:
    """Points of the size band, cut by a gate; a shrinking or tiny business gets none."""
    f = SCORING["market_cap_opportunity"]
    gate = (F.when(C("m_growth") < f["zero_if_revenue_growth_below"], 0.0).when(C("p_observed") < f["zero_if_revenue_below"], 0.0)
            .when(has("WARNING"), f["warning_multiplier"]).otherwise(1.0))
    known = (C("market_cap") > 0) & C("p_observed").isNotNull()
    return F.when(known, band("market_cap", f["bands"]) * gate), C("market_cap")


def industry_comparable() -> Column:
    return C("median_gross_margin").isNotNull() & (C("candidate_count") >= SCORING["min_industry_candidates"])


def advantage_signals() -> list[Column]:
    f = SCORING["competitive_advantage"]
    return [curve(C("m_roic") - SCORING["wacc"], f["roic_spread"]), curve("p_stable", f["gm_stability"]),
            curve(F.when(industry_comparable(), C("m_gross_margin") - C("median_gross_margin")), f["gm_vs_industry"]),
            curve("p_rd", f["rd_intensity"])]


def competitive_advantage() -> tuple[Column, Column]:
    """The raw value is the normalised score itself."""
    f = SCORING["competitive_advantage"]
    mean, n = mean_of([C(f"s_{i}") for i in range(4)])
    applicable = F.when(F.coalesce(industry_comparable(), F.lit(False)), 4).otherwise(3)
    value = F.when(n >= f["min_signals"], mean * curve(n / applicable, f["coverage_curve"]))
    return _scored("competitive_advantage", value, C("pt_competitive_advantage") / f["weight"])


def balance_sheet() -> tuple[Column, Column]:
    """Coverage counts by weight, so leaving a figure out never pays."""
    f = SCORING["balance_sheet"]
    w_cash, w_lev = f["blend"]["net_cash"], f["blend"]["leverage"]
    cash, lev = C("p_cash"), C("p_lev")
    present = F.when(cash.isNotNull(), w_cash).otherwise(0.0) + F.when(lev.isNotNull(), w_lev).otherwise(0.0)
    applicable = F.when(C("market_cap") > 0, w_cash + w_lev).otherwise(w_lev)
    mean = F.when(present > 0, (F.coalesce(w_cash * cash, F.lit(0.0)) + F.coalesce(w_lev * lev, F.lit(0.0))) / present)
    value = F.when(C("m_runway").isNotNull(), curve("m_runway", f["runway_curve"])).otherwise(mean * curve(present / applicable, f["coverage_curve"]))
    return _scored("balance_sheet", value, F.coalesce("m_runway", "m_net_cash", "m_leverage"))


# key -> rule giving (points, raw); None is declared but not implemented
FACTORS = {
    "revenue_growth": revenue_growth, "revenue_acceleration": revenue_acceleration, "tam_industry_growth": tam_growth,
    "gross_margin": gross_margin, "operating_leverage": operating_leverage, "market_cap_opportunity": market_cap_opportunity,
    "competitive_advantage": competitive_advantage, "balance_sheet": balance_sheet, "institutional_insider": None,
}


def _struct(key: str, implemented: bool) -> Column:
    points, raw = C(f"pt_{key}"), C(f"raw_{key}")
    status = F.when(points.isNull(), "NO_DATA").otherwise("SCORED") if implemented else F.lit("NOT_IMPLEMENTED")
    detail = F.when(points.isNotNull(), F.coalesce(F.format_string(f"{key} %.4f", raw), F.lit(key)))
    return F.struct(F.lit(key).alias("key"), F.lit(SCORING[key]["weight"]).alias("weight"), points.alias("points"),
                    F.when(points.isNotNull(), raw).alias("raw"), status.alias("status"), detail.alias("detail"))


def with_parts(measured: DataFrame) -> DataFrame:
    for stage in parts():
        measured = measured.withColumns(stage)
    return measured


def with_factors(measured: DataFrame, factors=FACTORS) -> DataFrame:
    """Adds ``factors`` to a snapshot that has measures, flags and industry statistics."""
    rules = {k: rule() if rule else (null(), null()) for k, rule in factors.items()}
    df = with_parts(measured).withColumns({f"pt_{k}": points for k, (points, _) in rules.items()})
    df = df.withColumns({f"raw_{k}": raw for k, (_, raw) in rules.items()})
    df = df.withColumn("factors", F.array(*[_struct(k, factors[k] is not None) for k in factors]))
    return df.drop(*[c for c in df.columns if c.startswith(("p_", "s_", "pt_", "raw_"))])


def with_total(df: DataFrame) -> DataFrame:
    """Adds ``score`` (0-100 over what could be scored) and ``completeness``."""
    sums = F.aggregate("factors", F.struct(F.lit(0.0).alias("points"), F.lit(0).alias("scored"), F.lit(0).alias("known")), lambda acc, f: F.struct(
        (acc["points"] + F.when(f["status"] == "SCORED", f["points"]).otherwise(0.0)).alias("points"),
        (acc["scored"] + F.when(f["status"] == "SCORED", f["weight"]).otherwise(0)).alias("scored"),
        (acc["known"] + F.when(f["status"] != "NOT_IMPLEMENTED", f["weight"]).otherwise(0)).alias("known")))
    df = df.withColumn("_sums", sums)
    return df.withColumns({"score": F.when(C("_sums.scored") > 0, 100 * C("_sums.points") / C("_sums.scored")),
                           "completeness": F.when(C("_sums.known") > 0, C("_sums.scored") / C("_sums.known")).otherwise(0.0)}).drop("_sums")


def factor_rows(scored: DataFrame) -> DataFrame:
    return scored.select("cik", "industry_slug", F.explode("factors").alias("f")).select(
        "cik", "industry_slug", F.col("f.key").alias("factor_key"), "f.weight", "f.points", "f.raw", "f.status", "f.detail")


def one_factor(flagged: DataFrame, key: str) -> DataFrame:
    """A single factor per company; nothing the other factors need is computed."""
    return with_factors(flagged, {key: FACTORS[key]}).select("cik", F.get("factors", F.lit(0)).alias("f")).select("cik", "f.*")
