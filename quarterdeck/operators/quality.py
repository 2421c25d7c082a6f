"""Red flags (Q1-Q9) of a measured snapshot, as an array of (code, severity, evidence)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarterdeck.config import QUALITY
from quarterdeck.functions.metrics import margin, ttm
from quarterdeck.functions.scalars import ratio, yoy
from quarterdeck.operators.periods import declining, field


def _flag(when, code: str, severity: str, **evidence) -> Column:
    pairs = [x for k, v in evidence.items() for x in (F.lit(k), v.cast("double"))]
    return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"),
                                 F.create_map(*pairs).alias("evidence")))


def flag_columns(cfg=QUALITY) -> dict[str, Column]:
    years = cfg["revenue_decline_years"]
    runway, lev = F.col("m_runway"), F.col("m_leverage")
    dilution = yoy(ttm("shares_diluted"), ttm("shares_diluted", 4))
    now, prior = F.col("m_gross_margin"), margin(F.get("ttm", F.lit(4)), "gross_profit")
    drop = (prior - now) * 10000
    sbc = ratio(ttm("sbc"), ttm("revenue"))
    critical, low = cfg["runway_critical_quarters"], cfg["runway_low_quarters"]
    extreme, warn = cfg["extreme_dilution"], cfg["dilution_warning"]
    return {
        "Q1": _flag(declining("a", years), "REVENUE_DECLINE_2Y", "CRITICAL", latest=field("a", 0, "revenue"), oldest=field("a", years, "revenue")),
        "Q2": _flag((ttm("equity") < 0) & (ttm("fcf") < 0), "NEGATIVE_EQUITY_BURN", "CRITICAL", equity=ttm("equity"), fcf=ttm("fcf")),
        "Q3": _flag(runway < critical, "RUNWAY_CRITICAL", "CRITICAL", quarters=runway),
        "Q4": _flag((runway >= critical) & (runway < low), "RUNWAY_LOW", "WARNING", quarters=runway),
        "Q5": _flag(dilution > extreme, "EXTREME_DILUTION", "CRITICAL", ratio=dilution),
        "Q6": _flag((dilution <= extreme) & (dilution > warn), "DILUTION", "WARNING", ratio=dilution),
        "Q7": _flag(drop > cfg["gm_collapse_bps"], "GM_COLLAPSE", "WARNING", now=now, prior=prior, drop_bps=drop),
        "Q8": _flag(sbc > cfg["sbc_of_revenue"], "SBC_EXCESSIVE", "WARNING", ratio=sbc),
        "Q9": _flag(lev > cfg["debt_to_ebitda"], "LEVERAGE_HIGH", "WARNING", ratio=lev),
    }


def with_flags(snapshot: DataFrame) -> DataFrame:
    return snapshot.withColumn("flags", F.array_compact(F.array(*flag_columns().values())))


def has(severity: str) -> Column:
    return F.exists("flags", lambda f: f["severity"] == severity)


def flag_rows(flagged: DataFrame) -> DataFrame:
    return flagged.select("cik", F.explode("flags").alias("f")).select("cik", "f.code", "f.severity", "f.evidence")
