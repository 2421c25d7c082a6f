"""Scores and valuations of all companies at one date (entry point of the scoring run)."""
from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, functions as F

from quarterdeck import config
from quarterdeck.operators import factors, peers, quality, valuation
from quarterdeck.operators.checkpoint import cut


def config_hash(*blocks) -> str:
    return hashlib.sha256(json.dumps(blocks, sort_keys=True).encode()).hexdigest()[:8]


def engine_versions() -> tuple[str, str]:
    """K8: rule version plus a hash of the settings those rules read."""
    s = config.SCORING
    return (f"{config.RULE_VERSION}+{config_hash(s, config.CLASSIFICATION, config.QUALITY)}",
            f"{config.VALUATION_RULE_VERSION}+" + config_hash(config.VALUATION, s["wacc"], s["tax_rate"], s["min_invested_capital_ratio"],
                                                              s["revenue_growth"]["blend"], s["balance_sheet"]["leverage_curve"]))


def evaluate(snapshot: DataFrame, stage=cut) -> DataFrame:
    """Flags, factors, total, category and valuation next to each snapshot row. ``stage`` materialises what several
    outputs read; it also keeps each plan small."""
    scored = factors.with_total(factors.with_factors(quality.with_flags(stage(snapshot))))
    return stage(valuation.with_valuation(peers.classify(stage(scored))))


def outputs(evaluated: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """K8, K9: the four result tables of a run."""
    day = F.lit(as_of).cast("date").alias("as_of")
    version, v_version = engine_versions()
    rows = factors.factor_rows(evaluated)
    ranks = peers.factor_percentiles(evaluated, rows, config.SCORING["min_industry_candidates"])
    ok = F.col("fair_value_status") == "OK"
    return {
        "scores": evaluated.select("cik", day, "score", "completeness", "category", F.lit(version).alias("engine_version")),
        "score_factors": rows.join(ranks, ["cik", "factor_key"], "left").select(
            "cik", day, "factor_key", "raw", "points", "weight", "status", "percentile", "detail"),
        "red_flags": quality.flag_rows(evaluated).select("cik", day, "code", "severity", "evidence"),
        "valuations": evaluated.select(
            "cik", day, "fair_value_status", "fair_value_reason", F.when(ok, F.col("per_share")).alias("fair_value_per_share"),
            "assumptions", "price_status", "price_ratio", "margin_of_safety", "valuation_status", "moat_signal",
            "moat_periods_evaluated", "moat_periods_clearing", "moat_reason", "moat_evidence", "uncertainty_level",
            "uncertainty_score", "uncertainty_drivers", F.lit(v_version).alias("engine_version")),
    }


def summary(evaluated: DataFrame) -> DataFrame:
    """G13."""
    return evaluated.agg(F.count(F.lit(1)).alias("scored"), F.count_if(quality.has("CRITICAL")).alias("red_flagged"),
                         F.count_if(F.col("completeness") < config.SCORING["min_completeness"]).alias("insufficient"),
                         F.count_if(F.col("fair_value_status") == "OK").alias("fair_valued"))
