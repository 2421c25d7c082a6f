"""Industry statistics and leader classification."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from quarterdeck.config import CLASSIFICATION
from quarterdeck.functions.metrics import ttm
from quarterdeck.operators.distribution import median, percentiles
from quarterdeck.operators.pick import first_rows

DISTRIBUTIONS = {"revenue_growth": "m_growth", "revenue_acceleration": "m_accel", "gross_margin": "m_gross_margin",
                 "fcf_margin": "m_fcf_margin", "market_cap": "market_cap", "roic": "m_roic"}
# factor key -> the distribution its raw value is ranked in
PERCENTILE_SOURCE = {"revenue_growth": "revenue_growth", "revenue_acceleration": "revenue_acceleration",
                     "gross_margin": "gross_margin", "market_cap_opportunity": "market_cap"}


def distributions(snapshot: DataFrame) -> DataFrame:
    """Long (industry_slug, key, value) of the six peer measures."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in DISTRIBUTIONS.items()])
    return (snapshot.select("industry_slug", F.explode(pairs).alias("p")).select("industry_slug", "p.key", "p.value")
            .where("value IS NOT NULL"))


def industry_stats(snapshot: DataFrame) -> DataFrame:
    """Members, median gross margin and median growth per industry."""
    counts = snapshot.groupBy("industry_slug").agg(F.count(F.lit(1)).alias("candidate_count"))
    meds = median(distributions(snapshot).where(F.col("key").isin("gross_margin", "revenue_growth")), ["industry_slug", "key"], "value")
    flat = meds.groupBy("industry_slug").agg(
        F.max(F.when(F.col("key") == "gross_margin", F.col("median"))).alias("median_gross_margin"),
        F.max(F.when(F.col("key") == "revenue_growth", F.col("median"))).alias("median_revenue_growth"))
    return counts.join(flat, "industry_slug", "left")


def leaders(members: DataFrame, cfg=CLASSIFICATION) -> DataFrame:
    """(cik) of the leaders. Only the largest few of an industry are ever ranked."""
    size = members.groupBy("industry_slug").agg(F.count(F.lit(1)).alias("n"), F.max("market_cap").alias("top"))
    ranked = first_rows(members.select("industry_slug", "cik", "market_cap"), ["industry_slug"],
                        [F.coalesce("market_cap", F.lit(-1.0)).desc(), F.col("cik")], cfg["leader_max"])
    large = F.coalesce(F.col("market_cap") >= F.col("top") * cfg["leader_ratio_of_max"], F.lit(False))
    return (ranked.join(size, "industry_slug")
            .where((F.col("n") >= cfg["leader_min_industry_candidates"]) & (F.col("top") > 0)
                   & (large | (F.col("rank") <= cfg["leader_min"]))).select("cik"))


def follower_category(cfg=CLASSIFICATION):
    """X2."""
    cap, rev, oi = F.col("market_cap"), ttm("revenue"), ttm("operating_income")
    immature = F.coalesce(oi <= 0, F.lit(True)) | F.coalesce(rev < cfg["emerging_revenue_threshold"], F.lit(True))
    return (F.when(cap.isNull() | (cap < cfg["challenger_min_market_cap"]), "EMERGING")
            .when((cap < cfg["emerging_max_market_cap"]) & immature, "EMERGING").otherwise("CHALLENGER"))


def classify(snapshot: DataFrame) -> DataFrame:
    """Adds ``category``."""
    top = leaders(snapshot).withColumn("_leader", F.lit(True))
    return snapshot.join(top, "cik", "left").withColumn(
        "category", F.when(F.col("_leader"), "LEADER").otherwise(follower_category())).drop("_leader")


def factor_percentiles(snapshot: DataFrame, factors: DataFrame, minimum: int) -> DataFrame:
    """(cik, factor_key, percentile) of the factors that have a peer distribution.

    ``factors`` = (cik, industry_slug, factor_key, raw). A raw value need not occur in the distribution.
    """
    source = reduce(lambda c, kv: c.when(F.col("factor_key") == kv[0], kv[1]), PERCENTILE_SOURCE.items(), F.when(F.lit(False), ""))
    probes = factors.select("cik", "industry_slug", "factor_key", source.alias("key"), F.col("raw").alias("value")).where(
        "key IS NOT NULL AND value IS NOT NULL")
    return percentiles(distributions(snapshot), ["industry_slug", "key"], "value", probes, minimum).select("cik", "factor_key", "percentile")
