"""Which listed securities and companies enter the universe."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarterdeck.config import UNIVERSE
from quarterdeck.functions.scalars import col

SEPARATOR = " - "


def security_type(name) -> Column:
    """text after the last separator."""
    n = col(name)
    return F.when(n.contains(SEPARATOR), F.substring_index(n, SEPARATOR, -1))


def listing_rejection(cfg=UNIVERSE) -> Column:
    """first reason a listing is out, NULL when it is in."""
    kind = security_type("security_name")

    def has(words):
        return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(kind, w))

    return (F.when(F.col("is_etf"), "ETF").when(F.col("is_test_issue"), "TEST_ISSUE")
            .when(~F.col("exchange").isin(cfg["exchanges"]), "EXCHANGE")
            .when(F.col("financial_status").isin(cfg["exclude_financial_status"]), "FINANCIAL_STATUS")
            .when(kind.isNull(), "UNKNOWN_SECURITY_TYPE")
            .when(has(cfg["name_exclude"]), "NOT_COMMON_STOCK")
            .when(~has(cfg["name_include"]), "NOT_COMMON_STOCK"))


def residual_sic(sic, description) -> Column:
    """catch-all industry codes, by code shape or by wording."""
    s, d = col(sic), col(description)
    worded = (d.rlike(r"\bNEC\b") | d.rlike(r"(?i)not elsewhere classified") | d.rlike(r"(?i)\bmisc(ellaneous)?\b")
              | d.rlike(r"(?i),\s*etc\.?\s*$"))
    return F.coalesce(s.rlike(r"^\d{2}00$"), F.lit(False)) | F.coalesce(worded, F.lit(False))


def classify(df: DataFrame, taxonomy) -> DataFrame:
    """the override of a ticker wins over the code map. Adds industry_slug, theme_slug, source."""
    home = taxonomy.industries.select(F.col("slug").alias("ov_industry"), F.col("theme_slug").alias("_home"))
    overrides = (taxonomy.overrides.where("industry IS NOT NULL")
                 .select(F.upper("ticker").alias("_ticker"), F.col("industry").alias("ov_industry"), F.col("theme").alias("_ov_theme"))
                 .join(home, "ov_industry", "left"))
    codes = taxonomy.sic_map.select(F.col("sic").alias("_sic"), F.col("industry").alias("_industry"), F.col("theme").alias("_theme"))
    hit = F.col("ov_industry").isNotNull()
    return (df.join(overrides, F.upper("ticker") == F.col("_ticker"), "left")
            .join(codes, F.col("sic") == F.col("_sic"), "left")
            .withColumn("industry_slug", F.coalesce("ov_industry", "_industry"))
            .withColumn("theme_slug", F.when(hit, F.coalesce("_ov_theme", "_home")).otherwise(F.col("_theme")))
            .withColumn("source", F.when(hit, "override").when(F.col("_industry").isNotNull(), "sic"))
            .drop("_ticker", "ov_industry", "_ov_theme", "_home", "_sic", "_industry", "_theme"))


def decide(tickers: DataFrame, listings: DataFrame, reference: DataFrame, taxonomy, cfg=UNIVERSE) -> DataFrame:
    """one row per candidate ticker with its decision.

    ACCEPTED, LOOKUP_FAILED (neither accepted nor retired) or the reason for rejecting the company.
    """
    eligible = listings.where(listing_rejection(cfg).isNull()).select(F.upper("ticker").alias("_key"), F.col("exchange"))
    ref = reference.withColumnRenamed("name", "ref_name").withColumn("found", F.lit(True))
    rows = (tickers.withColumn("_key", F.upper("ticker")).join(eligible, "_key")
            .withColumn("ticker", F.col("_key")).drop("_key").join(ref, "cik", "left"))
    rows = classify(rows, taxonomy)
    reviewed = taxonomy.residual_reviewed.select(F.col("sic").alias("_rev"))
    rows = rows.join(reviewed, F.col("sic") == F.col("_rev"), "left")
    decision = (F.when(F.col("found").isNull(), "LOOKUP_FAILED")
                .when(F.col("entity_type") != "operating", "NOT_OPERATING")
                .when(F.col("sic").isin(cfg["exclude_sic"]), "EXCLUDED_SIC")
                .when(F.col("industry_slug").isNull(), "UNCLASSIFIABLE")
                .when((F.col("source") == "sic") & F.col("_rev").isNull() & residual_sic("sic", "sic_description"), "RESIDUAL_SIC")
                .otherwise("ACCEPTED"))
    return (rows.withColumn("name", F.coalesce(F.nullif("ref_name", F.lit("")), F.col("title")))
            .withColumn("decision", decision).drop("_rev", "found", "ref_name"))


REJECTIONS = ["NOT_OPERATING", "EXCLUDED_SIC", "UNCLASSIFIABLE", "RESIDUAL_SIC"]


def settle(decisions: DataFrame) -> DataFrame:
    """F4 per company: rejections apply last, so one rejected ticker retires the company."""
    return decisions.where("decision <> 'LOOKUP_FAILED'").groupBy("cik").agg(
        F.max(F.col("decision").isin(REJECTIONS)).alias("rejected"),
        F.max(F.col("decision") == "ACCEPTED").alias("accepted"))


def unmapped_codes(decisions: DataFrame, taxonomy) -> DataFrame:
    """codes nobody decided about yet."""
    seen = decisions.where("decision = 'UNCLASSIFIABLE' AND sic IS NOT NULL").select("sic").distinct()
    return seen.join(taxonomy.unmapped, "sic", "left_anti")
