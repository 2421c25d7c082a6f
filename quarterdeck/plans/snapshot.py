"""One row per company with everything the rules read."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarterdeck.config import RECONCILE
from quarterdeck.functions.metrics import choose_shares, measured
from quarterdeck.operators.changes import universe
from quarterdeck.operators.peers import industry_stats
from quarterdeck.operators.periods import period_arrays
from quarterdeck.operators.pick import best_row

_EMPTY = {"ttm", "q", "a"}


def latest_market(market: DataFrame) -> DataFrame:
    """W4."""
    return best_row(market, ["cik"], [F.col("date"), F.col("load_seq")])


def shares_as_of(periods: DataFrame) -> DataFrame:
    """Newest reported and diluted share counts not older than the lookback before the newest period."""
    kinds = F.create_map(*[F.lit(x) for x in ("Q", 0, "TTM", -1, "A", -2)])[F.col("period_type")]
    newest = periods.groupBy("cik").agg(F.max("period_end").alias("_newest"))
    rows = (periods.select("cik", "period_end", "period_type", "shares_outstanding", "shares_diluted").join(newest, "cik")
            .where(F.col("period_end") >= F.date_sub("_newest", RECONCILE["instant_lookback_days"])))
    pick = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.struct("period_end", kinds)))
    return rows.groupBy("cik").agg(pick("shares_outstanding").alias("shares_reported"), pick("shares_diluted").alias("shares_diluted"))


def price_rows(companies: DataFrame, classification: DataFrame, periods: DataFrame, quotes: DataFrame) -> DataFrame:
    """Market rows of the universe from its quotes (ticker, price, date)."""
    members = universe(companies, classification).select("cik", "ticker")
    shares, basis = choose_shares("shares_reported", "shares_diluted")
    return (members.join(quotes, "ticker").join(shares_as_of(periods), "cik", "left")
            .withColumn("shares_outstanding", shares).withColumn("shares_basis", basis)
            .select("cik", "date", "price", "shares_outstanding", (F.col("price") * F.col("shares_outstanding")).alias("market_cap"),
                    F.lit(None).cast("double").alias("volume"), "shares_basis"))


def unknown_slugs(classification: DataFrame, industries: DataFrame) -> DataFrame:
    """classified companies whose industry is not in the taxonomy."""
    return classification.join(industries.select(F.col("slug").alias("industry_slug")), "industry_slug", "left_anti")


def check_slugs(classification: DataFrame, industries: DataFrame) -> None:
    bad = unknown_slugs(classification, industries).limit(5).collect()
    if bad:
        raise ValueError("industries missing from the taxonomy: " + ", ".join(f"{r.cik} {r.industry_slug}" for r in bad))


def base_snapshot(companies, classification, industries, periods, market) -> DataFrame:
    """D1, first pass: company, classification, market and period arrays."""
    meta = industries.select(F.col("slug").alias("industry_slug"), F.col("name").alias("industry_name"), "tam_usd", "tam_cagr")
    head = (companies.where("is_active").select("cik", "ticker", "name")
            .join(classification.select("cik", "industry_slug", "theme_slug", F.col("source").alias("classification_source")), "cik")
            .join(meta, "industry_slug", "left"))
    quotes = latest_market(market).select("cik", "price", F.col("date").alias("price_date"), "shares_outstanding", "market_cap", "shares_basis")
    arrays = period_arrays(periods)
    full = head.join(quotes, "cik", "left").join(arrays, "cik", "left")
    kind = dict(arrays.dtypes)
    return full.withColumns({c: F.coalesce(F.col(c), F.array().cast(kind[c])) for c in _EMPTY})


def snapshot(companies, classification, industries, periods, market) -> DataFrame:
    """D1, both passes: measures, then the statistics of the industry next to each member."""
    rows = measured(base_snapshot(companies, classification, industries, periods, market))
    return rows.join(industry_stats(rows), "industry_slug", "left")
