"""Upserts. Plain files have no MERGE, so each one is a union reduced to one row per key, or an anti join plus a union."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarterdeck.operators.pick import best_row

FACT_KEY = ["cik", "tag", "period_end", "qtrs", "form"]


def _fact_order(*between):
    return [F.col("filed_date"), (F.col("source") == "api").cast("int"), *between, -F.col("load_seq")]


def latest_facts(log: DataFrame) -> DataFrame:
    """K1: later filing wins; on the same day ``api`` beats ``bulk``; on a full tie the fact loaded first stays."""
    return best_row(log, FACT_KEY, _fact_order())


def upsert_facts(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """K1 against a stored table: stored rows count as loaded before the batch."""
    both = stored.withColumn("_stored", F.lit(1)).unionByName(batch.withColumn("_stored", F.lit(0)))
    return best_row(both, FACT_KEY, _fact_order(F.col("_stored"))).drop("_stored")


def upsert_companies(stored: DataFrame, batch: DataFrame, today) -> DataFrame:
    """K2: new attributes replace old ones; ``first_seen`` is kept."""
    s, b = stored.alias("s"), batch.alias("b")
    attrs = [c for c in batch.columns if c != "cik"]
    hit = F.col("b.cik").isNotNull()
    return s.join(b, F.col("s.cik") == F.col("b.cik"), "full").select(
        F.coalesce("b.cik", "s.cik").alias("cik"),
        *[F.when(hit, F.col(f"b.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in attrs],
        F.when(hit, True).otherwise(F.col("s.is_active")).alias("is_active"),
        F.coalesce(F.col("s.first_seen"), F.lit(today)).alias("first_seen"),
        F.when(hit, F.lit(today)).otherwise(F.col("s.last_updated")).alias("last_updated"),
    )


def upsert_by_key(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """A batch row replaces the stored row of the same key."""
    return stored.join(batch, keys, "left_anti").unionByName(batch)


def replace_group(stored: DataFrame, batch: DataFrame, keys: list[str], affected: DataFrame | None = None) -> DataFrame:
    """K4, K6, K8: all stored rows of an affected group go, so rows that vanished from the batch do not survive."""
    gone = (batch if affected is None else affected).select(*keys).distinct()
    return stored.join(gone, keys, "left_anti").unionByName(batch)


def retire(companies: DataFrame, classification: DataFrame, rejected: DataFrame, today):
    """K5: rejected companies that are active become inactive and lose their classification.

    Returns (companies, classification, tickers that were retired).
    """
    out = rejected.select("cik").distinct()
    flagged = companies.join(out.withColumn("_out", F.lit(True)), "cik", "left")
    hit = F.col("_out").isNotNull() & F.col("is_active")
    retired = flagged.where(hit).select("cik", "ticker")
    updated = (flagged.withColumn("last_updated", F.when(hit, F.lit(today)).otherwise(F.col("last_updated")))
               .withColumn("is_active", F.when(hit, False).otherwise(F.col("is_active"))).select(*companies.columns))
    return updated, classification.join(retired, "cik", "left_anti"), retired.select("ticker")


def upsert_market(log: DataFrame) -> DataFrame:
    """K7: the last write of a (cik, date) wins."""
    return best_row(log, ["cik", "date"], [F.col("load_seq")])
