"""The fundamentals job: bulk quarters and company documents to period tables, one company's damage kept apart."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarterdeck.config import INGEST
from quarterdeck.operators.upsert import upsert_facts
from quarterdeck.plans import normalize as norm, writes
from quarterdeck.sources.filings import load_bulk


def _sample(df: DataFrame, text) -> str | None:
    """A few rows as one short text for the run's record."""
    return "; ".join(r[0] for r in df.select(text).orderBy(text).limit(INGEST["sample_size"]).collect()) or None


def ingest_fundamentals(spark: SparkSession, bulk_root: str, quarters: list, universe: DataFrame, stored: DataFrame, api: DataFrame, out: str, buckets: int = 64) -> DataFrame:
    """Writes out/facts, out/periods and out/outcomes, records the run in out/runs, and returns the outcomes.

    ``stored`` are the facts kept so far and ``api`` those of company documents. Companies without data and failed ones keep their old periods. If most
    companies fail, nothing but the facts is written and the run fails.
    """
    with writes.recorded(spark, "fundamentals", f"{out}/runs") as run:
        bulk, report = load_bulk(spark, bulk_root, quarters, universe)
        read = report.agg(F.count(F.lit(1)).alias("asked"), F.count_if(F.col("status") == "loaded").alias("loaded"), F.sum("facts").alias("facts")).first()
        run.stats.update(quarters_asked=read["asked"], quarters_loaded=read["loaded"], bulk_facts=read["facts"] or 0,
                         quarter_errors=_sample(report.where("status = 'failed'"), F.concat_ws(": ", "quarter", "error")))
        batch = bulk.unionByName(api.drop("load_seq")).withColumn("load_seq", F.lit(0).cast("long"))
        facts = run.staged(upsert_facts(stored, batch), facts=F.count(F.lit(1)), api_facts=F.count_if(F.col("source") == "api"))
        facts.write.mode("overwrite").parquet(f"{out}/facts")
        result = norm.normalize(facts.join(universe.select("cik"), "cik", "left_semi"))
        status = F.col("status")
        outcomes = run.staged(norm.outcomes(universe, result), universe_size=F.count(F.lit(1)), normalized=F.count_if(status == "periods"), no_data=F.count_if(status == "no_data"),
                              failed=F.count_if(F.col("failed")), validation_rejected=F.sum("rejected"))
        run.stats["failed_companies"] = _sample(outcomes.where("failed"), F.concat_ws(": ", "cik", "reason"))
        run.stats["rejected_fields"] = _sample(result.rejections, F.concat_ws(":", "cik", "period_type", "period_end", "field", "reason"))
        norm.guard_failures(outcomes)
        writes.write_bucketed(result.periods, f"{out}/periods", buckets=buckets, batch=outcomes.where("status = 'periods'").select("cik"))
        outcomes.write.mode("overwrite").parquet(f"{out}/outcomes")
    return outcomes
