"""The fundamentals job: outcomes per company, old rows of damaged ones, run records of both ends."""
from datetime import date

import pytest
from pyspark.sql import functions as F

from quarterdeck import schemas
from quarterdeck.plans import ingest, normalize, writes

ENDS = [date(2000, 3, 31), date(2000, 6, 30), date(2000, 9, 30), date(2000, 12, 31)]


def fact(cik, tag, k, qtrs, value):
    return (cik, tag, "USD", date(2000, 1, 1), ENDS[k], qtrs, value, "10-Q", date(2001, 1, 1), f"{cik}-{k}", "api", 0)


def year(cik, scale=1.0, tag="Revenues"):
    return [fact(cik, tag, k, k + 1, 100.0 * (k + 1) * scale) for k in range(4)]


def test_outcomes_of_a_damaged_company(spark):
    huge = 1.5e308
    clash = [fact(4, "Revenues", k, 1, huge) for k in range(4)] + [fact(4, "Revenues", 1, 2, -huge), fact(4, "Revenues", 2, 3, huge), fact(4, "Revenues", 3, 4, huge)]
    rows = [*year(1), *year(2)[:3], fact(2, "NetIncomeLoss", 3, 4, float("inf")), *year(3, tag="Unknown"), *clash, *year(5)]
    log = spark.createDataFrame(rows, schemas.FACT)
    result = normalize.normalize(log)
    got = {r.cik: r for r in normalize.outcomes(spark.range(1, 7).select(F.col("id").alias("cik")), result).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "periods", 2: "failed", 3: "no_data", 4: "failed", 5: "periods", 6: "no_data"}
    assert got[2].reason == "fact without a finite value of NetIncomeLoss" and got[4].reason.startswith("revenue: ValueError") and got[1].rows == 5
    assert {r.cik for r in result.periods.select("cik").distinct().collect()} == {1, 5}


def test_job_keeps_old_rows_and_records_both_ends(spark, tmp_path):
    out, universe = str(tmp_path / "out"), spark.range(1, 4).select(F.col("id").alias("cik"))
    none = spark.createDataFrame([], schemas.FACT)
    first = spark.createDataFrame([r for c in (1, 2, 3) for r in year(c)], schemas.FACT)
    ingest.ingest_fundamentals(spark, str(tmp_path), [date(2000, 1, 1)], universe, none, first, out, buckets=4)
    bad = [fact(2, "Revenues", 0, 1, float("nan")), *year(1, 2.0)]
    later = [(*r[:8], date(2001, 6, 1), *r[9:]) for r in bad]
    got = ingest.ingest_fundamentals(spark, str(tmp_path), [], universe, spark.read.parquet(f"{out}/facts"), spark.createDataFrame(later, schemas.FACT), out, buckets=4)
    assert {r.cik: r.status for r in got.collect()} == {1: "periods", 2: "failed", 3: "periods"}
    held = {(r.cik, r.revenue) for r in writes.read_table(spark, f"{out}/periods").where("period_type = 'A'").collect()}
    assert held == {(1, 800.0), (2, 400.0), (3, 400.0)}
    runs = writes.runs(spark.read.parquet(f"{out}/runs")).orderBy("started_at").collect()
    assert [r.status for r in runs] == ["succeeded", "succeeded"] and runs[0].stats["quarter_errors"].startswith("2000q1: FileNotFoundError")
    assert runs[1].stats["failed"] == "1" and runs[1].stats["failed_companies"] == "2: fact without a finite value of Revenues" and runs[1].stats["universe_size"] == "3"


def test_job_stops_when_most_companies_fail(spark, tmp_path):
    out, universe = str(tmp_path / "out"), spark.range(30).select(F.col("id").alias("cik"))
    rows = [r for c in range(30) for r in (year(c) if c < 10 else [fact(c, "Revenues", 0, 1, float("nan"))])]
    with pytest.raises(RuntimeError, match="20 of 30"):
        ingest.ingest_fundamentals(spark, str(tmp_path), [], universe, spark.createDataFrame([], schemas.FACT), spark.createDataFrame(rows, schemas.FACT), out)
    assert not (tmp_path / "out" / "periods").exists()
    run = writes.runs(spark.read.parquet(f"{out}/runs")).first()
    assert run.status == "failed" and "20 of 30" in run.error and run.started_at <= run.finished_at and run.stats["failed"] == "20"
    log = spark.read.parquet(f"{out}/runs")
    assert writes.runs(log.where("status = 'running'")).first().status == "running" and log.count() == 2
