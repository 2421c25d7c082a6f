"""Listing directory, ticker map, company references and quotes."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarterdeck.functions.scalars import finite


def parse_listings(lines: DataFrame, text: str = "value") -> DataFrame:
    """Pipe-delimited directory lines; header, trailer, blank and short lines are no data."""
    f = lines.select(F.split(F.regexp_replace(text, r"\r$", ""), r"\|").alias("f"), F.col(text).alias("line"))
    f = f.where((F.trim("line") != "") & ~F.col("line").startswith("File Creation Time")
                & ~F.col("line").startswith("Nasdaq Traded|") & (F.size("f") >= 9))
    cell = lambda i: F.trim(F.get("f", F.lit(i)))
    lot = F.when(cell(6) == "", 0.0).otherwise(cell(6).try_cast("double"))
    return f.select(cell(1).alias("ticker"), cell(3).alias("exchange"), cell(2).alias("security_name"),
                    (cell(5) == "Y").alias("is_etf"), (cell(7) == "Y").alias("is_test_issue"),
                    F.nullif(cell(8), F.lit("")).alias("financial_status"),
                    F.when(finite(lot), lot).alias("round_lot"))


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    return parse_listings(spark.read.text(path))


def parse_ticker_map(docs: DataFrame, text: str = "value") -> DataFrame:
    """{"0": {cik_str, ticker, title}, ...}; entries without a numeric cik or a ticker are skipped."""
    entries = docs.select(F.explode(F.map_values(F.from_json(
        F.col(text), "map<string, struct<cik_str: long, ticker: string, title: string>>"))).alias("e"))
    return (entries.where("e.cik_str IS NOT NULL AND e.ticker <> ''")
            .select(F.col("e.cik_str").alias("cik"), F.trim("e.ticker").alias("ticker"),
                    F.coalesce("e.title", F.lit("")).alias("title")))


def read_ticker_map(spark: SparkSession, path: str) -> DataFrame:
    return parse_ticker_map(spark.read.text(path, wholetext=True))


REFERENCE = ("cik string, name string, sic string, sicDescription string, exchanges array<string>, entityType string, "
             "fiscalYearEnd string, category string, stateOfIncorporation string, stateOfIncorporationDescription string")


def parse_submissions(docs: DataFrame, text: str = "value") -> DataFrame:
    """Company reference documents; an empty text is a missing one."""
    d = docs.select(F.from_json(F.col(text), REFERENCE).alias("d")).select("d.*")
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    return d.withColumn("_cik", F.col("cik").try_cast("long")).where("_cik IS NOT NULL").select(
        F.col("_cik").alias("cik"), F.coalesce("name", F.lit("")).alias("name"), empty("sic").alias("sic"),
        empty("sicDescription").alias("sic_description"), F.coalesce("exchanges", F.array().cast("array<string>")).alias("exchanges"),
        empty("entityType").alias("entity_type"), empty("fiscalYearEnd").alias("fiscal_year_end"),
        empty("category").alias("filer_category"), empty("stateOfIncorporation").alias("state"),
        empty("stateOfIncorporationDescription").alias("state_description"))


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    return parse_submissions(spark.read.text(path, wholetext=True))


def parse_quotes(quotes: DataFrame) -> DataFrame:
    """(ticker, price, time in epoch seconds) to (ticker, price, UTC date); non-positive cells are no quote."""
    return quotes.where("price > 0 AND time > 0").select(
        "ticker", "price", F.to_date(F.timestamp_seconds("time")).alias("date"))


def read_quotes(spark: SparkSession, path: str) -> DataFrame:
    return parse_quotes(spark.read.json(path, schema="ticker string, price double, time long"))


def read_price_file(spark: SparkSession, path: str) -> DataFrame:
    """Prices of one day: {"date": ..., "prices": {ticker: price}}."""
    d = spark.read.schema("date date, prices map<string, double>").option("multiLine", True).json(path)
    return d.select(F.explode("prices").alias("ticker", "price"), "date").where("price > 0")
