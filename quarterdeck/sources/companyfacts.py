"""Company fact documents: namespace -> tag -> unit -> entries."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarterdeck.functions.scalars import col
from quarterdeck.sources.filings import derive_qtrs
from quarterdeck.tags import TRACKED_TAGS

DOCUMENT = ("cik string, facts map<string, map<string, struct<units: map<string, array<struct<"
            "start: string, end: string, val: double, form: string, filed: string, accn: string>>>>>>")


def parse_company_facts(docs: DataFrame, text: str = "value") -> DataFrame:
    """Long facts of one JSON document per row. Tracked tags are kept before the entries are opened."""
    root = docs.select(F.from_json(F.col(text), DOCUMENT).alias("d")).where("d.facts IS NOT NULL")
    root = root.select(F.col("d.cik").try_cast("long").alias("cik"), F.col("d.facts").alias("facts")).where("cik IS NOT NULL")
    tags = root.select("cik", F.explode(F.map_values("facts")).alias("concepts"))
    tags = tags.select("cik", F.explode("concepts").alias("tag", "concept")).where(F.col("tag").isin(TRACKED_TAGS))
    units = tags.select("cik", "tag", F.explode("concept.units").alias("unit", "entries"))
    entries = units.select("cik", "tag", "unit", F.explode("entries").alias("e"))

    def given(c) -> Column:
        return F.nullif(col(f"e.{c}"), F.lit(""))

    ok = F.col("e.val").isNotNull()
    for c in ("end", "form", "filed", "accn"):
        ok = ok & given(c).isNotNull()
    rows = entries.where(ok).select(
        "cik", "tag", "unit", F.col("e.start").try_cast("date").alias("period_start"),
        F.col("e.end").try_cast("date").alias("period_end"), F.col("e.val").alias("value"), F.col("e.form").alias("form"),
        F.col("e.filed").try_cast("date").alias("filed_date"), F.col("e.accn").alias("accession"), F.lit("api").alias("source"))
    rows = rows.where("period_end IS NOT NULL AND filed_date IS NOT NULL")
    return rows.withColumn("qtrs", derive_qtrs("period_start", "period_end"))


def read_company_facts(spark: SparkSession, path: str) -> DataFrame:
    return parse_company_facts(spark.read.text(path, wholetext=True))
