"""One value per (cik, qtrs, canonical period end, tag)."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarterdeck.operators.pick import best_row


def one_value(dated: DataFrame) -> DataFrame:
    """Any api value beats bulk ones; then a date the source itself gave beats a moved one; then the later filing."""
    rows = dated.select("cik", "qtrs", F.col("canonical").alias("period_end"), "tag", "value", "source", "filed_date", "load_seq", "form",
                        (F.col("canonical") == F.col("period_end")).alias("native"))
    picked = best_row(rows, ["cik", "qtrs", "period_end", "tag"],
                      [(F.col("source") == "api").cast("int"), F.col("native").cast("int"), F.col("filed_date"),
                       -F.col("load_seq"), F.col("form")])
    return picked.select("cik", "qtrs", "period_end", "tag", "value", "source")


def wide(values: DataFrame, keys: list[str], tags: list[str]) -> DataFrame:
    """One column per tag. The tag list is given, so no pass over the data is spent on finding it."""
    return values.where(F.col("tag").isin(tags)).groupBy(*keys).agg(
        *[F.max(F.when(F.col("tag") == t, F.col("value"))).alias(t) for t in tags])
