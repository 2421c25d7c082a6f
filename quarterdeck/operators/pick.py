"""One row per key. An aggregate rather than a ranked window: rows of a hot key are reduced before they are shuffled."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def best_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row with the greatest ``order`` of each key; later elements break ties of earlier ones."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return picked.select(*keys, "_best.*").select(*df.columns)


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key. The rank filter is pushed below the shuffle, so each task sends n rows per key."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)
