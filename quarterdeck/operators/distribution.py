"""Exact order statistics of groups of any size (A1, A2, A5).

Values are first reduced to (value, count) rows, which are materialised, so the input is read once. These are dealt by ranges of (group, value) into as
many slices as their number asks for; a value's rank is the sum of its group's counts in earlier slices and before it in its own. So ranking one
group is the work of as many tasks as it has slices, and no task holds more than about SLICE rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quarterdeck.functions.scalars import finite
from quarterdeck.operators.checkpoint import cut

SLICE = 1_000_000


def value_ranks(df: DataFrame, by: list[str], value: str, probes: DataFrame | None = None, slice_rows: int = SLICE) -> DataFrame:
    """One row per distinct value of a group: ``n_at`` equal, ``n_below`` smaller, ``n_total`` in all.

    Rows of ``probes`` are ranked against the group without being counted in it.
    """
    rows = df.where(finite(value)).select(*by, F.col(value).alias("_v"), F.lit(1).alias("_n"))
    if probes is not None:
        rows = rows.unionByName(probes.where(finite(value)).select(*by, F.col(value).alias("_v"), F.lit(0).alias("_n")))
    counts = cut(rows.groupBy(*by, "_v").agg(F.sum("_n").alias("n_at")))
    slices = -(-counts.count() // slice_rows)
    inside, whole = Window.partitionBy(*by, "_slice").orderBy("_v"), Window.partitionBy(*by)
    if slices <= 1:
        ranked = counts.withColumns({"n_below": F.sum("n_at").over(whole.orderBy("_v")) - F.col("n_at"), "n_total": F.sum("n_at").over(whole)})
    else:
        dealt = cut(counts.repartitionByRange(slices, *by, "_v").withColumn("_slice", F.spark_partition_id()))
        sums = dealt.groupBy(*by, "_slice").agg(F.sum("n_at").alias("_in"))
        sums = sums.select(*by, "_slice", F.sum("_in").over(whole).alias("n_total"), (F.sum("_in").over(whole.orderBy("_slice")) - F.col("_in")).alias("_before"))
        ranked = dealt.join(sums, [*by, "_slice"]).withColumn("n_below", F.col("_before") + F.sum("n_at").over(inside) - F.col("n_at"))
    return ranked.select(*by, F.col("_v").alias(value), "n_at", "n_below", "n_total")


def median(df: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    """A1: exact median per group, the mean of the middle two for an even count."""
    lo, hi = F.floor((F.col("n_total") - 1) / 2), F.floor(F.col("n_total") / 2)
    covers = lambda p: (F.col("n_below") <= p) & (p < F.col("n_below") + F.col("n_at"))
    return value_ranks(df, by, value).groupBy(*by).agg(
        ((F.max(F.when(covers(lo), F.col(value))) + F.max(F.when(covers(hi), F.col(value)))) / 2).alias(name))


def median_deviation(df: DataFrame, by: list[str], value: str, name: str = "mad") -> DataFrame:
    """A2: median of the absolute distances from the group's median."""
    centred = df.join(median(df, by, value, "_median"), by).withColumn("_away", F.abs(F.col(value) - F.col("_median")))
    return median(centred, by, "_away", name)


def percentiles(members: DataFrame, by: list[str], value: str, probes: DataFrame, minimum: int = 1,
                name: str = "percentile") -> DataFrame:
    """A5: share of the group's values strictly below each probe; groups under ``minimum`` values give none."""
    ranked = value_ranks(members, by, value, probes).where(F.col("n_total") >= minimum)
    share = ranked.select(*by, value, (F.col("n_below") / F.col("n_total")).alias(name))
    return probes.join(share, [*by, value], "left")
