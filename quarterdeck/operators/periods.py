"""Period rows over time: validation, trailing twelve months, newest-first positions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarterdeck.config import FLOW_FIELDS, PERIOD_FIELDS, RECONCILE
from quarterdeck.functions.scalars import total

STOCKS = ["cash", "total_debt", "equity", "shares_diluted", "shares_outstanding"]
DERIVED = "cumulative_diff"


def validate(periods: DataFrame) -> DataFrame:
    """revenue below zero and gross profit above revenue become NULL; ``rejections`` says what was removed."""
    rev, gp = F.col("revenue"), F.col("gross_profit")
    bad_rev = rev < 0
    kept = F.when(~bad_rev, rev)
    bad_gp = gp > kept
    note = lambda field, reason, value: F.struct(F.lit(field).alias("field"), F.lit(reason).alias("reason"), value.alias("value"))
    found = F.array_compact(F.array(F.when(bad_rev, note("revenue", "revenue_negative", rev)),
                                    F.when(bad_gp, note("gross_profit", "gross_profit_exceeds_revenue", gp))))
    return (periods.withColumn("rejections", found)
            .withColumns({"revenue": kept, "gross_profit": F.when(~F.coalesce(bad_gp, F.lit(False)), gp)}))


def rejections(validated: DataFrame) -> DataFrame:
    return validated.select("cik", "period_end", "period_type", F.explode("rejections").alias("r")).select(
        "cik", "period_end", "period_type", "r.*")


def trailing_year(quarters: DataFrame) -> DataFrame:
    """One row per four consecutive rows that span a year; flows summed, stocks from the newest quarter."""
    lo, hi = RECONCILE["ttm_span_days"]
    w = Window.partitionBy("cik").orderBy("period_end")
    sums = {f: total([F.col(f), *[F.lag(f, k).over(w) for k in (1, 2, 3)]]) for f in FLOW_FIELDS}
    span = F.datediff("period_end", F.lag("period_end", 3).over(w))
    tags = "source_tags" in quarters.columns
    rows = quarters.select("cik", "period_end", F.lit("TTM").alias("period_type"), *[c.alias(f) for f, c in sums.items()], *STOCKS,
                           span.alias("_span"), *([window_tags(w).alias("source_tags")] if tags else []))
    kept = rows.where(F.col("_span").between(lo, hi)).withColumn("fcf", F.col("ocf") - F.col("capex"))
    return kept.select("cik", "period_end", "period_type", *PERIOD_FIELDS, *(["source_tags"] if tags else []))


def window_tags(w) -> Column:
    """Per field the tag of the newest of the four quarters that has one, and which quarters were derived."""
    ago = lambda c, k: F.lag(c, k).over(w) if k else F.col(c)
    four = F.array(*[F.struct(ago("period_end", k).alias("end"), ago("source_tags", k).alias("tags")) for k in range(4)])
    return merge_tags(four)


def merge_tags(newest_first: Column) -> Column:
    """A12 on an array of (end, tags) structs."""
    plain = lambda m: F.map_filter(m, lambda k, _: k != "derived")
    empty = F.create_map().cast("map<string,string>")
    merged = F.aggregate(newest_first, empty, lambda acc, x: F.map_concat(
        acc, F.map_filter(plain(F.coalesce(x["tags"], empty)), lambda k, _: ~F.map_contains_key(acc, k))))
    derived = F.transform(F.filter(newest_first, lambda x: F.coalesce(F.map_contains_key(x["tags"], "derived"), F.lit(False))),
                          lambda x: x["end"].cast("string"))
    mark = F.when(F.size(derived) > 0, F.map_from_arrays(F.array(F.lit("derived")), F.array(
        F.concat(F.lit(DERIVED + "@"), F.concat_ws(",", derived))))).otherwise(empty)
    return F.map_concat(merged, mark)


def newest_first(periods: DataFrame) -> DataFrame:
    """``pos`` counts surviving rows of one period type from the newest; a gap shifts positions, it leaves no hole."""
    w = Window.partitionBy("cik", "period_type").orderBy(F.desc("period_end"))
    return periods.withColumn("pos", F.row_number().over(w) - 1)


def period_arrays(periods: DataFrame, kinds=("TTM", "Q", "A")) -> DataFrame:
    """W2 as arrays: one row per company with all its periods, newest first, one array per type. A company's history is as long as its years."""
    item = F.struct("period_end", *PERIOD_FIELDS)
    return periods.groupBy("cik").agg(*[
        F.reverse(F.array_sort(F.collect_list(F.when(F.col("period_type") == kind, item)))).alias(kind.lower()) for kind in kinds])


def field(array: str, i: int, name: str) -> Column:
    return F.get(F.col(array), F.lit(i))[name]


def declining(array: str, years: int) -> Column:
    """The newest ``years`` steps all fall; needs one row more than steps."""
    out = F.size(array) >= years + 1
    for i in range(years):
        out = out & F.coalesce(field(array, i, "revenue") < field(array, i + 1, "revenue"), F.lit(False))
    return out


def trailing(array: str, n: int, value) -> Column:
    """The non-null values of the newest n rows, oldest first. ``value`` maps a period struct to a Column."""
    values = F.transform(F.slice(array, 1, n), value)
    return F.reverse(F.filter(values, lambda v: v.isNotNull()))
