"""Facts to period rows (R10, R14), with an outcome for every company."""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from quarterdeck import tags as t
from quarterdeck.config import FLOW_FIELDS, INGEST, PERIOD_FIELDS
from quarterdeck.functions.lineitems import flow_lines
from quarterdeck.functions.scalars import finite
from quarterdeck.operators import carry, dates, facts as fact_ops, periods as period_ops, ytd
from quarterdeck.operators.checkpoint import co_partitioned, cut, cut_by
from quarterdeck.operators.upsert import latest_facts

FLOW_LINES = [*FLOW_FIELDS, "shares_diluted"]
STOCK_LINES = ["cash", "total_debt", "equity", "shares_outstanding"]


def _tag_map(names) -> F.Column:
    """Field -> tag of the fields that have one."""
    pairs = F.array(*[F.struct(F.lit(n).alias("k"), F.col(f"{n}_tag").alias("v")) for n in names])
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))


def quarter_lines(flows: DataFrame, quarters: DataFrame) -> DataFrame:
    """Reported single quarters overlaid by the resolved ones."""
    reported = flows.where("qtrs = 1").drop("qtrs")
    resolved = quarters.groupBy("cik", "period_end").agg(*[
        F.max(F.when(F.col("field") == f, F.struct("value", "derived"))).alias(f"r_{f}") for f in FLOW_FIELDS])
    both = reported.join(resolved, ["cik", "period_end"], "full")
    out = {}
    for f in FLOW_FIELDS:
        r = F.col(f"r_{f}")
        out[f] = F.when(r.isNotNull(), r["value"]).otherwise(F.col(f))
        out[f"{f}_tag"] = F.when(F.coalesce(r["derived"], F.lit(False)), F.when(r["value"].isNotNull(), period_ops.DERIVED)).otherwise(F.col(f"{f}_tag"))
    out["derived_tag"] = F.when(F.coalesce(*[F.when(F.col(f"r_{f}")["derived"], True) for f in FLOW_FIELDS]), period_ops.DERIVED)
    return both.withColumns(out).select("cik", "period_end", F.lit("Q").alias("period_type"), *FLOW_LINES, *[f"{f}_tag" for f in FLOW_LINES], "derived_tag")


def annual_lines(flows: DataFrame, rejected: DataFrame) -> DataFrame:
    """Four-quarter figures; a field no repair could keep is NULL."""
    gone = rejected.where("span = 4").groupBy("cik", "period_end").agg(F.collect_set("field").alias("gone"))
    rows = flows.where("qtrs = 4").drop("qtrs").join(gone, ["cik", "period_end"], "left")
    keep = lambda f, c: F.when(~F.coalesce(F.array_contains("gone", f), F.lit(False)), F.col(c))
    return rows.withColumns({c: keep(f, c) for f in FLOW_FIELDS for c in (f, f"{f}_tag")}).select(
        "cik", "period_end", F.lit("A").alias("period_type"), *FLOW_LINES, *[f"{f}_tag" for f in FLOW_LINES],
        F.lit(None).cast("string").alias("derived_tag"))


class Normalized(NamedTuple):
    """periods with source_tags; rejections (cik, period_end, period_type, field, reason, value); failures (cik, reason), companies that have neither."""
    periods: DataFrame
    rejections: DataFrame
    failures: DataFrame


def fact_fault() -> Column:
    """Why a fact can't be reckoned with, or NULL."""
    return (F.when(F.col("period_end").isNull(), "fact without a period end").when(F.col("qtrs").isNull() | (F.col("qtrs") < 0), "fact without a period length")
            .when(F.col("filed_date").isNull(), "fact without a filing date").when(~F.coalesce(finite("value"), F.lit(False)), "fact without a finite value"))


def normalize(log: DataFrame) -> Normalized:
    """All steps are keyed by company. A company fails when a fact that no later filing replaced is faulty, or when a stretch of it can't be
    solved; it then has no rows at all, and the others are not touched."""
    tracked = cut(latest_facts(log.where(F.col("tag").isin(t.TRACKED_TAGS))).withColumn("fault", fact_fault()))
    with co_partitioned(log.sparkSession):
        tracked = cut_by(tracked)  # of a frame without a plan, whose columns keep their identity and so their partitioning
        latest = tracked.where("fault IS NULL").drop("fault")
        dated = cut_by(dates.canonical_dates(latest, cut_by))
        values = cut_by(fact_ops.one_value(dated))
        keys = ["cik", "qtrs", "period_end"]
        flows = cut_by(flow_lines(fact_ops.wide(values.where("qtrs <> 0"), keys, t.FLOW_TAGS), keys))
        quarters, rejected, unsolved = ytd.resolve_quarters(flows, ytd.fiscal_grid(values), cut_by)
        faulty = tracked.where("fault IS NOT NULL").select("cik", F.concat_ws(" ", "fault", F.lit("of"), "tag").alias("reason"))
        failures = cut_by(faulty.unionByName(unsolved).groupBy("cik").agg(F.min("reason").alias("reason")))
        lines = cut_by(quarter_lines(flows, quarters).unionByName(annual_lines(flows, rejected)).join(failures, "cik", "left_anti"))
        stocks = carry.stock_lines(carry.carried(values, dates.absent_tags(dated), lines.select("cik", "period_end")))
        rows = lines.join(stocks, ["cik", "period_end"], "left").withColumn("fcf", F.col("ocf") - F.col("capex"))
        rows = rows.withColumn("source_tags", _tag_map([*FLOW_LINES, *STOCK_LINES, "derived"]))
        checked = cut_by(period_ops.validate(rows.select("cik", "period_end", "period_type", *PERIOD_FIELDS, "source_tags")))
        ttm = period_ops.validate(period_ops.trailing_year(checked.where("period_type = 'Q'").drop("rejections")))
        out = checked.unionByName(ttm)
    return Normalized(out.drop("rejections"), period_ops.rejections(out), failures)


def outcomes(universe: DataFrame, result: Normalized) -> DataFrame:
    """One row per company of the universe: status periods, no_data or failed, its numbers of period rows and rejected fields, and the reason of a failure."""
    rows = result.periods.where("period_type <> 'TTM'").groupBy("cik").agg(F.count(F.lit(1)).alias("rows"))
    lost = result.rejections.groupBy("cik").agg(F.count(F.lit(1)).alias("rejected"))
    every = universe.select("cik").distinct().join(result.failures, "cik", "left").join(rows, "cik", "left").join(lost, "cik", "left")
    status = F.when(F.col("reason").isNotNull(), "failed").when(F.col("rows") > 0, "periods").otherwise("no_data")
    return every.select("cik", status.alias("status"), (F.col("reason").isNotNull()).alias("failed"), F.coalesce("rows", F.lit(0)).alias("rows"),
                        F.coalesce("rejected", F.lit(0)).alias("rejected"), "reason")


def failure_gate(outcomes: DataFrame) -> DataFrame:
    """outcomes = (cik, failed). ``stop`` is set when most companies of a large enough set failed."""
    sums = outcomes.agg(F.count(F.lit(1)).alias("companies"), F.count_if("failed").alias("failed"))
    share = F.try_divide("failed", "companies")
    return sums.withColumn("stop", F.coalesce((F.col("companies") >= INGEST["failure_min_sample"]) & (share > INGEST["failure_rate_threshold"]), F.lit(False)))


def guard_failures(outcomes: DataFrame) -> None:
    row = failure_gate(outcomes).first()
    if row.stop:
        sample = [str(r.cik) for r in outcomes.where("failed").orderBy("cik").limit(INGEST["sample_size"]).collect()]
        raise RuntimeError(f"{row.failed} of {row.companies} companies failed to normalise, for example {', '.join(sample)}")
