"""Balance-sheet values as of a period end."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarterdeck import tags as t
from quarterdeck.config import RECONCILE
from quarterdeck.functions.lineitems import cash_line, total_debt
from quarterdeck.functions.scalars import first_of, same_number
from quarterdeck.operators.facts import wide

LOOKBACK = RECONCILE["instant_lookback_days"]
GROUPS = {"debt": t.DEBT_SHAPES, "cash": t.CASH_SHAPES}


def _texts(names) -> Column:
    return F.array(*[F.lit(n) for n in names]).cast("array<string>")


def _twins(entries: str, tag: str) -> Column:
    """Other tags of the same date that hold the same number as ``tag``."""
    same = F.filter(entries, lambda e: (e["tag"] != tag) & same_number(e["value"], F.col(tag)))
    return F.transform(same, lambda e: e["tag"])


def last_known(events: DataFrame, probes: DataFrame, keys: list[str], date: str, columns: list[str], lookback=LOOKBACK) -> DataFrame:
    """For every probe date the newest non-null of each column, with its date, within the lookback.

    The probes ride through one sort of the events, so the join costs a single shuffle on the keys. The newest value
    overall is the only one that can lie inside the lookback, so the frame needs no lower bound.
    """
    both = events.select(*keys, date, *columns).withColumn("_probe", F.lit(False)).unionByName(
        probes.select(*keys, date).distinct().withColumn("_probe", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(date).rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def newest(c):
        seen = F.last(F.when(F.col(c).isNotNull(), F.struct(F.col(date).alias("date"), F.col(c).alias("value"))), ignorenulls=True).over(w)
        return seen.alias(c)

    out = both.select(*keys, date, "_probe", *[newest(c) for c in columns]).where("_probe").drop("_probe")
    fresh = lambda c: F.when(F.datediff(F.col(date), F.col(f"{c}.date")) <= lookback, F.col(c)).alias(c)
    return out.select(*keys, date, *[fresh(c) for c in columns])


def basic_shares(values: DataFrame) -> DataFrame:
    """R12 input: basic weighted shares per date, the larger one when several period lengths end on it."""
    rows = wide(values.where("qtrs <> 0"), ["cik", "qtrs", "period_end"], t.BASIC_SHARES_CHAIN)
    return (rows.withColumn("basic", first_of([(x, x) for x in t.BASIC_SHARES_CHAIN])[0])
            .groupBy("cik", "period_end").agg(F.max("basic").alias("basic")).where("basic IS NOT NULL"))


def balance_events(values: DataFrame, absent: DataFrame) -> DataFrame:
    """One row per (cik, date): instants by tag, and per tag group what was on that date.

    ``<group>_on`` = (tags present, tags known absent), ``<tag>_alias`` = group tags that held the same number.
    """
    inst = wide(values.where("qtrs = 0"), ["cik", "period_end"], t.INSTANT_TAGS)
    gone = absent.groupBy("cik", "period_end").agg(F.collect_set("tag").alias("gone"))
    rows = inst.join(gone, ["cik", "period_end"], "left").join(basic_shares(values), ["cik", "period_end"], "full")
    made = {}
    for group, shapes in GROUPS.items():
        entries = F.filter(F.array(*[F.struct(F.lit(x).alias("tag"), F.col(x).alias("value")) for x in shapes]),
                           lambda e: e["value"].isNotNull())
        made[f"_{group}"] = entries
    rows = rows.withColumns(made)
    carried = {}
    for group, shapes in GROUPS.items():
        present = F.transform(f"_{group}", lambda e: e["tag"])
        carried[f"{group}_on"] = F.when(F.size(present) > 0, F.struct(present.alias("present"), F.coalesce("gone", _texts([])).alias("gone")))
        for x in shapes:
            carried[x] = F.when(F.col(x).isNotNull(), F.struct(F.col(x).alias("value"), _twins(f"_{group}", x).alias("twins")))
    return rows.withColumns(carried).drop("gone", "_debt", "_cash")


def usable(tag: str, group: str) -> Column:
    """The amount of a group tag that still stands next to the group's newest measurement.

    An older component is dropped when the newest date overlaps it, shows it absent, measured its region again under any
    family (debt only), or held its number under another name.
    """
    shapes = GROUPS[group]
    present, gone = F.col(f"{group}_on.value.present"), F.col(f"{group}_on.value.gone")
    region = lambda *names: F.arrays_overlap(present, _texts([x for x, (_, r) in shapes.items() if r in names]))
    again = F.lit(False)
    if group == "debt":
        mine = shapes[tag][1]
        again = region("noncurrent") & region("current") if mine == "spanning" else region(mine)
    dropped = (F.arrays_overlap(present, _texts(t.overlapping(tag, shapes))) | F.array_contains(gone, tag) | again
               | F.arrays_overlap(F.col(f"{tag}.value.twins"), present))
    on_newest = F.col(f"{tag}.date") == F.col(f"{group}_on.date")
    return F.when(on_newest | ~dropped, F.col(f"{tag}.value.value"))


def guarded_shares(cover, basic) -> Column:
    """Cover shares far below the basic average are one share class only; a gap beyond 100 times is a unit error."""
    partial = ((cover > 0) & (basic > 0) & (cover < RECONCILE["cover_min_fraction_of_basic"] * basic)
               & (basic <= RECONCILE["shares_scale_error_factor"] * cover))
    return F.when(~F.coalesce(partial, F.lit(False)), cover)


def carried(values: DataFrame, absent: DataFrame, probes: DataFrame) -> DataFrame:
    """J10 over all balance-sheet tags for the given (cik, period_end) probes."""
    events = balance_events(values, absent)
    columns = [c for c in events.columns if c not in ("cik", "period_end")]
    return last_known(events, probes, ["cik"], "period_end", columns)


def stock_lines(state: DataFrame) -> DataFrame:
    """(cik, period_end, cash, total_debt, equity, shares_outstanding and their tag columns)."""
    grouped = {x: g for g, shapes in GROUPS.items() for x in shapes}
    step = state.withColumns({f"u_{x}": usable(x, g) for x, g in grouped.items()})
    value = lambda x: F.col(f"u_{x}")
    as_of = lambda x: F.col(f"{x}.value.value") if x in grouped else F.col(f"{x}.value")
    date_of = lambda x: F.col(f"{x}.date")
    cash = cash_line(value)
    shares = guarded_shares(as_of(t.COVER_SHARES), F.col("basic.value"))
    out = total_debt(step, value, as_of, date_of)
    return out.select(
        "cik", "period_end", cash[0].alias("cash"), cash[1].alias("cash_tag"), "total_debt", "total_debt_tag",
        as_of(t.EQUITY).alias("equity"), F.when(as_of(t.EQUITY).isNotNull(), t.EQUITY).alias("equity_tag"),
        shares.alias("shares_outstanding"), F.when(shares.isNotNull(), t.COVER_SHARES).alias("shares_outstanding_tag"))
