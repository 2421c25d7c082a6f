"""Period end dates that differ by a few days between filings and sources.

The axis of a fact is ``instant`` (qtrs = 0) or ``duration``. The two are never mixed.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quarterdeck.config import RECONCILE
from quarterdeck.functions.scalars import same_number
from quarterdeck.tags import WEIGHTED_SHARE_TAGS

DAYS = RECONCILE["near_date_days"]
_BIN = DAYS + 1


def axis():
    return F.when(F.col("qtrs") == 0, "instant").otherwise("duration")


def _bin(date):
    return F.floor(F.unix_date(date) / F.lit(_BIN)).cast("int")


def _near(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, after_only: bool) -> DataFrame:
    """Rows whose dates lie within the tolerance. Dates meet by calendar bin, so no other pair is ever formed."""
    steps = [0, 1] if after_only else [-1, 0, 1]
    probe = left.withColumn("_bin", F.explode(F.array(*[_bin(a) + s for s in steps])))
    gap = F.datediff(b, a)
    inside = (gap > 0) & (gap <= DAYS) if after_only else F.abs(gap) <= DAYS
    return probe.join(right.withColumn("_bin", _bin(b)), [*keys, "_bin"]).where(inside).drop("_bin")


def date_pairs(facts: DataFrame) -> DataFrame:
    """Pairs (a, b), a before b, of api dates that may be one period: (cik, axis, a, b)."""
    api = facts.where("source = 'api'")
    inst = api.where("qtrs = 0").select("cik", F.col("period_end").alias("a")).distinct()
    instants = _near(inst, inst.withColumnRenamed("a", "b"), ["cik"], "a", "b", True).select(
        "cik", F.lit("instant").alias("axis"), "a", "b")
    dur = (api.where("qtrs <> 0 AND period_start IS NOT NULL")
           .select("cik", "qtrs", F.col("period_end").alias("a"), F.col("period_start").alias("sa")).distinct())
    other = dur.withColumnRenamed("a", "b").withColumnRenamed("sa", "sb")
    durations = (_near(dur, other, ["cik", "qtrs"], "a", "b", True)
                 .where(F.abs(F.datediff("sa", "sb")) <= DAYS)
                 .select("cik", F.lit("duration").alias("axis"), "a", "b").distinct())
    return instants.unionByName(durations)


def pair_evidence(facts: DataFrame) -> DataFrame:
    """Per candidate pair the agreeing and disagreeing values, the facts on each date, and the verdict."""
    api = facts.where("source = 'api'").withColumn("axis", axis())
    values = (api.where(~F.col("tag").isin(WEIGHTED_SHARE_TAGS)).groupBy("cik", "axis", "period_end", "qtrs", "tag")
              .agg(F.max_by("value", F.struct("load_seq", "form")).alias("value")))
    counts = api.groupBy("cik", "period_end").agg(F.count(F.lit(1)).alias("n"))
    pairs = date_pairs(facts)
    va = values.select("cik", "axis", F.col("period_end").alias("a"), "qtrs", "tag", F.col("value").alias("x"))
    vb = values.select("cik", "axis", F.col("period_end").alias("b"), "qtrs", "tag", F.col("value").alias("y"))
    met = (pairs.join(va, ["cik", "axis", "a"]).join(vb, ["cik", "axis", "b", "qtrs", "tag"])
           .groupBy("cik", "axis", "a", "b").agg(F.count_if(same_number("x", "y")).alias("agree"), F.count(F.lit(1)).alias("seen")))
    out = (pairs.join(met, ["cik", "axis", "a", "b"], "left")
           .join(counts.select("cik", F.col("period_end").alias("a"), F.col("n").alias("n_a")), ["cik", "a"], "left")
           .join(counts.select("cik", F.col("period_end").alias("b"), F.col("n").alias("n_b")), ["cik", "b"], "left")
           .na.fill(0, ["agree", "seen", "n_a", "n_b"]).withColumn("disagree", F.col("seen") - F.col("agree")))
    lo, hi = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    sparse = (lo > 0) & (lo <= RECONCILE["sparse_max_facts"]) & (hi >= RECONCILE["sparse_dominance"] * lo)
    merge = (F.when(F.col("agree") > F.col("disagree"), True).when(F.col("seen") >= 2, False)
             .when((F.col("seen") == 1) & (F.col("axis") == "instant"), False).otherwise(sparse))
    return out.select("cik", "axis", "a", "b", "agree", "disagree", "n_a", "n_b", merge.alias("merge"))


# every date starts as its own cluster; an edge gives both of its clusters the earlier name
_JOINED = """
explode(aggregate(edges, transform(array_sort(array_distinct(flatten(transform(edges, e -> array(e.a, e.b))))), d -> named_struct('d', d, 'c', d)),
  (dates, e) -> transform(dates, x -> named_struct('d', x.d, 'c',
    if(x.c = get(filter(dates, y -> y.d = e.a), 0).c OR x.c = get(filter(dates, y -> y.d = e.b), 0).c,
       least(get(filter(dates, y -> y.d = e.a), 0).c, get(filter(dates, y -> y.d = e.b), 0).c), x.c)))))"""


def components(edges: DataFrame) -> DataFrame:
    """(cik, axis, period_end, cluster) of linked dates, the cluster being its earliest date. Edges are short, so a company's dates fall into runs that no edge
    leaves, some days long; each run is folded by itself."""
    order = Window.partitionBy("cik", "axis").orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = edges.withColumn("_fresh", (reach.isNull() | (F.col("a") > reach)).cast("int")).withColumn("_run", F.sum("_fresh").over(order))
    packed = runs.groupBy("cik", "axis", "_run").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("edges"))
    return packed.select("cik", "axis", F.expr(_JOINED).alias("x")).select("cik", "axis", F.col("x.d").alias("period_end"), F.col("x.c").alias("cluster"))


def clusters(evidence: DataFrame, facts: DataFrame) -> DataFrame:
    """R2: (cik, axis, period_end, canonical) of the dates that merge; the date with most api facts stands for all."""
    linked = components(evidence.where("merge").select("cik", "axis", "a", "b"))
    counts = facts.where("source = 'api'").groupBy("cik", "period_end").agg(F.count(F.lit(1)).alias("n"))
    sized = linked.join(counts, ["cik", "period_end"])
    chosen = F.max_by("period_end", F.struct("n", -F.unix_date("period_end"))).over(Window.partitionBy("cik", "axis", "cluster"))
    return sized.select("cik", "axis", "period_end", chosen.alias("canonical"))


def snap_dates(probes: DataFrame, grid: DataFrame) -> DataFrame:
    """The grid date each probe date (cik, axis, qtrs, period_end) belongs to, itself when none is near.

    An exact hit wins; then dates that carry the same period length, the smaller distance, the earlier date.
    """
    targets = grid.groupBy("cik", "axis", F.col("period_end").alias("target")).agg(F.collect_set("qtrs").alias("lengths"))
    near = _near(probes.select("cik", "axis", "qtrs", "period_end").distinct(), targets, ["cik", "axis"], "period_end", "target", False)
    gap = F.abs(F.datediff("target", "period_end"))
    best = near.groupBy("cik", "axis", "qtrs", "period_end").agg(F.min(F.struct(
        (gap != 0).alias("moved"), (~F.array_contains("lengths", F.col("qtrs"))).alias("other_length"), gap.alias("gap"),
        F.col("target").alias("target"))).alias("best"))
    return (probes.select("cik", "axis", "qtrs", "period_end").distinct()
            .join(best, ["cik", "axis", "qtrs", "period_end"], "left")
            .select("cik", "axis", "qtrs", "period_end", F.coalesce("best.target", "period_end").alias("canonical")))


def canonical_dates(facts: DataFrame, stage=lambda df: df) -> DataFrame:
    """Every fact with its axis and canonical period end. ``stage`` may materialise the merged dates, which are few."""
    rows = facts.withColumn("axis", axis())
    merged = stage(clusters(pair_evidence(facts), facts))
    api = (rows.where("source = 'api'").join(merged, ["cik", "axis", "period_end"], "left")
           .withColumn("canonical", F.coalesce("canonical", "period_end")))
    bulk = rows.where("source = 'bulk'")
    grid = api.select("cik", "axis", "qtrs", F.col("canonical").alias("period_end")).distinct()
    snapped = bulk.join(snap_dates(bulk, grid), ["cik", "axis", "qtrs", "period_end"])
    return api.unionByName(snapped)


def absent_tags(dated: DataFrame) -> DataFrame:
    """(cik, period_end, tag) a filing shows to be absent: it covers two or more instants and tags others of them."""
    inst = dated.where("qtrs = 0").select("cik", "accession", "tag", "canonical")
    filing = inst.groupBy("cik", "accession").agg(F.collect_set("canonical").alias("dates")).where(F.size("dates") >= 2)
    tagged = inst.groupBy("cik", "accession", "tag").agg(F.collect_set("canonical").alias("tag_dates"))
    return (tagged.join(filing, ["cik", "accession"])
            .select("cik", "tag", F.explode(F.array_except("dates", "tag_dates")).alias("period_end"))
            .distinct().select("cik", "period_end", "tag"))
