"""Quality rules: a decision list learned by sequential covering.

Each rule is a conjunction of thresholds that rejects. It grows on two thirds of the labelled rows by FOIL gain, is pruned on the rest, and
the rows it covers are set aside before the next rule is sought. All statistics are Spark aggregations over every labelled row; the driver
sees only counts by (feature, bin). The learned list is emitted as one ordered conditional expression.

Defined results: a null text has no words and fails the base rules; an empty table gives no rows; without labels of both kinds the list is
empty and only the base rules reject; repeated rows are judged alike; labels without a value are ignored and several labels of one document
count each; columns of the input named like a statistic are replaced.
"""
from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import staged
from .textstats import ratios, with_stats

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Settings:
    """bins: thresholds tried per feature. longest: conditions of a rule. precision: least share of rejected labels among what a pruned rule covers."""

    bins: int = 32
    longest: int = 3
    rules: int = 16
    precision: float = 0.9
    support: int = 5


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.feature) > F.lit(self.cut) if self.above else F.col(self.feature) <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass
class DecisionList:
    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def rule(self) -> Column:
        """The position of the first rule that covers a row, 0 if none does, as one ordered conditional."""
        out = None
        for k, conditions in enumerate(self.rules, 1):
            out = (F if out is None else out).when(all_of(conditions), F.lit(k))
        return F.lit(0) if out is None else out.otherwise(F.lit(0))


def all_of(conditions: tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


def features() -> dict[str, Column]:
    repeat = F.when(F.col("n_words") > 0, F.col("n_repeat_words") / F.col("n_words")).otherwise(F.lit(0.0))
    return ratios("f_") | {"f_repeat": repeat.cast("double")}


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    return with_stats(docs, text).withColumns(features())


def learn(labelled: DataFrame, names: list[str], settings: Settings = Settings()) -> DecisionList:
    """`labelled`: one row per labelled document with the features and `reject` (boolean). Thresholds are quantiles over all rows."""
    at = [k / settings.bins for k in range(1, settings.bins)]
    first = labelled.agg(F.count(F.when(F.col("reject"), 1)).alias("bad"), F.count(F.when(~F.col("reject"), 1)).alias("good"),
                         *[F.percentile_approx(f, at, 2000).alias(f) for f in names]).first()
    if not first["bad"] or not first["good"]:
        return DecisionList()
    cuts = {f: sorted(set(first[f])) for f in names}
    binned = F.array(*[F.struct(F.lit(f).alias("feature"), bin_of(f, cuts[f]).alias("bin")) for f in names])
    rows = labelled.withColumn("bins", binned)
    out = DecisionList()
    while len(out.rules) < settings.rules:
        left = rows.filter(out.rule() == 0)
        grown = grow(left.filter("grow"), cuts, settings)
        pruned = prune(left.filter("not grow"), grown, settings) if grown else ()
        if not pruned:
            break
        out.rules.append(pruned)
    return out


def bin_of(feature: str, cuts: list[float]) -> Column:
    """How many of the ascending cuts a value lies above."""
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: F.col(feature) > c))


def grow(rows: DataFrame, cuts: dict[str, list[float]], settings: Settings) -> tuple[Condition, ...]:
    rule: tuple[Condition, ...] = ()
    while len(rule) < settings.longest:
        counts = (rows.filter(all_of(rule)).select("reject", F.explode("bins").alias("b"))
                  .groupBy("b.feature", "b.bin").agg(F.count(F.when(F.col("reject"), 1)).alias("bad"), F.count("*").alias("all")).collect())
        best = best_condition(counts, cuts, settings)
        if best is None:
            break
        rule += (best[0],)
        if best[1]:
            break
    return rule


def best_condition(counts: list, cuts: dict[str, list[float]], settings: Settings) -> tuple[Condition, bool] | None:
    """The threshold of the largest FOIL gain, and whether what it leaves is all to be rejected. Bin k of a feature lies above its first k cuts."""
    tables: dict[str, dict[int, tuple[int, int]]] = {}
    for r in counts:
        tables.setdefault(r["feature"], {})[r["bin"]] = (r["bad"], r["all"] - r["bad"])
    best: tuple[float, Condition, bool] | None = None
    for feature in sorted(tables):
        table = tables[feature]
        bad, good = (sum(x[i] for x in table.values()) for i in (0, 1))
        if not bad or not good:
            return None
        was = math.log2(bad / (bad + good))
        low_bad = low_good = 0
        for k, cut in enumerate(cuts[feature]):
            here = table.get(k, (0, 0))
            low_bad, low_good = low_bad + here[0], low_good + here[1]
            for above, b, g in ((False, low_bad, low_good), (True, bad - low_bad, good - low_good)):
                if b < settings.support or (b, g) == (bad, good):
                    continue
                gain = b * (math.log2(b / (b + g)) - was)
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, Condition(feature, above, float(cut)), g == 0)
    return None if best is None else best[1:]


def prune(rows: DataFrame, rule: tuple[Condition, ...], settings: Settings) -> tuple[Condition, ...]:
    """The prefix of the rule with the best (bad - good) / (bad + good) on rows that it didn't grow on; nothing if too few of them are bad."""
    prefixes = [rule[:k] for k in range(1, len(rule) + 1)]
    seen = rows.agg(*[F.count(F.when(all_of(p) & w, 1)).alias(f"{n}{k}") for k, p in enumerate(prefixes) for n, w in (("bad", F.col("reject")), ("all", F.lit(True)))]).first()
    scored = [(2 * seen[f"bad{k}"] / seen[f"all{k}"] - 1, -k) for k in range(len(prefixes)) if seen[f"bad{k}"] >= settings.support]
    if not scored or (1 + max(scored)[0]) / 2 < settings.precision:
        return ()
    return prefixes[-max(scored)[1]]


def labelled_rows(stats: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    names = list(features())
    marks = labels.filter(F.col("quality").isNotNull()).select(F.col(key).alias("__key"), (F.col("quality") == 0).alias("reject"))
    rows = stats.select(F.col(key).alias("__key"), *names).join(marks, "__key")
    return rows.withColumn("grow", F.pmod(F.crc32(F.concat(F.lit("grow"), F.col("__key").cast("string"))), F.lit(3)) != 0)


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", settings: Settings = Settings(), carry: list[str] | None = None) -> tuple[DataFrame, DecisionList]:
    """One row per document: `carry` columns (all by default), the statistics, base_failed, rule (number of the rejecting rule) and kept."""
    carried = docs.columns if carry is None else carry
    clash = {*features(), *BASE, "n_chars_all", "n_upper", "n_marks", "n_digits", "n_lines", "n_distinct", "base_failed", "rule", "kept"}
    plain = docs.select(*[F.col(c).alias(f"__in_{c}" if c in clash else c) for c in dict.fromkeys([*carried, "doc_id", text])])
    stats = staged(with_features(plain, text).select(*[c for c in plain.columns if c != text or text in carried], *BASE, *features()), "op1-stats")
    rules = learn(staged(labelled_rows(stats, labels), "op1-labelled"), list(features()), settings)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = stats.withColumn("base_failed", failed).withColumn("rule", rules.rule()).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
    return judged.drop(*features()), rules
