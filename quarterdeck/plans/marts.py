"""Serving tables: opportunity map, industry table, stock detail, top candidates, freshness."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quarterdeck.config import SCORING, STALENESS
from quarterdeck.functions.scalars import finite, ratio, staleness, sufficient, yoy
from quarterdeck.operators.distribution import median
from quarterdeck.operators.periods import DERIVED
from quarterdeck.operators.pick import best_row, first_rows

C = F.col
MIN = SCORING["min_completeness"]


def dimension_chain(companies, classification, industries, themes) -> DataFrame:
    """Companies whose industry and theme both exist."""
    dims = (industries.select(C("slug").alias("industry_slug"), C("name").alias("industry_name"), C("theme_slug").alias("_theme"))
            .join(themes.select(C("slug").alias("_theme"), C("name").alias("theme_name")), "_theme"))
    return companies.join(classification.select("cik", "industry_slug", C("source").alias("classification_source")), "cik").join(dims, "industry_slug").drop("_theme")


def theme_lists(themes, industries) -> DataFrame:
    """Every theme with its industries, an empty list when it has none. Both tables are small dimensions."""
    lists = industries.groupBy("theme_slug").agg(F.array_sort(F.collect_list("slug")).alias("industries"))
    return themes.join(lists, themes.slug == lists.theme_slug, "left").select(
        "slug", "name", "display_order", F.coalesce("industries", F.array().cast("array<string>")).alias("industries"))


def flag_count(severity: str) -> Column:
    return F.size(F.filter("flags", lambda f: f["severity"] == severity)).cast("long")


def newest(sources: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """One row with the newest value of each (table, column); each table sends one value."""
    parts = [df.agg(F.max(c).cast("string").alias("value")).withColumn("name", F.lit(n)) for n, (df, c) in sources.items()]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.agg(*[F.max(F.when(C("name") == n, C("value"))).cast("date").alias(n) for n in sources])


def outcome_counts(rows: DataFrame, outcome: str, subject: str, sample: int = 10) -> DataFrame:
    """How many of each outcome, with the first few subjects."""
    counts = rows.groupBy(outcome).agg(F.count(F.lit(1)).alias("n"))
    few = first_rows(rows.select(outcome, subject), [outcome], [C(subject)], sample).groupBy(outcome).agg(F.array_sort(F.collect_list(subject)).alias("sample"))
    return counts.join(few, outcome, "left")


def latest_scores(scores: DataFrame) -> DataFrame:
    """Newest row per company."""
    return best_row(scores, ["cik"], [C("as_of")])


def company_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """Active classified companies with their latest score, market cap, growth, acceleration and flag counts.

    A company that was never scored stays, with NULLs and zero flags. ``tables`` holds companies, company_industry,
    market_data, scores, score_factors and red_flags.
    """
    scores = latest_scores(tables["scores"]).select("cik", "as_of", "score", "completeness", "category")
    caps = tables["market_data"].groupBy("cik").agg(F.max_by("market_cap", "date").alias("market_cap"))
    raw = lambda k: F.max(F.when(C("factor_key") == k, C("raw")))
    factors = tables["score_factors"].where(C("factor_key").isin("revenue_growth", "revenue_acceleration")).groupBy("cik", "as_of").agg(
        raw("revenue_growth").alias("revenue_growth"), raw("revenue_acceleration").alias("acceleration"))
    flags = tables["red_flags"].groupBy("cik", "as_of").agg(F.count_if(C("severity") == "CRITICAL").alias("critical_count"),
                                                            F.count_if(C("severity") == "WARNING").alias("warning_count"))
    return (tables["companies"].where("is_active").select("cik", "ticker", "name")
            .join(tables["company_industry"].select("cik", "industry_slug"), "cik").join(scores, "cik", "left").join(caps, "cik", "left")
            .join(factors, ["cik", "as_of"], "left").join(flags, ["cik", "as_of"], "left")
            .na.fill(0, ["critical_count", "warning_count"]))


def candidates(rows: DataFrame) -> DataFrame:
    """T1 predicate: scored on enough data, and not a leader."""
    return rows.where(C("score").isNotNull() & ~C("category").eqNullSafe("LEADER") & sufficient("completeness", MIN))


def industry_rows(rows: DataFrame) -> DataFrame:
    """One row per industry."""
    ok = sufficient("completeness", MIN) & finite("score")
    base = rows.groupBy("industry_slug").agg(
        F.count(F.lit(1)).alias("candidate_count"), F.avg(F.when(ok, C("score"))).alias("avg_score"),
        (F.count_if(C("critical_count") > 0) / F.count(F.lit(1))).alias("risk_ratio"))
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), C(c).alias("value")) for k, c in
                      [("median_revenue_growth", "revenue_growth"), ("median_market_cap", "market_cap"), ("momentum", "acceleration")]])
    long = rows.select("industry_slug", F.explode(pairs).alias("p")).select("industry_slug", "p.key", "p.value")
    meds = median(long, ["industry_slug", "key"], "value").groupBy("industry_slug").agg(
        *[F.max(F.when(C("key") == k, C("median"))).alias(k) for k in ("median_revenue_growth", "median_market_cap", "momentum")])
    best = candidates(rows).groupBy("industry_slug").agg(F.max_by(F.struct("ticker", "score"), F.struct("score", -C("cik"))).alias("_top")).select(
        "industry_slug", C("_top.ticker").alias("top_ticker"), C("_top.score").alias("top_score"))
    return base.join(meds, "industry_slug", "left").join(best, "industry_slug", "left")


def opportunity_map(rows: DataFrame, industries: DataFrame, themes: DataFrame) -> DataFrame:
    """Themes with their industries; those without one stay. `in_map_order` puts it in the order it is shown in."""
    named = industries.select(C("slug").alias("industry_slug"), C("name").alias("industry_name"), "theme_slug").join(industry_rows(rows), "industry_slug")
    heads = themes.select(C("slug").alias("theme_slug"), C("name").alias("theme_name"), "display_order")
    return heads.join(named, "theme_slug", "left")


def in_map_order(rows: DataFrame) -> DataFrame:
    """T4: themes in display order, their industries by average score."""
    return rows.orderBy("display_order", F.coalesce("avg_score", F.lit(-1.0)).desc(), "industry_slug")


GROUPS = ["LEADER", "CHALLENGER", "EMERGING", "INSUFFICIENT", "UNSCORED"]


def industry_table(rows: DataFrame, ttm: DataFrame) -> DataFrame:
    """Members of every industry in groups, with what they are ordered by: score, or market cap for unscored ones. `in_table_order` sorts them."""
    latest = best_row(ttm.select("cik", "period_end", "revenue", "gross_profit", "fcf", "total_debt"), ["cik"], [C("period_end")])
    group = (F.when(C("category").isNull(), "UNSCORED").when(~sufficient("completeness", MIN), "INSUFFICIENT").otherwise(C("category")))
    order = F.when(C("group") == "UNSCORED", F.coalesce("market_cap", F.lit(-1.0))).otherwise(F.coalesce("score", F.lit(-1.0)))
    out = rows.join(latest, "cik", "left").withColumn("group", group).withColumn("group_rank", F.array_position(F.array(*[F.lit(g) for g in GROUPS]), C("group")).cast("int"))
    return out.withColumns({"gross_margin": ratio("gross_profit", "revenue"), "fcf_margin": ratio("fcf", "revenue"), "sort_value": order})


def in_table_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("industry_slug", "group_rank", C("sort_value").desc(), "cik")


def preview(table: DataFrame, n: int = 10) -> DataFrame:
    """The first rows of each group."""
    return first_rows(table, ["industry_slug", "group"], [C("sort_value").desc(), C("cik")], n)


def fills(factors: DataFrame) -> DataFrame:
    """T5: scored factors with how much of their weight they filled."""
    return factors.where("status = 'SCORED' AND points IS NOT NULL AND weight > 0").withColumn("fill", C("points") / C("weight"))


def _by_fill(factors: DataFrame) -> DataFrame:
    """Factors of a (cik, as_of) as an array, best fill first. There are nine at most."""
    item = F.struct((-C("fill")).alias("order"), C("factor_key").alias("key"), "fill", "detail")
    return fills(factors).groupBy("cik", "as_of").agg(F.array_sort(F.collect_list(item)).alias("ranked"))


def strengths(factors: DataFrame) -> DataFrame:
    """The k best and the k worst factors, worst first; k is at most three and the two lists never meet."""
    rows = _by_fill(factors).withColumn("k", F.least(F.lit(3), F.floor(F.size("ranked") / 2).cast("int")))
    keys = F.transform("ranked", lambda f: f["key"])
    return rows.select("cik", "as_of", F.slice(keys, F.lit(1), C("k")).alias("top"),
                       F.slice(F.reverse(keys), F.lit(1), C("k")).alias("bottom"))


RATIONALE_FACTORS, RATIONALE_LENGTH = 3, 140


def rationale(factors: DataFrame) -> DataFrame:
    """Evidence of the best-filled factors as one short text."""
    text = F.concat_ws(" · ", F.transform(F.slice("ranked", 1, RATIONALE_FACTORS), lambda f: f["detail"]))
    short = F.concat(F.rtrim(F.substring("text", 1, RATIONALE_LENGTH - 1)), F.lit("…"))
    return _by_fill(factors).withColumn("text", text).select(
        "cik", "as_of", F.when(F.length("text") > RATIONALE_LENGTH, short).otherwise(C("text")).alias("rationale"))


def top_candidates(rows: DataFrame, factors: DataFrame, n: int = 5) -> DataFrame:
    """The n best candidates. The cut comes first, so only their factors are joined."""
    best = candidates(rows).orderBy(C("score").desc(), "cik").limit(n)
    return best.join(rationale(factors), ["cik", "as_of"], "left").select(
        "cik", "ticker", "name", "industry_slug", "score", (C("critical_count") > 0).alias("has_critical"), "rationale").orderBy(C("score").desc(), "cik")


def headlines(industries: DataFrame) -> DataFrame:
    """Strongest industry by average score, fastest by median growth."""
    return industries.agg(F.max_by("industry_slug", F.when(C("avg_score").isNotNull(), F.struct("avg_score", "industry_slug"))).alias("strongest"),
                          F.max_by("industry_slug", F.when(C("median_revenue_growth").isNotNull(), F.struct("median_revenue_growth", "industry_slug"))).alias("fastest"))


ACCELERATION_QUARTERS = 8  # two growth rates of two quarters each, a year apart


def derived_marks(periods: DataFrame, factors: DataFrame) -> DataFrame:
    """Which shown values rest on differenced quarters. Positions are those of surviving rows; NULLs are never marked."""
    differenced = F.map_keys(F.map_filter("source_tags", lambda _, v: v == DERIVED)).alias("differenced")
    item = F.struct("period_end", "revenue", "gross_profit", "operating_income", "fcf", "cash", "total_debt", differenced)
    arr = lambda k: F.reverse(F.array_sort(F.collect_list(F.when(C("period_type") == k, item))))
    base = periods.where(C("period_type").isin("TTM", "Q")).groupBy("cik").agg(arr("TTM").alias("t"), arr("Q").alias("q"))
    raw = lambda k: F.max(F.when(C("factor_key") == k, C("raw")))
    shown = factors.groupBy("cik").agg(raw("revenue_growth").alias("g"), raw("revenue_acceleration").alias("x"))
    at = lambda i: F.get("t", F.lit(i))
    from_diff = lambda p, f: F.coalesce(F.array_contains(p["differenced"], f), F.lit(False))
    any_of = lambda *fs: reduce(lambda a, b: a | b, [from_diff(at(0), f) for f in fs])
    far = F.when(yoy(at(0)["revenue"], at(4)["revenue"]).isNotNull(), from_diff(at(4), "revenue")).otherwise(from_diff(at(12), "revenue"))
    now = at(0)
    marks = {
        "growth": C("g").isNotNull() & (from_diff(now, "revenue") | far),
        "acceleration": C("x").isNotNull() & F.exists(F.slice("q", 1, ACCELERATION_QUARTERS), lambda p: from_diff(p, "revenue")),
        "gross_margin": ratio(now["gross_profit"], now["revenue"]).isNotNull() & any_of("revenue", "gross_profit"),
        "operating_margin": ratio(now["operating_income"], now["revenue"]).isNotNull() & any_of("revenue", "operating_income"),
        "fcf_margin": ratio(now["fcf"], now["revenue"]).isNotNull() & any_of("revenue", "ocf", "capex"),
        "cash": now["cash"].isNotNull() & any_of("cash"), "total_debt": now["total_debt"].isNotNull() & any_of("total_debt"),
        "revenue": now["revenue"].isNotNull() & any_of("revenue"),
    }
    return base.join(shown, "cik", "left").select("cik", *[F.coalesce(m, F.lit(False)).alias(f"{k}_derived") for k, m in marks.items()])


def freshness(latest: DataFrame, as_of) -> DataFrame:
    """State of each dated input at a fixed date."""
    limits = {"price_date": "price_days", "financials_at": "financials_days", "score_as_of": "scores_days"}
    return latest.select("*", *[staleness(c, as_of, STALENESS[k]).alias(f"{c}_state") for c, k in limits.items()])


COMPANY_DETAIL = ["ticker", "name", "sic", "sic_description", "exchange", "fiscal_year_end", "state", "state_description"]
VALUATION_DETAIL = ["fair_value_status", "fair_value_reason", "fair_value_per_share", "assumptions", "price_status", "price_ratio", "margin_of_safety", "valuation_status", "moat_signal",
                    "moat_periods_evaluated", "moat_periods_clearing", "moat_reason", "moat_evidence", "uncertainty_level", "uncertainty_score", "uncertainty_drivers"]


def stock_detail(tables: dict[str, DataFrame], periods: DataFrame, as_of) -> DataFrame:
    """One row per company of the dimension chain, scored or not, with all that is stored about its newest score, valuation, price and year."""
    head = dimension_chain(tables["companies"].select("cik", *COMPANY_DETAIL), tables["company_industry"], tables["industries"], tables["themes"])
    scores = latest_scores(tables["scores"]).select("cik", C("as_of").alias("score_as_of"), "score", "completeness", "category", C("engine_version").alias("score_engine_version"))
    market = best_row(tables["market_data"].select("cik", "date", "price", "market_cap", "shares_basis"), ["cik"], [C("date")])
    fin = best_row(periods.where("period_type = 'TTM'").select("cik", "period_end", "revenue", "gross_profit", "operating_income", "fcf", "cash", "total_debt"),
                   ["cik"], [C("period_end")])
    values = best_row(tables["valuations"].select("cik", C("as_of").alias("valuation_as_of"), *VALUATION_DETAIL, C("engine_version").alias("valuation_engine_version")), ["cik"], [C("valuation_as_of")])
    factors = tables["score_factors"].groupBy("cik", "as_of").agg(F.array_sort(F.collect_list(
        F.struct((-C("weight")).alias("order"), "factor_key", "points", "raw", "status", "percentile", "detail"))).alias("factors"))
    flags = tables["red_flags"].groupBy("cik", "as_of").agg(F.array_sort(F.collect_list(F.struct("severity", "code"))).alias("flags"))
    keyed = ["cik", "score_as_of"]
    rows = (head.join(scores, "cik", "left").join(market, "cik", "left").join(fin, "cik", "left").join(values, "cik", "left")
            .join(factors.withColumnRenamed("as_of", "score_as_of"), keyed, "left").join(flags.withColumnRenamed("as_of", "score_as_of"), keyed, "left"))
    return rows.withColumns({"gross_margin": ratio("gross_profit", "revenue"), "operating_margin": ratio("operating_income", "revenue"),
                             "fcf_margin": ratio("fcf", "revenue"), "price_state": staleness("date", as_of, STALENESS["price_days"]),
                             "financials_state": staleness("period_end", as_of, STALENESS["financials_days"]),
                             "score_state": staleness("score_as_of", as_of, STALENESS["scores_days"])})


def register_views(tables: dict[str, DataFrame]) -> None:
    """The tables by name for spark.sql."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
