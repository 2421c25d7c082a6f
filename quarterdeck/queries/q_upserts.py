"""Upserts, change detection and result writes (K, U1)."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarterdeck.config import INGEST
from quarterdeck.operators import changes, upsert
from quarterdeck.plans import scoring
from quarterdeck.queries.adapter import AS_OF
from quarterdeck.queries.common import DAY, ORACLE, full
from quarterdeck.queries.registry import query
from quarterdeck.tags import TRACKED_TAGS

FACT_COLUMNS = "cik, tag, period_end, qtrs, form, value, filed_date, accession, source"
ORACLE["o_latest"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik, tag, period_end, qtrs, form
  ORDER BY filed_date DESC, source = 'api' DESC, load_seq) AS rn FROM a_facts) x WHERE rn = 1"""


@query("K1_fact_upsert", f"SELECT {FACT_COLUMNS} FROM o_latest")
def k1(t):
    return upsert.latest_facts(t.a_facts).select(*FACT_COLUMNS.split(", "))


@query("K1_fact_upsert_batch", f"""SELECT {FACT_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY cik, tag, period_end, qtrs, form
  ORDER BY filed_date DESC, source = 'api' DESC, load_seq < 20 DESC, load_seq) AS rn FROM a_facts) x WHERE rn = 1""")
def k1b(t):
    stored = upsert.latest_facts(t.a_facts.where("load_seq < 20"))
    return upsert.upsert_facts(stored, t.a_facts.where("load_seq >= 20")).select(*FACT_COLUMNS.split(", "))


def _stored(t):
    return t.a_company.where("cik % 3 <> 1").withColumn("name", F.lower("name"))


def _batch(t):
    return t.a_company.where("cik % 2 = 0 OR cik % 3 = 1").drop("is_active", "first_seen", "last_updated")


@query("K2_company_upsert", """
SELECT coalesce(b.cik, s.cik) AS cik, CASE WHEN b.cik IS NOT NULL THEN b.name ELSE lower(s.name) END AS name, b.cik IS NOT NULL OR s.is_active AS is_active,
       coalesce(s.first_seen, DATE '2001-11-15') AS first_seen, CASE WHEN b.cik IS NOT NULL THEN DATE '2001-11-15' ELSE s.last_updated END AS last_updated
FROM (SELECT * FROM a_company WHERE cik % 3 <> 1) s FULL JOIN (SELECT * FROM a_company WHERE cik % 2 = 0 OR cik % 3 = 1) b ON b.cik = s.cik""")
def k2(t):
    out = upsert.upsert_companies(_stored(t), _batch(t), F.lit(AS_OF).cast("date"))
    return out.select("cik", "name", "is_active", "first_seen", "last_updated")


@query("K3_listing_upsert", """
SELECT ticker, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 <> 0 THEN 'OLD' ELSE exchange END AS exchange, security_name FROM a_listing""")
def k3(t):
    cols = ["ticker", "exchange", "security_name"]
    stored = t.a_listing.where("p_partkey % 2 = 0").withColumn("exchange", F.lit("OLD")).select(*cols)
    return upsert.upsert_by_key(stored, t.a_listing.where("p_partkey % 3 = 0 OR p_partkey % 2 = 1").select(*cols), ["ticker"])


@query("K4_replace_classification", """
SELECT cik, CASE WHEN cik % 2 = 0 THEN 'moved' ELSE industry_slug END AS industry_slug, theme_slug, source FROM a_ci""")
def k4(t):
    batch = t.a_ci.where("cik % 2 = 0").withColumn("industry_slug", F.lit("moved"))
    return upsert.replace_group(t.a_ci, batch, ["cik"])


ORACLE["o_retired"] = "SELECT cik, ticker FROM a_company WHERE is_active AND cik % 7 = 2"


def _retired(t):
    return upsert.retire(t.a_company, t.a_ci, t.a_company.where("cik % 7 = 2").select("cik"), F.lit(AS_OF).cast("date"))


@query("K5_retire_companies", """
SELECT cik, is_active AND cik % 7 <> 2 AS is_active, CASE WHEN is_active AND cik % 7 = 2 THEN DATE '2001-11-15' ELSE last_updated END AS last_updated FROM a_company""")
def k5(t):
    return _retired(t)[0].select("cik", "is_active", "last_updated")


@query("K5_retired_classification", "SELECT cik, industry_slug FROM a_ci WHERE cik NOT IN (SELECT cik FROM o_retired)")
def k5b(t):
    return _retired(t)[1].select("cik", "industry_slug")


@query("K5_retired_tickers", "SELECT ticker FROM o_retired")
def k5c(t):
    return _retired(t)[2]


@query("K6_replace_periods", """
SELECT cik, period_end, CASE WHEN cik % 4 = 0 THEN revenue + 1 ELSE revenue END AS revenue FROM a_q WHERE NOT (cik % 4 = 0 AND quarter(period_end) = 3)""")
def k6(t):
    stored = t.a_q.select("cik", "period_end", "revenue")
    batch = stored.where("cik % 4 = 0 AND quarter(period_end) <> 3").withColumn("revenue", F.col("revenue") + 1)
    return upsert.replace_group(stored, batch, ["cik"])


@query("K7_market_upsert", """
SELECT cik, date, price FROM (SELECT *, row_number() OVER (PARTITION BY cik, date ORDER BY event_id DESC) AS rn FROM a_quotes) x WHERE rn = 1""")
def k7(t):
    return upsert.upsert_market(t.a_quotes.select("cik", "date", "price", F.col("event_id").alias("load_seq"))).select("cik", "date", "price")


_SCORES, _VALUES = scoring.engine_versions()


@query("K8_scores_with_version", f"""SELECT c.cik, {DAY} AS as_of, round(t.score, 6) AS score, round(t.completeness, 6) AS completeness, c.category, '{_SCORES}' AS engine_version
  FROM o_category c LEFT JOIN o_total t ON t.cik = c.cik""")
def k8(t):
    return scoring.outputs(scoring.evaluate(full(t)), AS_OF)["scores"].withColumns({c: F.round(c, 6) for c in ("score", "completeness")})


@query("K9_valuations", f"""SELECT f.cik, {DAY} AS as_of, CASE WHEN f.reason IS NULL THEN 'OK' ELSE 'INSUFFICIENT_DATA' END AS fair_value_status, f.reason AS fair_value_reason,
  round(f.per_share, 4) AS fair_value_per_share, round(CASE WHEN f.reason IS NULL THEN f.x5 END, 6) AS implied_revenue_multiple, p.status AS price_status, round(p.ratio, 4) AS price_ratio,
  round(p.safety, 4) AS margin_of_safety, p.valuation_status, m.signal AS moat_signal, m.periods_evaluated AS moat_periods_evaluated, m.periods_clearing AS moat_periods_clearing,
  m.reason AS moat_reason, round(u.score, 6) AS uncertainty_score,
  CASE WHEN u.score >= 0.75 THEN 'SEVERE' WHEN u.score >= 0.5 THEN 'ELEVATED' WHEN u.score >= 0.25 THEN 'MODERATE' ELSE 'MINIMAL' END AS uncertainty_level, '{_VALUES}' AS engine_version
  FROM o_fair f JOIN o_price p ON p.cik = f.cik JOIN o_moat m ON m.cik = f.cik JOIN o_unc u ON u.cik = f.cik""")
def k9(t):
    rows = scoring.outputs(scoring.evaluate(full(t)), AS_OF)["valuations"]
    rows = rows.withColumn("implied_revenue_multiple", F.round("assumptions.implied_revenue_multiple", 6)).drop("assumptions", "moat_evidence", "uncertainty_drivers")
    return rows.withColumns({c: F.round(c, n) for c, n in (("fair_value_per_share", 4), ("price_ratio", 4), ("margin_of_safety", 4), ("uncertainty_score", 6))})


FINGER = f"substr(sha256(array_to_string(list_sort({TRACKED_TAGS!r}), chr(10))), 1, 16)"
ORACLE["o_member"] = "SELECT c.cik, c.ticker FROM a_company c JOIN a_ci ci ON ci.cik = c.cik WHERE c.is_active"
ORACLE["o_state"] = f"""SELECT cik, CASE WHEN cik % 4 = 0 THEN 'old' WHEN cik % 4 = 1 OR cik % 5 = 2 THEN NULL ELSE {FINGER} END AS tags_fingerprint,
  DATE '2001-01-01' AS updated_at FROM a_company"""
# one company in 17 has facts without a filing date and none from the api, one in 6 filed a year earlier
COVERED = ["cik", "CASE WHEN cik % 17 = 2 THEN NULL WHEN cik % 6 = 1 THEN filed_date - 365 ELSE filed_date END AS filed_date", "CASE WHEN cik % 17 = 2 THEN 'bulk' ELSE source END AS source"]
ORACLE["o_cover"] = f"""SELECT cik, max(filed_date) AS latest, max(filed_date) FILTER (source = 'api') AS api_latest,
  count(*) FILTER (source = 'api') AS api_facts FROM (SELECT {', '.join(COVERED)} FROM a_facts) x GROUP BY cik"""


def members(t):
    return changes.universe(t.a_company, t.a_ci)


def cover(t):
    return changes.coverage(t.a_facts.selectExpr(*COVERED))


def state(t):
    return t.a_company.select("cik", F.when(F.expr("cik % 4 = 0"), "old").when(F.expr("cik % 4 = 1 OR cik % 5 = 2"), None)
                                                    .otherwise(changes.fingerprint()).alias("tags_fingerprint"), F.lit("2001-01-01").cast("date").alias("updated_at"))


@query("K10_tag_state_upsert", f"""
SELECT cik, tags_fingerprint, updated_at FROM o_state WHERE cik % 6 <> 1 UNION ALL
SELECT cik, {FINGER}, {DAY} FROM a_company WHERE cik % 6 = 1""")
def k10(t):
    fetched = t.a_company.where("cik % 6 = 1").select("cik", changes.fingerprint().alias("tags_fingerprint"), F.lit(AS_OF).cast("date").alias("updated_at"))
    return upsert.upsert_by_key(state(t), fetched, ["cik"])


@query("K11_taxonomy_upsert", "SELECT slug, theme_slug, CASE WHEN tam_usd IS NULL THEN name ELSE upper(name) || ' (sized)' END AS name FROM a_industry")
def k11(t):
    stored = t.a_industry.select("slug", "theme_slug", "name")
    batch = t.a_industry.where("tam_usd IS NOT NULL").select("slug", "theme_slug", F.concat(F.upper("name"), F.lit(" (sized)")).alias("name"))
    return upsert.upsert_by_key(stored, batch, ["slug"])


@query("K12_run_stats", """
SELECT 'fundamentals' AS job, 'succeeded' AS status, true AS ordered, NULL AS error, count(*) AS facts, count(DISTINCT cik) AS companies, count(*) FILTER (source = 'api') AS api_facts FROM a_facts
UNION ALL SELECT 'scores', 'failed', true, 'ValueError: stopped on purpose', NULL, count(*), NULL FROM a_company""")
def k12(t):
    from quarterdeck.operators.checkpoint import new_path
    from quarterdeck.plans.writes import recorded, runs
    log = new_path(t.spark, "runs")
    with recorded(t.spark, "fundamentals", log) as run:
        facts = run.staged(t.a_facts.select("cik", "source"), facts=F.count(F.lit(1)), api_facts=F.count_if(F.col("source") == "api"))
        run.stats["companies"] = facts.select("cik").distinct().count()
    try:
        with recorded(t.spark, "scores", log) as run:
            run.stats["companies"] = t.a_company.count()
            raise ValueError("stopped on purpose")
    except ValueError:
        pass
    number = lambda k: F.col("stats")[k].cast("long").alias(k)
    return runs(t.spark.read.parquet(log)).select("job", "status", (F.col("started_at") <= F.col("finished_at")).alias("ordered"), "error", number("facts"), number("companies"), number("api_facts"))


CUT = f"({DAY} - {INGEST['stale_days']})"


@query("K13_stale", f"SELECT m.cik FROM o_member m LEFT JOIN o_cover f ON f.cik = m.cik WHERE f.latest IS NULL OR f.latest < {CUT}")
def k13(t):
    return changes.stale(members(t), cover(t), AS_OF)


@query("K14_api_stale", f"SELECT m.cik FROM o_member m LEFT JOIN o_cover f ON f.cik = m.cik WHERE f.api_latest IS NULL OR f.api_latest < {CUT}")
def k14(t):
    return changes.stale(members(t), cover(t), AS_OF, "api_latest")


@query("K15_thin_coverage", "SELECT m.cik FROM o_member m JOIN o_cover f ON f.cik = m.cik WHERE f.api_facts < 560")
def k15(t):
    return changes.thin(members(t), cover(t), 560)


@query("K16_tag_set_changed", f"SELECT m.cik FROM o_member m LEFT JOIN o_state s ON s.cik = m.cik WHERE s.tags_fingerprint IS NULL OR s.tags_fingerprint <> {FINGER}")
def k16(t):
    return changes.tag_set_changed(members(t), state(t), changes.fingerprint())


ORACLE["o_nets"] = f"""
SELECT m.cik, concat_ws(',', CASE WHEN f.latest IS NULL OR f.latest < {CUT} THEN 'stale' END, CASE WHEN f.api_latest IS NULL OR f.api_latest < {CUT} THEN 'api_stale' END,
  CASE WHEN f.api_facts < 560 THEN 'thin' END, CASE WHEN s.tags_fingerprint IS NULL OR s.tags_fingerprint <> {FINGER} THEN 'tag_set' END) AS nets
FROM o_member m LEFT JOIN o_cover f ON f.cik = m.cik LEFT JOIN o_state s ON s.cik = m.cik"""


def plan(t):
    return changes.refetch_plan(members(t), cover(t), state(t), AS_OF, changes.fingerprint(), 560)


@query("K17_refetch_plan", "SELECT cik, nets FROM o_nets WHERE nets <> ''")
def k17(t):
    return plan(t).select("cik", F.concat_ws(",", "nets").alias("nets"))


@query("K17_refetch_counts", "SELECT net, count(*) AS companies FROM (SELECT unnest(string_split(nets, ',')) AS net FROM o_nets WHERE nets <> '') x GROUP BY net")
def k17b(t):
    return plan(t).select(F.explode("nets").alias("net")).groupBy("net").agg(F.count(F.lit(1)).alias("companies"))


@query("U1_refetch_union", "SELECT cik FROM o_nets WHERE nets <> ''")
def u1(t):
    m, c = members(t), cover(t)
    nets = [changes.stale(m, c, AS_OF), changes.stale(m, c, AS_OF, "api_latest"), changes.thin(m, c, 560), changes.tag_set_changed(m, state(t), changes.fingerprint())]
    out = nets[0]
    for n in nets[1:]:
        out = out.union(n)
    return out.distinct()


@query("K18_tag_fingerprint", "SELECT substr(sha256(string_agg(tag, chr(10) ORDER BY tag)), 1, 16) AS fingerprint FROM (SELECT DISTINCT tag FROM a_facts) x")
def k18(t):
    return changes.fingerprint_of(t.a_facts)


# facts of some companies lose their value, others have no tracked fact left
_HURT = """SELECT *, CASE WHEN cik % 7 = 3 THEN 'Untracked' ELSE tag END AS given_tag, CASE WHEN cik % 9 = 4 AND tag = 'Revenues' AND quarter(period_end) = 2 THEN CAST('NaN' AS DOUBLE) ELSE value END AS given FROM a_facts"""
ORACLE["o_outcome"] = """
SELECT m.cik, CASE WHEN m.cik % 7 <> 3 AND m.cik % 9 = 4 AND h.cik IS NOT NULL THEN 'failed' WHEN n.rows > 0 AND m.cik % 7 <> 3 THEN 'periods' ELSE 'no_data' END AS status,
  CASE WHEN m.cik % 7 <> 3 AND m.cik % 9 = 4 AND h.cik IS NOT NULL THEN 'fact without a finite value of Revenues' END AS reason,
  CASE WHEN m.cik % 7 = 3 OR (m.cik % 9 = 4 AND h.cik IS NOT NULL) THEN 0 ELSE coalesce(n.rows, 0) END AS rows
FROM o_member m LEFT JOIN (SELECT DISTINCT cik FROM a_facts WHERE tag = 'Revenues' AND quarter(period_end) = 2) h ON h.cik = m.cik
LEFT JOIN (SELECT cik, count(*) AS rows FROM o_norm WHERE period_type <> 'TTM' GROUP BY cik) n ON n.cik = m.cik"""


def outcomes(t):
    from quarterdeck.plans import normalize as norm
    log = t.sql(_HURT).withColumns({"value": F.col("given"), "tag": F.col("given_tag")}).drop("given", "given_tag")
    return norm.outcomes(members(t), norm.normalize(log))


@query("K20_outcomes", "SELECT cik, status, reason, rows FROM o_outcome")
def k20_outcomes(t):
    return outcomes(t).select("cik", "status", "reason", "rows")


@query("K20_failure_gate", "SELECT count(*) AS companies, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'failed')::DOUBLE / count(*) > 0.5 AND count(*) >= 20 AS stop FROM o_outcome")
def k20(t):
    from quarterdeck.plans.normalize import failure_gate
    return failure_gate(outcomes(t))



