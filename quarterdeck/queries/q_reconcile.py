"""Reconciliation of facts: near dates, one value, as-of, differencing (J10-J12, W5-W7, U3, U4, R)."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from quarterdeck import tags as tg
from quarterdeck.config import FLOW_FIELDS, PERIOD_FIELDS
from quarterdeck.functions.lineitems import flow_lines
from quarterdeck.operators import carry, dates, facts as fo, ytd
from quarterdeck.operators.checkpoint import co_partitioned, cut, cut_by
from quarterdeck.operators.upsert import latest_facts
from quarterdeck.plans import normalize as norm
from quarterdeck.queries.common import ORACLE
from quarterdeck.queries.registry import query

# ---- near dates -------------------------------------------------------------------------------------------------
ORACLE["o_api"] = "SELECT *, CASE WHEN qtrs = 0 THEN 'instant' ELSE 'duration' END AS axis FROM o_latest WHERE source = 'api'"
ORACLE["o_pairs"] = """
SELECT DISTINCT x.cik, 'instant' AS axis, x.period_end AS a, y.period_end AS b FROM o_api x JOIN o_api y ON y.cik = x.cik AND x.qtrs = 0 AND y.qtrs = 0
  AND y.period_end - x.period_end BETWEEN 1 AND 20 UNION
SELECT DISTINCT x.cik, 'duration', x.period_end, y.period_end FROM (SELECT DISTINCT cik, qtrs, period_start, period_end FROM o_api WHERE qtrs > 0) x
  JOIN (SELECT DISTINCT cik, qtrs, period_start, period_end FROM o_api WHERE qtrs > 0) y ON y.cik = x.cik AND y.qtrs = x.qtrs
  AND y.period_end - x.period_end BETWEEN 1 AND 20 AND abs(y.period_start - x.period_start) <= 20"""
ORACLE["o_api_value"] = f"""
SELECT cik, axis, period_end, qtrs, tag, arg_max(value, load_seq) AS value FROM o_api
WHERE tag NOT IN ({', '.join(repr(x) for x in tg.WEIGHTED_SHARE_TAGS)}) GROUP BY ALL"""
ORACLE["o_count"] = "SELECT cik, period_end, count(*) AS n FROM o_api GROUP BY ALL"
ORACLE["o_ev0"] = """
SELECT p.cik, p.axis, p.a, p.b, count(y.value) FILTER (abs(x.value - y.value) <= 0.005::DOUBLE * greatest(abs(x.value), abs(y.value), 1)) AS agree, count(y.value) AS seen
FROM o_pairs p LEFT JOIN o_api_value x ON x.cik = p.cik AND x.axis = p.axis AND x.period_end = p.a
LEFT JOIN o_api_value y ON y.cik = p.cik AND y.axis = p.axis AND y.period_end = p.b AND y.qtrs = x.qtrs AND y.tag = x.tag GROUP BY ALL"""
ORACLE["o_ev"] = """
SELECT e.cik, e.axis, e.a, e.b, agree, seen - agree AS disagree, ca.n AS n_a, cb.n AS n_b,
       CASE WHEN agree > seen - agree THEN true WHEN seen >= 2 THEN false WHEN seen = 1 AND e.axis = 'instant' THEN false
            ELSE least(ca.n, cb.n) BETWEEN 1 AND 3 AND greatest(ca.n, cb.n) >= 5 * least(ca.n, cb.n) END AS merge
FROM o_ev0 e JOIN o_count ca ON ca.cik = e.cik AND ca.period_end = e.a JOIN o_count cb ON cb.cik = e.cik AND cb.period_end = e.b"""
ORACLE["o_edge"] = "SELECT cik, axis, a, b FROM o_ev WHERE merge UNION SELECT cik, axis, b, a FROM o_ev WHERE merge"
ORACLE["o_reach"] = """
SELECT cik, axis, a AS d, a AS root FROM o_edge UNION SELECT r.cik, r.axis, e.b, r.root FROM o_reach r JOIN o_edge e ON e.cik = r.cik AND e.axis = r.axis AND e.a = r.d"""
ORACLE["o_cluster"] = """
SELECT cik, axis, d AS period_end, first_value(d) OVER (PARTITION BY cik, axis, cluster ORDER BY n DESC, d) AS canonical FROM (
  SELECT r.cik, r.axis, r.d, min(r.root) AS cluster, any_value(c.n) AS n FROM o_reach r JOIN o_count c ON c.cik = r.cik AND c.period_end = r.d GROUP BY r.cik, r.axis, r.d) x"""
ORACLE["o_api_dated"] = """
SELECT a.*, coalesce(c.canonical, a.period_end) AS canonical FROM o_api a LEFT JOIN o_cluster c ON c.cik = a.cik AND c.axis = a.axis AND c.period_end = a.period_end"""
ORACLE["o_target"] = "SELECT DISTINCT cik, axis, qtrs, canonical AS target FROM o_api_dated"
ORACLE["o_bulk"] = "SELECT *, CASE WHEN qtrs = 0 THEN 'instant' ELSE 'duration' END AS axis FROM o_latest WHERE source = 'bulk'"
ORACLE["o_snapped"] = """
SELECT cik, axis, qtrs, period_end, coalesce(target, period_end) AS canonical FROM (
  SELECT p.*, t.target, row_number() OVER (PARTITION BY p.cik, p.axis, p.qtrs, p.period_end
    ORDER BY t.target <> p.period_end, t.same DESC, abs(t.target - p.period_end), t.target) AS rn
  FROM (SELECT DISTINCT cik, axis, qtrs, period_end FROM o_bulk) p
  LEFT JOIN (SELECT x.cik, x.axis, x.target, q.qtrs AS probe, max(x.qtrs = q.qtrs) AS same FROM o_target x JOIN (SELECT DISTINCT cik, axis, qtrs FROM o_bulk) q ON q.cik = x.cik AND q.axis = x.axis GROUP BY ALL) t
    ON t.cik = p.cik AND t.axis = p.axis AND t.probe = p.qtrs AND abs(t.target - p.period_end) <= 20) x WHERE rn = 1"""
ORACLE["o_dated"] = """
SELECT cik, tag, qtrs, period_end, canonical, value, form, filed_date, accession, source, load_seq FROM o_api_dated UNION ALL
SELECT b.cik, b.tag, b.qtrs, b.period_end, s.canonical, value, form, filed_date, accession, source, load_seq
FROM o_bulk b JOIN o_snapped s ON s.cik = b.cik AND s.axis = b.axis AND s.qtrs = b.qtrs AND s.period_end = b.period_end"""
ORACLE["o_value"] = """
SELECT cik, qtrs, canonical AS period_end, tag, value, source FROM (
  SELECT *, row_number() OVER (PARTITION BY cik, qtrs, canonical, tag ORDER BY source = 'api' DESC, period_end = canonical DESC, filed_date DESC, load_seq, form DESC) AS rn
  FROM o_dated) x WHERE rn = 1"""
ORACLE["o_absent"] = """
SELECT DISTINCT t.cik, d.canonical AS period_end, t.tag FROM (SELECT DISTINCT cik, accession, tag FROM o_dated WHERE qtrs = 0) t
JOIN (SELECT DISTINCT cik, accession, canonical FROM o_dated WHERE qtrs = 0) d ON d.cik = t.cik AND d.accession = t.accession
WHERE NOT EXISTS (SELECT 1 FROM o_dated x WHERE x.qtrs = 0 AND x.cik = t.cik AND x.accession = t.accession AND x.tag = t.tag AND x.canonical = d.canonical)"""


def latest(t):
    return latest_facts(t.a_facts)


def dated(t):
    rows = cut(latest(t))
    with co_partitioned(t.spark):
        return cut_by(dates.canonical_dates(cut_by(rows), cut_by))


def values(t):
    d = dated(t)
    with co_partitioned(t.spark):
        return cut_by(fo.one_value(d))


@query("J12_date_pairs", "SELECT cik, axis, a, b FROM o_pairs")
def j12(t):
    return dates.date_pairs(latest(t))


@query("R1_pair_evidence", "SELECT cik, axis, a, b, agree, disagree, n_a, n_b, merge FROM o_ev")
def r1(t):
    return dates.pair_evidence(cut(latest(t)))


@query("R2_date_clusters", "SELECT cik, axis, period_end, canonical FROM o_cluster")
def r2(t):
    rows = cut(latest(t))
    return dates.clusters(dates.pair_evidence(rows), rows)


@query("J11_nearest_date", "SELECT cik, axis, qtrs, period_end, canonical FROM o_snapped")
def j11(t):
    rows = cut(latest(t).withColumn("axis", dates.axis()))
    api, bulk = rows.where("source = 'api'"), rows.where("source = 'bulk'")
    merged = dates.clusters(dates.pair_evidence(rows), rows)
    grid = api.join(merged, ["cik", "axis", "period_end"], "left").select("cik", "axis", "qtrs", F.coalesce("canonical", "period_end").alias("period_end")).distinct()
    return dates.snap_dates(bulk, grid)


@query("R3_canonical_dates", "SELECT cik, tag, qtrs, form, source, period_end, canonical FROM o_dated")
def r3(t):
    return dates.canonical_dates(cut(latest(t))).select("cik", "tag", "qtrs", "form", "source", "period_end", "canonical")


@query("R4_one_value", "SELECT cik, qtrs, period_end, tag, value, source FROM o_value")
def r4(t):
    return fo.one_value(dated(t))


@query("U4_api_first_overlay", """SELECT cik, qtrs, period_end, tag, value, source FROM (SELECT *, row_number() OVER (PARTITION BY cik, qtrs, period_end, tag
  ORDER BY source = 'api' DESC, filed_date DESC, load_seq, form DESC) AS rn FROM a_facts) x WHERE rn = 1""")
def u4(t):
    return fo.one_value(t.a_facts.withColumn("canonical", F.col("period_end")))


@query("W7_asserted_absence", "SELECT cik, period_end, tag FROM o_absent")
def w7(t):
    return dates.absent_tags(dated(t))


# ---- balance sheet as of ----------------------------------------------------------------------------------------
ORACLE["o_probe"] = "SELECT DISTINCT cik, period_end FROM o_value WHERE qtrs IN (1, 4)"
ORACLE["o_asof"] = """
SELECT cik, period_end, tag, d, value FROM (
  SELECT p.cik, p.period_end, v.tag, v.period_end AS d, v.value, row_number() OVER (PARTITION BY p.cik, p.period_end, v.tag ORDER BY v.period_end DESC) AS rn
  FROM o_probe p JOIN o_value v ON v.cik = p.cik AND v.qtrs = 0 AND v.period_end BETWEEN p.period_end - 400 AND p.period_end) x WHERE rn = 1"""
ORACLE["o_shape"] = "SELECT * FROM (VALUES " + ", ".join(f"('{g}', '{x}', '{f}', '{rg}')" for g, sh in carry.GROUPS.items() for x, (f, rg) in sh.items()) + ") v(grp, tag, family, region)"
ORACLE["o_grp0"] = "SELECT a.*, s.grp, s.family, s.region, max(d) OVER (PARTITION BY cik, period_end, s.grp) AS anchor FROM o_asof a JOIN o_shape s ON s.tag = a.tag"
_ANCH = "SELECT 1 FROM o_grp0 s WHERE s.cik = g.cik AND s.period_end = g.period_end AND s.grp = g.grp AND s.d = s.anchor"
ORACLE["o_use"] = f"""
SELECT g.cik, g.period_end, g.tag, g.d, g.value FROM o_grp0 g WHERE g.d = g.anchor OR NOT (
  EXISTS ({_ANCH} AND (s.family = g.family OR s.family = 'general' OR g.family = 'general') AND (s.region = g.region OR s.region = 'spanning' OR g.region = 'spanning'))
  OR EXISTS (SELECT 1 FROM o_absent b WHERE b.cik = g.cik AND b.period_end = g.anchor AND b.tag = g.tag)
  OR (g.grp = 'debt' AND g.region <> 'spanning' AND EXISTS ({_ANCH} AND s.region = g.region))
  OR (g.grp = 'debt' AND g.region = 'spanning' AND EXISTS ({_ANCH} AND s.region = 'noncurrent') AND EXISTS ({_ANCH} AND s.region = 'current'))
  OR EXISTS (SELECT 1 FROM o_grp0 s JOIN o_value v ON v.cik = s.cik AND v.tag = s.tag AND v.qtrs = 0 WHERE s.cik = g.cik AND s.period_end = g.period_end AND s.grp = g.grp
             AND s.d = s.anchor AND s.tag <> g.tag AND v.period_end = g.d AND abs(v.value - g.value) <= 0.005::DOUBLE * greatest(abs(v.value), abs(g.value), 1)))"""


def probes(v):
    return v.where("qtrs IN (1, 4)").select("cik", "period_end").distinct()


@query("J10_as_of_by_tag", f"SELECT cik, period_end, tag, d AS source_date, value FROM o_asof WHERE tag IN ({', '.join(repr(x) for x in tg.INSTANT_TAGS)})")
def j10(t):
    v = values(t)
    events = fo.wide(v.where("qtrs = 0"), ["cik", "period_end"], tg.INSTANT_TAGS)
    rows = carry.last_known(events, probes(v), ["cik"], "period_end", tg.INSTANT_TAGS)
    pairs = F.array(*[F.struct(F.lit(x).alias("tag"), F.col(f"{x}.date").alias("source_date"), F.col(f"{x}.value").alias("value")) for x in tg.INSTANT_TAGS])
    return rows.select("cik", "period_end", F.explode(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("p")).select("cik", "period_end", "p.*")


def carried(t):
    d = dated(t)
    with co_partitioned(t.spark):
        v = cut_by(fo.one_value(d))
        return cut_by(carry.carried(v, dates.absent_tags(d), probes(v)))


@query("R11_carry_forward", "SELECT cik, period_end, tag, value FROM o_use")
def r11(t):
    rows = carried(t)
    kept = {x: carry.usable(x, g) for g, shapes in carry.GROUPS.items() for x in shapes}
    rows = rows.select("cik", "period_end", *[c.alias(f"u_{x}") for x, c in kept.items()])
    pairs = F.array(*[F.struct(F.lit(x).alias("tag"), F.col(f"u_{x}").alias("value")) for x in kept])
    return rows.select("cik", "period_end", F.explode(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("p")).select("cik", "period_end", "p.*")


ORACLE["o_basic"] = f"""
SELECT cik, period_end, basic FROM (
  SELECT p.cik, p.period_end, b.basic, row_number() OVER (PARTITION BY p.cik, p.period_end ORDER BY b.period_end DESC, b.basic DESC) AS rn FROM o_probe p
  JOIN (SELECT cik, qtrs, period_end, coalesce(max(value) FILTER (tag = '{tg.BASIC_SHARES_CHAIN[0]}'), max(value) FILTER (tag = '{tg.BASIC_SHARES_CHAIN[1]}')) AS basic
        FROM o_value WHERE qtrs > 0 GROUP BY ALL) b ON b.cik = p.cik AND b.basic IS NOT NULL AND b.period_end BETWEEN p.period_end - 400 AND p.period_end) x WHERE rn = 1"""


@query("R12_basic_shares_as_of", "SELECT cik, period_end, basic FROM o_basic")
def r12(t):
    v = values(t)
    rows = carry.last_known(carry.basic_shares(v), probes(v), ["cik"], "period_end", ["basic"])
    return rows.where("basic IS NOT NULL").select("cik", "period_end", F.col("basic.value").alias("basic"))


_GUARDED = f"""
SELECT p.cik, p.period_end, CASE WHEN c.value > 0 AND b.basic > 0 AND c.value < 0.4 * b.basic AND b.basic <= 100 * c.value THEN NULL ELSE c.value END AS shares
FROM o_probe p LEFT JOIN o_asof c ON c.cik = p.cik AND c.period_end = p.period_end AND c.tag = '{tg.COVER_SHARES}' LEFT JOIN o_basic b ON b.cik = p.cik AND b.period_end = p.period_end"""


@query("R13_guarded_cover_shares", _GUARDED)
def r13(t):
    return carried(t).select("cik", "period_end", carry.guarded_shares(F.col(f"{tg.COVER_SHARES}.value"), F.col("basic.value")).alias("shares"))


# ---- differencing -----------------------------------------------------------------------------------------------
ORACLE["o_grid0"] = """
SELECT cik, period_end, CAST(row_number() OVER w - 1 AS INT) AS pos, coalesce(period_end - lag(period_end) OVER w BETWEEN 60 AND 120, false) AS adjacent
FROM (SELECT DISTINCT cik, period_end FROM o_value WHERE qtrs BETWEEN 1 AND 4) x WINDOW w AS (PARTITION BY cik ORDER BY period_end)"""
ORACLE["o_grid"] = "SELECT *, sum(adjacent::INT) OVER (PARTITION BY cik ORDER BY period_end) AS run FROM o_grid0"
ORACLE["o_flow_long"] = f"SELECT cik, qtrs, period_end, field, value FROM o_flow UNPIVOT (value FOR field IN ({', '.join(FLOW_FIELDS)})) WHERE qtrs BETWEEN 1 AND 4"
ORACLE["o_con"] = """
SELECT f.cik, f.field, s.pos AS lo, e.pos AS hi, f.qtrs AS span, f.value, f.period_end FROM o_flow_long f
JOIN o_grid e ON e.cik = f.cik AND e.period_end = f.period_end JOIN o_grid s ON s.cik = f.cik AND s.pos = e.pos - f.qtrs + 1
WHERE e.run - s.run = f.qtrs - 1 AND (f.qtrs = 1 OR abs((e.period_end - s.period_end) - (f.qtrs - 1) * 91.31::DOUBLE) <= 20)"""
ORACLE["o_multi"] = """
SELECT cik, field, lo, hi, sum(fresh) OVER (PARTITION BY cik, field ORDER BY lo, hi) AS island FROM (
  SELECT cik, field, lo, hi, CASE WHEN lo > coalesce(max(hi) OVER (PARTITION BY cik, field ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS fresh
  FROM o_con WHERE span >= 2) x"""
ORACLE["o_island"] = "SELECT cik, field, island, min(lo) AS from_pos, max(hi) AS to_pos FROM o_multi GROUP BY ALL"
ORACLE["o_num_con"] = """
SELECT c.*, i.from_pos, i.to_pos, max(abs(value)) OVER (PARTITION BY c.cik, c.field, i.from_pos) AS scale
FROM o_con c JOIN o_island i ON i.cik = c.cik AND i.field = c.field AND c.lo >= i.from_pos AND c.hi <= i.to_pos"""
ORACLE["o_found"] = """
SELECT cik, field, from_pos, hi AS pos, value, 0 AS prio, 1 AS ord FROM o_num_con WHERE lo = hi UNION ALL
SELECT a.cik, a.field, a.from_pos, a.hi, a.value - b.value, 1, a.span FROM o_num_con a JOIN o_num_con b ON b.cik = a.cik AND b.field = a.field AND b.from_pos = a.from_pos AND b.lo = a.lo AND b.hi = a.hi - 1 UNION ALL
SELECT a.cik, a.field, a.from_pos, a.lo, a.value - b.value, 2, a.span FROM o_num_con a JOIN o_num_con b ON b.cik = a.cik AND b.field = a.field AND b.from_pos = a.from_pos AND b.hi = a.hi AND b.lo = a.lo + 1"""
ORACLE["o_first"] = """
SELECT cik, field, from_pos, pos, arg_min(value, (prio, ord)) AS value, max(value) AS top, min(value) AS low FROM o_found GROUP BY ALL"""
ORACLE["o_rest"] = """
SELECT c.cik, c.field, c.from_pos, c.lo + c.span * (c.lo + c.hi) // 2 - c.lo - sum(f.pos) AS pos, c.value - sum(f.value) AS value, c.span
FROM o_num_con c JOIN o_first f ON f.cik = c.cik AND f.field = c.field AND f.from_pos = c.from_pos AND f.pos BETWEEN c.lo AND c.hi
GROUP BY c.cik, c.field, c.from_pos, c.lo, c.hi, c.value, c.span HAVING count(*) = c.span - 1"""
ORACLE["o_quarter"] = """
SELECT * FROM o_first UNION ALL
SELECT cik, field, from_pos, pos, arg_min(value, span), max(value), min(value) FROM o_rest GROUP BY cik, field, from_pos, pos"""
ORACLE["o_sound"] = """
SELECT i.cik, i.field, i.from_pos FROM o_island i JOIN (SELECT DISTINCT cik, field, from_pos, scale FROM o_num_con) s ON s.cik = i.cik AND s.field = i.field AND s.from_pos = i.from_pos
WHERE (SELECT count(*) FROM o_quarter q WHERE q.cik = i.cik AND q.field = i.field AND q.from_pos = i.from_pos AND q.top - q.low <= 0.005::DOUBLE * greatest(abs(q.top), abs(q.low), s.scale)) = i.to_pos - i.from_pos + 1
  AND NOT EXISTS (SELECT 1 FROM (SELECT c.value, c.scale, sum(q.value) AS total FROM o_num_con c JOIN o_quarter q ON q.cik = c.cik AND q.field = c.field AND q.from_pos = c.from_pos AND q.pos BETWEEN c.lo AND c.hi
     WHERE c.cik = i.cik AND c.field = i.field AND c.from_pos = i.from_pos GROUP BY c.lo, c.hi, c.value, c.scale) z WHERE abs(z.total - z.value) > 0.005::DOUBLE * greatest(abs(z.value), z.scale))"""


def flows(t, v=None):
    keys = ["cik", "qtrs", "period_end"]
    v = values(t) if v is None else v
    return flow_lines(fo.wide(v.where("qtrs <> 0"), keys, tg.FLOW_TAGS), keys)


def numbered(t):
    v = values(t)
    with co_partitioned(t.spark):
        return cut_by(ytd.islands(ytd.constraints(cut_by(flows(t, v)), ytd.fiscal_grid(v))))


@query("W5_fiscal_grid", "SELECT cik, period_end, pos, adjacent FROM o_grid0")
def w5(t):
    return ytd.fiscal_grid(values(t)).select("cik", "period_end", "pos", "adjacent")


@query("R5_span_constraints", "SELECT cik, field, lo, hi, span, value FROM o_con")
def r5(t):
    v = values(t)
    return ytd.constraints(flows(t, v), ytd.fiscal_grid(v)).drop("period_end")


@query("W6_islands", "SELECT cik, field, lo, hi, span, value, from_pos, to_pos FROM o_num_con")
def w6(t):
    return numbered(t).select("cik", "field", "lo", "hi", "span", "value", "from_pos", "to_pos")


@query("R6_consistent_quarters", "SELECT q.cik, q.field, CAST(q.pos AS INT) AS pos, q.value FROM o_quarter q JOIN o_sound s ON s.cik = q.cik AND s.field = q.field AND s.from_pos = q.from_pos")
def r6(t):
    rows = cut(ytd.stretches(numbered(t))).where("agrees")
    return rows.select("cik", "field", F.explode("qs").alias("q")).select("cik", "field", F.col("q.pos").alias("pos"), F.get("q.found", F.lit(0)).alias("value"))


# every way through the statements of a contradictory stretch, one statement a step: points are joined at a height, or the statement is dropped
_ISLE = "cik, field, from_pos"
_on = lambda x, y, keys=_ISLE: " AND ".join(f"{x}.{k.strip()} = {y}.{k.strip()}" for k in keys.split(","))
ORACLE["o_odd"] = f"SELECT i.* FROM o_island i WHERE NOT EXISTS (SELECT 1 FROM o_sound s WHERE {_on('s', 'i')})"
ORACLE["o_stated"] = f"""
SELECT c.*, c.span >= 2 OR c.field = 'revenue' AS free, CAST(row_number() OVER (PARTITION BY c.cik, c.field, c.from_pos ORDER BY c.hi, c.span) AS INT) AS k,
  CAST(count(*) OVER (PARTITION BY c.cik, c.field, c.from_pos) AS INT) AS n FROM o_num_con c JOIN o_odd i ON {_on('c', 'i')}"""
ORACLE["o_way"] = f"""
SELECT DISTINCT {_ISLE}, to_pos, scale, n, 0 AS k, range(0, to_pos - from_pos + 2) AS root, list_transform(range(0, to_pos - from_pos + 2), lambda x: 0.0::DOUBLE) AS off, 0 AS drops, 0::BIGINT AS gone FROM o_stated
UNION ALL
SELECT w.cik, w.field, w.from_pos, w.to_pos, w.scale, w.n, w.k + 1,
  CASE WHEN keep THEN list_transform(w.root, lambda r: CASE WHEN r = w.root[s.hi - w.from_pos + 2] THEN w.root[s.lo - w.from_pos + 1] ELSE r END) ELSE w.root END,
  CASE WHEN keep AND w.root[s.lo - w.from_pos + 1] <> w.root[s.hi - w.from_pos + 2] THEN list_transform(w.off, lambda o, i: CASE WHEN w.root[i] = w.root[s.hi - w.from_pos + 2]
    THEN o + w.off[s.lo - w.from_pos + 1] + s.value - w.off[s.hi - w.from_pos + 2] ELSE o END) ELSE w.off END,
  CASE WHEN keep THEN w.drops ELSE w.drops + 1 END, CASE WHEN keep THEN w.gone ELSE w.gone + (1::BIGINT << s.k) END
FROM o_way w JOIN o_stated s ON {_on('s', 'w')} AND s.k = w.k + 1 JOIN (VALUES (true), (false)) v(keep) ON CASE WHEN NOT keep THEN s.free WHEN w.root[s.lo - w.from_pos + 1] <> w.root[s.hi - w.from_pos + 2] THEN true
  ELSE abs(w.off[s.hi - w.from_pos + 2] - w.off[s.lo - w.from_pos + 1] - s.value) <= 0.005::DOUBLE * greatest(abs(w.off[s.hi - w.from_pos + 2] - w.off[s.lo - w.from_pos + 1]), abs(s.value), w.scale) END"""
ORACLE["o_fewest"] = f"""
SELECT w.*, (SELECT count(DISTINCT s.hi) FROM o_stated s WHERE {_on('s', 'w')} AND (w.gone >> s.k) & 1 = 1) AS ends FROM (
  SELECT *, min(drops) OVER (PARTITION BY {_ISLE}) AS least FROM o_way WHERE k = n) w WHERE drops = least"""
ORACLE["o_dropped"] = f"""
SELECT s.cik, s.field, s.from_pos, s.span, s.hi FROM o_stated s JOIN o_fewest w ON {_on('s', 'w')} GROUP BY ALL HAVING bool_and((w.gone >> s.k) & 1 = 1)"""
ORACLE["o_told"] = f"""
SELECT {_ISLE}, gone, scale, CAST(from_pos + i - 1 AS INT) AS pos, CASE WHEN root[i] = root[i + 1] THEN off[i + 1] - off[i] END AS v FROM (
  SELECT *, unnest(range(1, to_pos - from_pos + 2)) AS i FROM (SELECT *, min(ends) OVER (PARTITION BY {_ISLE}) AS least_ends FROM o_fewest) x WHERE ends = least_ends) y"""
ORACLE["o_told_run"] = f"""
SELECT *, sum(v) OVER w AS run, count(*) OVER w = count(v) OVER w AS known FROM o_told WINDOW w AS (PARTITION BY {_ISLE}, gone ORDER BY pos)"""
ORACLE["o_top"] = f"SELECT {_ISLE}, pos, max(run) AS top FROM o_told_run WHERE known GROUP BY ALL"
ORACLE["o_high"] = f"""
SELECT {_ISLE} FROM (SELECT r.cik, r.field, r.from_pos, r.gone, count(*) AS n FROM o_told_run r JOIN o_top t ON {_on('t', 'r')} AND t.pos = r.pos
  WHERE r.known AND r.field = 'revenue' AND (r.run >= t.top OR abs(r.run - t.top) <= 0.005::DOUBLE * greatest(abs(r.run), abs(t.top), r.scale)) GROUP BY ALL) x
WHERE n = (SELECT count(*) FROM o_top t WHERE {_on('t', 'x')}) GROUP BY ALL"""
ORACLE["o_agreed"] = f"""
SELECT {_ISLE}, pos, count(v) AS known, count(*) AS ways, CASE WHEN count(v) = count(*) AND max(v) - min(v) <= 0.005::DOUBLE * greatest(abs(min(v)), abs(max(v)), max(scale)) THEN min(v) END AS v FROM o_told GROUP BY {_ISLE}, pos"""
ORACLE["o_mended"] = f"""
SELECT a.cik, a.field, a.from_pos, a.pos, CASE WHEN h.cik IS NOT NULL AND t.pos IS NOT NULL THEN t.top - coalesce(b.top, 0) ELSE a.v END AS value
FROM o_agreed a LEFT JOIN o_high h ON {_on('h', 'a')} LEFT JOIN o_top t ON {_on('t', 'a')} AND t.pos = a.pos LEFT JOIN o_top b ON {_on('b', 'a')} AND b.pos = a.pos - 1
WHERE a.known > 0 AND NOT (h.cik IS NOT NULL AND t.pos IS NULL AND a.known < a.ways)"""


@query("R7_repaired_quarters", f"""SELECT m.cik, m.field, m.from_pos, m.pos, m.value, (SELECT string_agg(d.span || ':' || d.hi, ',' ORDER BY d.span, d.hi) FROM o_dropped d WHERE {_on('d', 'm')}) AS dropped FROM o_mended m""")
def r7(t):
    rows = numbered(t)
    odd = cut(ytd.stretches(rows)).where("NOT agrees").select("cik", "field", "island", "from_pos").distinct()
    gone = F.array_join(F.transform(F.array_sort("dropped"), lambda d: F.concat_ws(":", d["span"], d["hi"])), ",")
    return ytd.solve(rows, cut).where("pos IS NOT NULL").join(odd, ["cik", "field", "island"]).select("cik", "field", "from_pos", "pos", "value", F.nullif(gone, F.lit("")).alias("dropped"))


# quarters of all stretches, judged beside what was reported
ORACLE["o_solved"] = f"SELECT q.cik, q.field, q.from_pos, CAST(q.pos AS INT) AS pos, q.value FROM o_quarter q JOIN o_sound s ON {_on('s', 'q')} UNION ALL SELECT cik, field, from_pos, pos, value FROM o_mended"
ORACLE["o_beside"] = f"""
SELECT *, value IS NULL OR reported IS NULL OR abs(reported - value) > 0.005::DOUBLE * greatest(abs(reported), abs(value), scale) AS derived FROM (
  SELECT s.*, g.period_end, f.value AS reported, z.scale FROM o_solved s JOIN o_grid g ON g.cik = s.cik AND g.pos = s.pos
  JOIN (SELECT DISTINCT {_ISLE}, scale FROM o_num_con) z ON {_on('z', 's')} LEFT JOIN o_flow_long f ON f.cik = s.cik AND f.field = s.field AND f.period_end = g.period_end AND f.qtrs = 1) x"""
ORACLE["o_judged"] = f"""
SELECT b.*, b.derived AND coalesce(j.n >= 2 AND j.low = j.high AND j.low <> 0 AND sign(b.value) = -j.low AND abs(b.value) > 2 * j.most, false) AS bad
FROM o_beside b LEFT JOIN (SELECT a.cik, a.field, a.from_pos, a.pos, count(*) AS n, min(sign(o.value)) AS low, max(sign(o.value)) AS high, max(abs(o.value)) AS most FROM o_beside a JOIN o_beside o ON {_on('o', 'a')}
  AND o.pos <> a.pos AND o.value IS NOT NULL AND o.reported IS NOT NULL GROUP BY ALL) j ON {_on('j', 'b')} AND j.pos = b.pos"""
ORACLE["o_resolved"] = "SELECT cik, period_end, field, CASE WHEN NOT bad THEN value END AS value, derived FROM o_judged WHERE bad OR value IS NOT NULL OR reported IS NOT NULL"
ORACLE["o_rejected"] = """
SELECT d.cik, d.span, g.period_end, d.field FROM o_dropped d JOIN o_grid g ON g.cik = d.cik AND g.pos = d.hi UNION
SELECT c.cik, c.span, c.period_end, c.field FROM o_judged j JOIN o_num_con c ON c.cik = j.cik AND c.field = j.field AND c.hi = j.pos AND c.span >= 2 WHERE j.bad"""
_LINES = [*FLOW_FIELDS, "shares_diluted"]
ORACLE["o_resolved_wide"] = f"""
SELECT cik, period_end, {', '.join(f"max(value) FILTER (field = '{f}') AS r_{f}, bool_or(derived) FILTER (field = '{f}') AS d_{f}" for f in FLOW_FIELDS)} FROM o_resolved GROUP BY ALL"""
_tag = lambda f: f"CASE WHEN r.d_{f} THEN CASE WHEN r.r_{f} IS NOT NULL THEN 'cumulative_diff' END ELSE f.{f}_tag END AS {f}_tag"
ORACLE["o_qline"] = f"""
SELECT coalesce(f.cik, r.cik) AS cik, coalesce(f.period_end, r.period_end) AS period_end, 'Q' AS period_type,
  {', '.join(f'CASE WHEN r.d_{f} IS NOT NULL THEN r.r_{f} ELSE f.{f} END AS {f}' for f in FLOW_FIELDS)}, f.shares_diluted, {', '.join(_tag(f) for f in FLOW_FIELDS)}, f.shares_diluted_tag,
  CASE WHEN {' OR '.join(f'coalesce(r.d_{f}, false)' for f in FLOW_FIELDS)} THEN 'cumulative_diff' END AS derived_tag
FROM (SELECT * FROM o_flow WHERE qtrs = 1) f FULL JOIN o_resolved_wide r ON r.cik = f.cik AND r.period_end = f.period_end"""
_gone = lambda f: f"EXISTS (SELECT 1 FROM o_rejected g WHERE g.cik = f.cik AND g.span = 4 AND g.period_end = f.period_end AND g.field = '{f}')"
ORACLE["o_aline"] = f"""
SELECT f.cik, f.period_end, 'A' AS period_type, {', '.join(f'CASE WHEN NOT {_gone(f)} THEN f.{f} END AS {f}' for f in FLOW_FIELDS)}, f.shares_diluted,
  {', '.join(f'CASE WHEN NOT {_gone(f)} THEN f.{f}_tag END AS {f}_tag' for f in FLOW_FIELDS)}, f.shares_diluted_tag, NULL AS derived_tag FROM o_flow f WHERE f.qtrs = 4"""


def resolved(t):
    """(flows, quarters, rejections) as the whole chain makes them."""
    v = values(t)
    with co_partitioned(t.spark):
        f = cut_by(flows(t, v))
        return f, *[cut_by(x) for x in ytd.resolve_quarters(f, ytd.fiscal_grid(v), cut_by)[:2]]


_YEAR = """SELECT cik, period_end, CAST(year(period_end) AS INT) AS y, CASE WHEN (cik + quarter(period_end)) % 5 = 0 THEN -3 * operating_income ELSE operating_income END AS v FROM a_q"""


@query("R8_implausible_quarters", f"""
SELECT a.cik, a.period_end, count(b.v) >= 2 AND min(sign(b.v)) = max(sign(b.v)) AND max(sign(b.v)) <> 0 AND sign(any_value(a.v)) = -max(sign(b.v)) AND abs(any_value(a.v)) > 2 * max(abs(b.v)) AS implausible
FROM ({_YEAR}) a JOIN ({_YEAR}) b ON b.cik = a.cik AND b.y = a.y AND b.period_end <> a.period_end GROUP BY a.cik, a.period_end""")
def r8(t):
    year = Window.partitionBy("cik", "y")
    rows = t.sql(_YEAR).withColumn("all", F.collect_list(F.struct("period_end", "v")).over(year))
    others = F.transform(F.filter("all", lambda o: o["period_end"] != F.col("period_end")), lambda o: o["v"])
    rows = rows.withColumn("others", others).where(F.size("others") > 0)
    return rows.select("cik", "period_end", F.coalesce(ytd.implausible(F.col("v"), F.col("others")), F.lit(False)).alias("implausible"))


@query("R9_rejected_annual_fields", f"SELECT cik, period_end, {', '.join(f'{f}, {f}_tag' for f in _LINES)} FROM o_aline")
def r9(t):
    f, _, rejected = resolved(t)
    return norm.annual_lines(f, rejected).select("cik", "period_end", *[c for f in _LINES for c in (f, f"{f}_tag")])


@query("R10_quarter_assembly", f"SELECT cik, period_end, {', '.join(f'{f}, {f}_tag' for f in _LINES)}, derived_tag FROM o_qline")
def r10(t):
    f, quarters, _ = resolved(t)
    return norm.quarter_lines(f, quarters).select("cik", "period_end", *[c for f in _LINES for c in (f, f"{f}_tag")], "derived_tag")


@query("U3_quarter_ends", "SELECT cik, period_end FROM o_flow WHERE qtrs = 1 UNION SELECT cik, period_end FROM o_resolved")
def u3(t):
    f, quarters, _ = resolved(t)
    return norm.quarter_lines(f, quarters).select("cik", "period_end")


# ---- the whole chain --------------------------------------------------------------------------------------------
_STOCKS = ["cash", "total_debt", "equity", "shares_outstanding"]
ORACLE["o_stock"] = f"""
SELECT p.cik, p.period_end, d.{tg.CASH} + coalesce(d.{tg.SHORT_TERM_INVESTMENTS}, 0) AS cash, CASE WHEN d.{tg.CASH} IS NOT NULL THEN concat_ws('+', '{tg.CASH}', CASE WHEN d.{tg.SHORT_TERM_INVESTMENTS} IS NOT NULL THEN '{tg.SHORT_TERM_INVESTMENTS}' END) END AS cash_tag,
  d.total_debt, n.total_debt_tag, d.z_{tg.EQUITY} AS equity, CASE WHEN d.z_{tg.EQUITY} IS NOT NULL THEN '{tg.EQUITY}' END AS equity_tag, s.shares AS shares_outstanding, CASE WHEN s.shares IS NOT NULL THEN '{tg.COVER_SHARES}' END AS shares_outstanding_tag
FROM o_probe p LEFT JOIN o_debt d ON d.cik = p.cik AND d.period_end = p.period_end LEFT JOIN o_debt_name n ON n.cik = p.cik AND n.period_end = p.period_end
LEFT JOIN ({_GUARDED}) s ON s.cik = p.cik AND s.period_end = p.period_end"""
ORACLE["o_line"] = "SELECT * FROM o_qline UNION ALL BY NAME SELECT * FROM o_aline"
ORACLE["o_checked"] = f"""
SELECT * REPLACE (CASE WHEN revenue >= 0 THEN revenue END AS revenue, CASE WHEN NOT coalesce(revenue >= 0 AND gross_profit > revenue, false) THEN gross_profit END AS gross_profit) FROM (
  SELECT l.*, l.ocf - l.capex AS fcf, s.* EXCLUDE (cik, period_end) FROM o_line l LEFT JOIN o_stock s ON s.cik = l.cik AND s.period_end = l.period_end) x"""
_back = lambda c: [c, *[f"lag({c}, {k}) OVER w" for k in (1, 2, 3)]]
ORACLE["o_norm_ttm"] = f"""
SELECT * REPLACE (CASE WHEN revenue >= 0 THEN revenue END AS revenue, CASE WHEN NOT coalesce(revenue >= 0 AND gross_profit > revenue, false) THEN gross_profit END AS gross_profit) FROM (
  SELECT cik, period_end, 'TTM' AS period_type, {', '.join(f"{' + '.join(_back(f))} AS {f}" for f in FLOW_FIELDS)}, {' + '.join(_back('ocf'))} - ({' + '.join(_back('capex'))}) AS fcf, cash, total_debt, equity, shares_diluted, shares_outstanding,
    {', '.join(f"coalesce({', '.join(_back(f'{f}_tag'))}) AS {f}_tag" for f in [*_LINES, *_STOCKS])},
    'cumulative_diff@' || nullif(concat_ws(',', {', '.join(f"CASE WHEN {d} IS NOT NULL THEN ({e})::VARCHAR END" for d, e in zip(_back('derived_tag'), _back('period_end')))}), '') AS derived_tag,
    date_diff('day', lag(period_end, 3) OVER w, period_end) AS days
  FROM o_checked WHERE period_type = 'Q' WINDOW w AS (PARTITION BY cik ORDER BY period_end)) x WHERE days BETWEEN 240 AND 310"""
_NAMES = [*PERIOD_FIELDS, *[f"{f}_tag" for f in [*_LINES, *_STOCKS]], "derived_tag"]
ORACLE["o_norm"] = f"SELECT cik, period_end, period_type, {', '.join(_NAMES)} FROM o_checked UNION ALL SELECT cik, period_end, period_type, {', '.join(_NAMES)} FROM o_norm_ttm"


@query("R14_normalized_periods", f"SELECT cik, period_end, period_type, {', '.join(_NAMES)} FROM o_norm")
def r14(t):
    periods = norm.normalize(t.a_facts).periods
    tags = {f"{f}_tag": F.col("source_tags")[f] for f in [*_LINES, *_STOCKS, "derived"]}
    return periods.withColumns(tags).select("cik", "period_end", "period_type", *_NAMES)
