"""Reconciliation on small invented facts."""
import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from quarterdeck import schemas, tags as t
from quarterdeck.operators import carry, dates, repair, ytd
from quarterdeck.plans.normalize import normalize

D = dt.date.fromisoformat


def fact(cik, tag, end, value, qtrs=0, start=None, source="api", filed="2001-01-01", accession="a", seq=0, form="10-Q"):
    return (cik, tag, "USD", D(start) if start else None, D(end), qtrs, float(value), form, D(filed), accession, source, seq)


def facts(spark, rows):
    return spark.createDataFrame(rows, schemas.FACT)


TAGS = ["Revenues", "NetIncomeLoss", "GrossProfit", "OperatingIncomeLoss", "ShareBasedCompensation", "ResearchAndDevelopmentExpense"]


def quarter(cik, end, values, start, **kw):
    return [fact(cik, tag, end, v, 1, start, **kw) for tag, v in zip(TAGS, values)]


def verdicts(spark, rows):
    return {(r.a.isoformat(), r.b.isoformat()): r.merge for r in dates.pair_evidence(facts(spark, rows)).collect()}


def test_pair_evidence_merges_agreeing_and_sparse_dates(spark):
    full = quarter(1, "2000-03-31", [100, 10, 50, 20, 5, 7], "2000-01-01")
    pair = ("2000-03-29", "2000-03-31")
    assert verdicts(spark, full + quarter(1, "2000-03-29", [100.1], "2000-01-01"))[pair] is True
    assert verdicts(spark, full + quarter(1, "2000-03-29", [100, 99], "2000-01-01"))[pair] is False     # one each
    assert verdicts(spark, full + quarter(1, "2000-03-29", [55], "2000-01-01"))[pair] is True           # sparse beside dense
    assert verdicts(spark, full + quarter(1, "2000-03-29", [55, 99], "2000-01-01"))[pair] is False      # two contradictions
    assert verdicts(spark, full + quarter(1, "2000-03-29", [55], "1999-11-01")) == {}                    # starts too far apart
    instant = [fact(1, t.CASH, "2000-03-31", 9), fact(1, t.CASH, "2000-03-29", 7)] + full
    assert verdicts(spark, instant)[pair] is False


def test_clusters_are_transitive_and_keep_the_fullest_date(spark):
    rows = (quarter(1, "2000-03-25", [100, 10], "2000-01-01") + quarter(1, "2000-03-31", [100, 10, 50], "2000-01-01", seq=1)
            + quarter(1, "2000-04-18", [100, 10], "2000-01-10", seq=2))
    f = facts(spark, rows)
    out = {r.period_end.isoformat(): r.canonical.isoformat() for r in dates.clusters(dates.pair_evidence(f), f).collect()}
    assert out == {"2000-03-25": "2000-03-31", "2000-03-31": "2000-03-31", "2000-04-18": "2000-03-31"}


def test_components_of_interleaved_chains(spark):
    draw, rows = random.Random(3), []
    for cik in range(60):
        days = draw.sample(range(200), 25)
        rows += [(cik, draw.choice(["instant", "duration"]), D("2000-01-01") + dt.timedelta(a), D("2000-01-01") + dt.timedelta(b)) for a in days for b in days if 0 < b - a <= 20 and draw.random() < 0.12]
    want = {}
    for cik, ax, a, b in rows:
        want.setdefault((cik, ax), {})
        at = want[cik, ax]
        old = {at.setdefault(a, a), at.setdefault(b, b)}
        at.update({d: min(old) for d, c in at.items() if c in old})
    got = dates.components(spark.createDataFrame(rows, "cik long, axis string, a date, b date")).collect()
    assert {(r.cik, r.axis, r.period_end): r.cluster for r in got} == {(*k, d): c for k, at in want.items() for d, c in at.items()}
    assert len(got) == sum(map(len, want.values()))


def statements(spark, rows, field="ocf"):
    return spark.createDataFrame([(1, field, lo, hi, hi - lo + 1, float(v), D("2000-01-01")) for lo, hi, v in rows],
                                 "cik long, field string, lo int, hi int, span int, value double, period_end date")


def solved(spark, rows, field="ocf"):
    out = ytd.solve(ytd.islands(statements(spark, rows, field))).collect()
    return {r.pos: r.value for r in out if r.pos is not None}, {(d.span, d.hi) for r in out for d in r.dropped}


def test_missing_fourth_quarter(spark):
    assert solved(spark, [(0, 0, 10), (0, 1, 30), (0, 2, 60), (0, 3, 100)])[0] == {0: 10, 1: 20, 2: 30, 3: 40}
    assert solved(spark, [(0, 0, 10), (1, 1, 20), (2, 2, 30), (0, 3, 100)])[0] == {0: 10, 1: 20, 2: 30, 3: 40}


def test_wrong_half_year_is_dropped(spark):
    values, dropped = solved(spark, [(0, 0, 10), (1, 1, 20), (2, 2, 30), (0, 1, 45), (0, 2, 60), (0, 3, 100)])
    assert values == {0: 10, 1: 20, 2: 30, 3: 40} and dropped == {(2, 1)}


def test_only_revenue_may_overrule_a_reported_quarter(spark):
    rows = [(0, 0, 2), (1, 1, 20), (2, 2, 30), (0, 1, 30), (0, 2, 60), (0, 3, 100)]
    assert solved(spark, rows, "revenue")[0] == {0: 10, 1: 20, 2: 30, 3: 40}
    values, dropped = solved(spark, rows, "ocf")
    assert values == {0: 2, 1: 20, 2: 30, 3: 48} and dropped == {(2, 1), (3, 2)}


def test_undecided_quarters_are_null(spark):
    # two equally small repairs that disagree about the last quarter only
    values, dropped = solved(spark, [(0, 0, 10), (0, 1, 30), (0, 2, 60), (1, 2, 80)], "ocf")
    assert values == {0: 10, 1: 20, 2: None} and not dropped


def test_native_solution_equals_the_solver(spark):
    rows = [(4 * y + lo, 4 * y + hi, v) for y in range(3) for lo, hi, v in [(0, 0, 10 + y), (0, 1, 30 + y), (0, 2, 60 + y), (0, 3, 100 + y)]]
    numbered = ytd.islands(statements(spark, rows))
    for _, part in itertools.groupby(sorted(numbered.collect(), key=lambda r: r.island), key=lambda r: r.island):
        part = list(part)
        solver = mend([(r.lo, r.hi, r.value) for r in part], "ocf", part[0].from_pos, part[0].to_pos)
        native = {r.pos: r.value for r in ytd.solve(numbered).where(F.col("island") == part[0].island).collect()}
        assert (native, set()) == solver


def mend(rows, field, first=None, last=None):
    cs = [repair.Statement(hi - lo + 1, hi, lo, float(v)) for lo, hi, v in rows]
    first = min(c.lo for c in cs) if first is None else first
    last = max(c.hi for c in cs) if last is None else last
    values, gone = repair.repair(cs, first, last, field == "revenue", max(abs(c.value) for c in cs), ytd.TOL, ytd.MAX_SPAN)
    return values, {(c.span, c.hi) for c in gone}


def test_a_neighbouring_year_changes_nothing(spark):
    year = [(0, 0, 10), (1, 1, 10), (2, 2, 10), (3, 3, 10), (0, 1, 99), (0, 2, 30), (0, 3, 40)]
    alone = solved(spark, year, "revenue")
    assert alone == ({i: 10.0 for i in range(4)}, {(2, 1)})
    later = [(4 + lo, 4 + hi, v) for lo, hi, v in [(0, 0, 10), (1, 1, 10), (2, 2, 10), (3, 3, 10), (0, 1, 20), (0, 2, 30), (0, 3, 40)]]
    values, dropped = solved(spark, [*year, *later, (3, 6, 40)], "revenue")
    assert values == {i: 10.0 for i in range(8)} and dropped == {(2, 1)}


def test_long_stretches_are_solved_exactly(spark):
    rows = [(i, i, 10) for i in range(8)] + [(i, i + 1, 20) for i in range(7)] + [(0, 3, 99)]
    assert solved(spark, rows) == ({i: 10.0 for i in range(8)}, {(4, 3)})
    # forty years in one stretch, each with one wrong figure
    long = [(i, i, 10) for i in range(160)] + [(i, i + 3, 40) for i in range(157)] + [(4 * y, 4 * y + 1, 77) for y in range(40)]
    values, dropped = mend(long, "ocf")
    assert values == {i: 10.0 for i in range(160)} and dropped == {(2, 4 * y + 1) for y in range(40)}


def heights(kept, first, last):
    """Point -> (point it is measured from, height), spread through the statements from each point that is not reached yet."""
    seen = {}
    for start in range(first - 1, last + 1):
        queue = [] if start in seen else [start]
        seen.setdefault(start, (start, 0.0))
        for here in queue:
            for c in kept:
                for a, b, step in ((c.lo - 1, c.hi, c.value), (c.hi, c.lo - 1, -c.value)):
                    if a == here and b not in seen:
                        seen[b] = (start, seen[here][1] + step)
                        queue.append(b)
    return seen


def by_trial(rows, field):
    """All ways with the fewest drops by trying all subsets: (what is dropped, the quarters that the rest gives), on whole numbers."""
    cs = [repair.Statement(hi - lo + 1, hi, lo, float(v)) for lo, hi, v in rows]
    first, last = min(c.lo for c in cs), max(c.hi for c in cs)
    free = [c for c in cs if field == "revenue" or c.span > 1]
    for n in range(len(free) + 1):
        found = []
        for out in itertools.combinations(free, n):
            kept = [c for c in cs if c not in out]
            at = heights(kept, first, last)
            if all(abs(at[c.hi][1] - at[c.lo - 1][1] - c.value) < 1e-6 for c in kept):
                found.append((set(out), {i: at[i][1] - at[i - 1][1] for i in range(first, last + 1) if at[i][0] == at[i - 1][0]}))
        if found:
            return found, first, last


def judged(found, first, last, field):
    """The rule on a list of all ways."""
    least = min(len({c.hi for c in out}) for out, _ in found)
    ways = [q for out, q in found if len({c.hi for c in out}) == least]
    runs = [list(itertools.accumulate(itertools.takewhile(lambda v: v is not None, (q.get(i) for i in range(first, last + 1))))) for q in ways]
    best = next((q for q, r in zip(ways, runs) if r and all(len(o) <= len(r) and all(x >= y for x, y in zip(r, o)) for o in runs)), None)
    known = {i: [q.get(i) for q in ways] for i in set().union(*ways)}
    out = {i: v[0] if len(set(v)) == 1 else None for i, v in known.items()}
    if field == "revenue" and best is not None:
        size = max(map(len, runs))
        out = {i: best[i] if i < first + size else v for i, v in out.items() if i < first + size or None not in known[i]}
    return out


@pytest.mark.parametrize("field", ["ocf", "revenue"])
def test_repair_against_trying_all_subsets(field):
    draw, ties, dominated = random.Random(7), 0, 0
    for _ in range(1200):
        true = [draw.randint(20, 90) * 1000 for _ in range(draw.choice([4, 4, 5, 6]))]
        spans = [(lo, lo + k) for lo in range(len(true)) for k in range(4) if lo + k < len(true)]
        picked = draw.sample(spans, min(len(spans), draw.randint(4, 10)))
        rows = [(lo, hi, sum(true[lo:hi + 1]) + draw.choice([0, 0, 0, 40_000, -60_000])) for lo, hi in picked]
        found, first, last = by_trial(rows, field)
        values, gone = mend(rows, field)
        assert gone == {(c.span, c.hi) for c in set.intersection(*[out for out, _ in found])}
        assert values == judged(found, first, last, field), rows
        ties += len(found) > 1
        dominated += len(found) > 1 and None not in values.values()
    assert ties > 150 and dominated > 30


def test_work_per_quarter_is_bounded():
    def standings(years):
        # every year two readings are equally good, which makes 2 ** years ways
        rows = [(4 * y + lo, 4 * y + hi, v) for y in range(years) for lo, hi, v in [(0, 0, 10), (0, 1, 30), (0, 2, 60), (1, 2, 80), (0, 3, 100)]]
        rows += [(4 * y + 3, 4 * y + 6, 90) for y in range(years - 1)]
        cs = [repair.Statement(hi - lo + 1, hi, lo, float(v)) for lo, hi, v in rows]
        calls = []
        real = repair.advance
        repair.advance = lambda *a: calls.append(1) or real(*a)
        try:
            values, _ = repair.repair(cs, 0, 4 * years - 1, False, 100.0, ytd.TOL, ytd.MAX_SPAN)
        finally:
            repair.advance = real
        return len(calls), values
    few, many = standings(30), standings(60)
    assert many[0] < 2.2 * few[0] and len(many[1]) == 240


def debt(spark, instants, absent=(), at="2001-03-31"):
    values = spark.createDataFrame([(1, 0, D(end), tag, float(v), "api") for tag, end, v in instants],
                                   "cik long, qtrs int, period_end date, tag string, value double, source string")
    gone = spark.createDataFrame([(1, D(end), tag) for tag, end in absent], "cik long, period_end date, tag string")
    probes = spark.createDataFrame([(1, D(at))], "cik long, period_end date")
    r = carry.stock_lines(carry.carried(values, gone, probes)).first()
    return r.total_debt, r.total_debt_tag


NOW, OLD = "2001-03-31", "2000-12-31"


@pytest.mark.parametrize("instants, expected", [
    ([(t.DEBT_COMBINED, NOW, 90), (t.LTD, NOW, 70)], 90),
    ([(t.LTD_NONCURRENT, NOW, 70), (t.DEBT_CURRENT, NOW, 10)], 80),
    ([(t.LTD_NONCURRENT, NOW, 70), (t.LTD_CURRENT, NOW, 10), (t.DEBT_CURRENT, NOW, 25)], 95),
    ([(t.LTD, NOW, 80), (t.LTD_NONCURRENT, NOW, 70), (t.LTD_CURRENT, NOW, 4), ("ShortTermBorrowings", NOW, 10)], 80),
    ([(t.LTD, NOW, 74), (t.LTD_NONCURRENT, NOW, 70), (t.LTD_CURRENT, NOW, 4), ("ShortTermBorrowings", NOW, 10)], 84),
    ([(t.LTD, NOW, 50), ("NotesPayable", NOW, 60), ("ShortTermBorrowings", NOW, 5)], 65),
    ([("NotesPayableNoncurrent", NOW, 30), ("NotesPayableCurrent", NOW, 5), ("LineOfCredit", NOW, 20), ("ShortTermBorrowings", NOW, 7)], 62),
    ([(t.LEASED_SPANNING, NOW, 100), ("FinanceLeaseLiability", NOW, 30)], 70),
    ([(t.LEASED_SPANNING, NOW, 100), ("FinanceLeaseLiability", OLD, 30)], 100),
    ([(t.LEASED_NONCURRENT, NOW, 100), ("FinanceLeaseLiabilityNoncurrent", NOW, 30), (t.DEBT_CURRENT, NOW, 20), ("FinanceLeaseLiabilityCurrent", NOW, 8)], 82),
    ([(t.LTD_NONCURRENT, NOW, 0)], None),
    ([("ShortTermBorrowings", NOW, 7)], 7),
])
def test_debt_layouts(spark, instants, expected):
    assert debt(spark, instants)[0] == expected


def test_carry_forward(spark):
    old = (t.LTD_NONCURRENT, OLD, 70)
    assert debt(spark, [old, (t.DEBT_CURRENT, NOW, 10)])[0] == 80                                            # carried
    assert debt(spark, [old, (t.DEBT_CURRENT, NOW, 10)], [(t.LTD_NONCURRENT, NOW)])[0] == 10                # asserted absent
    assert debt(spark, [old, (t.LTD, NOW, 60)])[0] == 60                                                     # measured again
    assert debt(spark, [old, ("NotesPayableNoncurrent", NOW, 60)])[0] == 60                                  # region measured again
    assert debt(spark, [(t.LTD_CURRENT, OLD, 12), ("NotesPayable", OLD, 12), ("NotesPayable", NOW, 15)])[0] == 15  # same number, other name
    assert debt(spark, [(t.LTD_NONCURRENT, "2000-02-01", 70)])[0] is None                                    # beyond the lookback


def test_normalize_a_company_end_to_end(spark):
    rows = []
    for y in (1999, 2000):
        for k, end in enumerate(("03-31", "06-30", "09-30", "12-31"), 1):
            rows.append(fact(1, "Revenues", f"{y}-{end}", 100 * k, k, f"{y}-01-01", form="10-K" if k == 4 else "10-Q", accession=f"{y}{k}"))
            rows.append(fact(1, t.CASH, f"{y}-{end}", 5, accession=f"{y}{k}"))
    periods, rejected, failures = normalize(facts(spark, rows))
    got = periods.where("period_type = 'Q'").orderBy("period_end").collect()
    assert [r.revenue for r in got] == [100.0] * 8 and rejected.count() == failures.count() == 0
    assert got[3].source_tags["revenue"] == "cumulative_diff" and got[0].source_tags["revenue"] == "Revenues"
    ttm = periods.where("period_type = 'TTM'").orderBy("period_end").collect()
    assert len(ttm) == 5 and ttm[0].revenue == 400 and ttm[0].cash == 5 and ttm[0].source_tags["derived"].startswith("cumulative_diff@")
    assert periods.where("period_type = 'A'").count() == 2


