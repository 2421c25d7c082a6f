"""Repair of fiscal stretches whose statements contradict each other (R7). Shipped to workers by value, so it imports nothing of the package.

A statement over the quarters lo..hi says how far the running sum rises from point lo - 1 to point hi. The rule: drop as few statements as make the
rest agree, and of all such ways those that touch the fewest period ends. A statement is rejected if every way with the fewest drops drops it. Revenue
takes the way whose running sums are nowhere below those of another; otherwise a quarter has the value that all ways agree on (the least one
within the tolerance), or none.

One fold over the points does it. What the past means for the future is how the last few points stand to each other, and the points of quarters that
are not settled yet: their standing. Ways with equal standings go on as one, which carries their number of drops and ends, the statements all of
them drop, the least and greatest value of each settled quarter, the highest running sums, and how far a single way attains these. So ways
are never listed, the work per quarter is bounded by the standings of a few points, and no rule depends on the size of a stretch.
"""
from __future__ import annotations

from itertools import product
from typing import NamedTuple


class Statement(NamedTuple):
    span: int
    hi: int
    lo: int
    value: float


class Standing(NamedTuple):
    """Points as (point, group, height within the group), the oldest first, and the quarters before them that are open."""
    points: tuple
    open: tuple


class Ways(NamedTuple):
    """All ways into a standing that drop the fewest statements: what all of them drop; and of those with the fewest ends, per settled quarter
    (least value, greatest value, whether one lacks it), the highest running sums up to the first unknown quarter, and the length on which one way has them."""
    drops: int
    ends: int
    always: frozenset
    settled: dict
    top: tuple
    attained: int
    stopped: bool


def close(a: float, b: float, scale: float, tol: float) -> bool:
    return abs(a - b) <= tol * max(abs(a), abs(b), scale)


def advance(standing: Standing, point: int, kept, scale: float, tol: float, reach: int):
    """(standing after ``point`` with the statements that end there, {quarter settled now: value or None}), or None if a statement disagrees with the others."""
    where = {p: (g, h) for p, g, h in standing.points}
    levels: dict = {}  # group -> height of the new point in it
    for c in kept:
        group, height = where[c.lo - 1]
        if group not in levels:
            levels[group] = height + c.value
        elif not close(levels[group] - height, c.value, scale, tol):
            return None
    rows = [(p, point if g in levels else g, h - levels[g] if g in levels else h) for p, g, h in standing.points] + [(point, point, 0.0)]
    where = {p: (g, h) for p, g, h in rows}
    alive = {g for p, g, _ in rows if p > point - reach}
    settled, still = {}, []
    for q in (*standing.open, point):
        (g0, h0), (g1, h1) = where[q - 1], where[q]
        if g0 == g1:
            settled[q] = h1 - h0
        elif g0 in alive and g1 in alive:
            still.append(q)
        else:
            settled[q] = None
    needed = {p for q in still for p in (q - 1, q)}
    base: dict = {}  # groups are named by their oldest point, which stands at zero
    rows = [(p, g, h) for p, g, h in rows if p > point - reach or p in needed]
    for p, g, h in rows:
        base.setdefault(g, (p, h))
    return Standing(tuple((p, base[g][0], h - base[g][1]) for p, g, h in rows), tuple(still)), settled


def settle(ways: Ways, quarters: dict, lo: int) -> Ways:
    """The ways with quarters settled: values enter the running sums from there on, an unknown one ends them."""
    top, attained, stopped = list(ways.top), ways.attained, ways.stopped
    for q, v in quarters.items():
        if v is not None:
            top[q - lo:] = [s + v for s in top[q - lo:]]
        elif q - lo < len(top):
            del top[q - lo:]
            attained, stopped = min(attained, len(top)), True
    return ways._replace(settled={**ways.settled, **{q: (v, v, v is None) for q, v in quarters.items()}}, top=tuple(top), attained=attained, stopped=stopped)


def extended(ways: Ways, dropped: tuple, quarters: dict, lo: int) -> Ways:
    """The ways one point on."""
    if not ways.stopped:
        ways = ways._replace(top=(*ways.top, ways.top[-1] if ways.top else 0.0), attained=ways.attained + (ways.attained == len(ways.top)))
    ways = ways._replace(drops=ways.drops + len(dropped), ends=ways.ends + bool(dropped), always=ways.always.union(dropped))
    return settle(ways, quarters, lo)


def both(a: Ways, b: Ways, scale: float, tol: float) -> Ways:
    """Two sets of ways into one standing as one."""
    if a.drops != b.drops:
        return min(a, b, key=lambda w: w.drops)
    always = a.always & b.always
    if a.ends != b.ends:
        return min(a, b, key=lambda w: w.ends)._replace(always=always)

    def held(x: Ways, y: Ways) -> int:
        pairs = zip(x.top[:x.attained], y.top)
        return next((k for k, (s, other) in enumerate(pairs) if s < other and not close(s, other, scale, tol)), x.attained)

    long, short = (a, b) if len(a.top) >= len(b.top) else (b, a)
    top = tuple(max(pair) for pair in zip(long.top, short.top)) + long.top[len(short.top):]
    settled = {}
    for q, (low, high, lacks) in a.settled.items():
        low2, high2, lacks2 = b.settled[q]
        known = [v for v in (low, high, low2, high2) if v is not None]
        settled[q] = (min(known, default=None), max(known, default=None), lacks or lacks2)
    return a._replace(always=always, settled=settled, top=top, attained=max(held(a, b), held(b, a)), stopped=long.stopped)


def fold(statements, lo: int, hi: int, scale: float, tol: float, may_drop, reach: int) -> Ways:
    """All best ways through the points lo..hi as one."""
    unit = (scale or 1.0) * 1e-9
    ending: dict = {}
    for c in sorted(statements):
        ending.setdefault(c.hi, []).append(c)
    layer = {(): (Standing(((lo - 1, lo - 1, 0.0),), ()), Ways(0, 0, frozenset(), {}, (), 0, False))}
    for point in range(lo, hi + 1):
        here = ending.get(point, [])
        options = [(tuple(c for c, k in zip(here, keep) if k), tuple(c for c, k in zip(here, keep) if not k))
                   for keep in product(*[(True, False) if may_drop(c) else (True,) for c in here])]
        following: dict = {}
        for standing, ways in layer.values():
            for kept, dropped in options:
                step = advance(standing, point, kept, scale, tol, reach)
                if step is None:
                    continue
                after, quarters = step
                key = tuple((p, g, round(h / unit)) for p, g, h in after.points)
                found = following.get(key)
                if found is None or found[1].drops >= ways.drops + len(dropped):
                    made = extended(ways, dropped, quarters, lo)
                    following[key] = (after, made) if found is None else (found[0], both(found[1], made, scale, tol))
        # whoever drops all that crosses this point is free of its past, so no best way has more drops than that costs
        crossing = sum(c.lo <= point < c.hi for c in statements)
        most = min(ways.drops for _, ways in following.values()) + crossing
        layer = {key: (standing, ways) for key, (standing, ways) in following.items() if ways.drops <= most}
    ends = [settle(ways, dict.fromkeys(standing.open), lo) for standing, ways in layer.values()]
    out = ends[0]
    for ways in ends[1:]:
        out = both(out, ways, scale, tol)
    return out


def repair(statements, lo: int, hi: int, overrule: bool, scale: float, tol: float, reach: int):
    """({quarter: value or None}, rejected statements). ``overrule`` lets single quarters be dropped too."""
    best = fold(statements, lo, hi, scale, tol, lambda c: overrule or c.span > 1, reach)
    values = {}
    for q, (low, high, lacks) in sorted(best.settled.items()):
        if low is not None:
            values[q] = low if not lacks and close(low, high, scale, tol) else None
    if overrule and best.top and best.attained == len(best.top):
        values = {q: v for q, v in values.items() if not best.settled[q][2]}
        values.update((lo + k, s - before) for k, (s, before) in enumerate(zip(best.top, (0.0, *best.top))))
    return values, sorted(best.always)


def on_batches(tol: float, reach: int, overrule_field: str):
    """The function for mapInArrow over packed stretches; rows go in and out one stretch at a time. A stretch that can't be solved (numbers
    beyond the floating range) gives one row with its error, so that one company's damage stays its own."""
    import pyarrow as pa

    dropped = pa.list_(pa.struct([("span", pa.int32()), ("hi", pa.int32())]))
    shape = pa.schema([("cik", pa.int64()), ("field", pa.string()), ("island", pa.int64()), ("pos", pa.int32()), ("value", pa.float64()),
                       ("dropped", dropped), ("error", pa.string())])

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                statements = [Statement(c["span"], c["hi"], c["lo"], c["value"]) for c in row["cs"]]
                head = {k: row[k] for k in ("cik", "field", "island")}
                try:
                    values, rejected = repair(statements, row["from_pos"], row["to_pos"], row["field"] == overrule_field, row["scale"], tol, reach)
                except (ArithmeticError, ValueError) as e:
                    out.append({**head, "pos": None, "value": None, "dropped": [], "error": f"{row['field']}: {type(e).__name__}: {e}"})
                    continue
                gone = [{"span": c.span, "hi": c.hi} for c in rejected]
                out += [{**head, "pos": i, "value": v, "dropped": gone} for i, v in sorted(values.items())] or [
                    {**head, "pos": None, "value": None, "dropped": gone}]
            yield pa.RecordBatch.from_pylist(out, schema=shape)

    return run
