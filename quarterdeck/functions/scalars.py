"""Guarded arithmetic as Column expressions. A missing input gives NULL, never zero."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from quarterdeck.config import RECONCILE

REL = RECONCILE["rel_tolerance"]


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null(kind="double") -> Column:
    return F.lit(None).cast(kind)


def curve(x, points) -> Column:
    """Piecewise-linear interpolation, flat outside the end points."""
    x = col(x)
    out = F.when(x <= float(points[0][0]), float(points[0][1]))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        x0, y0, x1, y1 = map(float, (x0, y0, x1, y1))
        out = out.when(x <= x1, F.lit(y0) + (x - x0) / (x1 - x0) * (y1 - y0))
    return out.when(x > float(points[-1][0]), float(points[-1][1]))


def ratio(numerator, denominator) -> Column:
    n, d = col(numerator), col(denominator)
    return F.when(d > 0, n / d)


def yoy(current, prior) -> Column:
    c, p = col(current), col(prior)
    return F.when(p > 0, c / p - 1)


def cagr(latest, earliest, years) -> Column:
    a, b = col(latest), col(earliest)
    if years <= 0:
        return null()
    return F.when((a > 0) & (b > 0), F.pow(a / b, F.lit(1.0 / years)) - 1)


def same_number(a, b, scale=1.0) -> Column:
    """Equal up to half a percent of the largest of both values and ``scale``."""
    a, b = col(a), col(b)
    return F.abs(a - b) <= F.lit(REL) * F.greatest(F.abs(a), F.abs(b), F.lit(scale) if not isinstance(scale, Column) else scale)


def first_of(candidates) -> tuple[Column, Column]:
    """(value, label) of the first non-null candidate; candidates are (value, label) pairs."""
    pairs = [(col(v), F.lit(t) if isinstance(t, str) else t) for v, t in candidates]
    return F.coalesce(*[v for v, _ in pairs]), F.coalesce(*[F.when(v.isNotNull(), t) for v, t in pairs])


def largest_of(candidates) -> tuple[Column, Column]:
    """(value, label) of the largest non-null candidate, the earlier one on ties."""
    pairs = [(col(v), F.lit(t) if isinstance(t, str) else t) for v, t in candidates]
    if len(pairs) == 1:
        return pairs[0][0], F.when(pairs[0][0].isNotNull(), pairs[0][1])
    best = F.greatest(*[v for v, _ in pairs])
    return best, F.coalesce(*[F.when(v == best, t) for v, t in pairs])


def band(x, bands) -> Column:
    """Value of the first band whose upper bound exceeds x; a NULL bound is open."""
    x = col(x)
    out = None
    for top, value in bands:
        hit = F.lit(True) if top is None else x < float(top)
        out = F.when(x.isNotNull() & hit, float(value)) if out is None else out.when(x.isNotNull() & hit, float(value))
    return out


def finite(x) -> Column:
    x = col(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def staleness(date, as_of, threshold_days) -> Column:
    d = col(date)
    return (F.when(d.isNull(), "UNKNOWN")
            .when(F.datediff(as_of, d) > threshold_days, "STALE").otherwise("FRESH"))


def days_between(a, b) -> Column:
    return F.abs(F.datediff(col(a), col(b)))


def sufficient(completeness, minimum) -> Column:
    c = col(completeness)
    return c.isNull() | (c >= minimum)


def total(cols) -> Column:
    """NULL-propagating sum in the given order."""
    return reduce(lambda a, b: a + b, [col(c) for c in cols])


def mean_of(signals) -> tuple[Column, Column]:
    """(mean of the non-null signals, how many there are)."""
    n = total([s.isNotNull().cast("int") for s in signals])
    return F.try_divide(total([F.coalesce(s, F.lit(0.0)) for s in signals]), n), n


def median_of(array) -> Column:
    """Exact median of a small array that holds no NULL."""
    s, n = F.array_sort(array), F.size(array)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def array_sum(array) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)


def stdev_of(array) -> Column:
    """Sample standard deviation of a small array, NULL below two values."""
    n = F.size(array)
    mean = F.try_divide(array_sum(array), n)
    return F.when(n >= 2, F.sqrt(F.aggregate(array, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean)) / (n - 1)))


def slope_of(array) -> Column:
    """Least-squares slope of an evenly spaced series held in array order."""
    n = F.size(array)
    mean_x = (n - 1) / F.lit(2.0)
    mean_y = F.try_divide(array_sum(array), n)
    num = array_sum(F.transform(array, lambda y, i: (i - mean_x) * (y - mean_y)))
    den = array_sum(F.transform(array, lambda y, i: (i - mean_x) * (i - mean_x)))
    return F.when(n >= 2, num / den)
