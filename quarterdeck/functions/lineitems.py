"""Statement lines out of one-column-per-tag rows (L1-L11). Each rule gives (value, tag expression)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarterdeck import tags as t
from quarterdeck.functions.scalars import first_of, largest_of, null, same_number

Pair = tuple[Column, Column]


def _pair(tag: str) -> Pair:
    return F.col(tag), F.lit(tag)


def _both(a: Pair, b: Pair, sign: str) -> Pair:
    return (a[0] + b[0] if sign == "+" else a[0] - b[0]), F.when(a[0].isNotNull() & b[0].isNotNull(), F.concat(a[1], F.lit(sign), b[1]))


def cost() -> Pair:
    return first_of([_pair(x) for x in t.COST_CHAIN])


def revenue() -> Pair:
    """L1."""
    candidates = [_pair(t.REVENUE_EXCL_TAX), _pair(t.REVENUES), *[_pair(x) for x in t.INDUSTRY_TOTALS],
                  _both(_pair(t.GROSS_PROFIT), cost(), "+")]
    known = sum((v.isNotNull().cast("int") for v, _ in candidates), F.lit(0))
    largest, chain = largest_of(candidates), first_of([_pair(x) for x in t.REVENUE_CHAIN])
    lone = first_of([_pair(x) for x in t.INDUSTRY_TOTALS])
    return tuple(F.when(known > 1, largest[i]).otherwise(F.coalesce(chain[i], lone[i])) for i in (0, 1))


def gross_profit(rev: Pair) -> Pair:
    """L2."""
    return first_of([_pair(t.GROSS_PROFIT), _both(rev, cost(), "-")])


def operating_income(rev: Pair) -> Pair:
    """L3."""
    return first_of([_pair(t.OPERATING_INCOME), _both(_pair(t.GROSS_PROFIT), _pair(t.OPERATING_EXPENSES), "-"),
                     _both(rev, _pair(t.COSTS_AND_EXPENSES), "-")])


def ocf() -> Pair:
    """L5."""
    return first_of([_pair(x) for x in t.OCF_CHAIN])


def capex() -> Pair:
    return first_of([_pair(x) for x in t.CAPEX_CHAIN])


def flow_lines(wide: DataFrame, keys: list[str]) -> DataFrame:
    """The flow fields of one-column-per-tag rows with ``<field>_tag`` columns next to them."""
    rev = revenue()
    step = wide.withColumns({"revenue": rev[0], "revenue_tag": rev[1]})
    rev = (F.col("revenue"), F.col("revenue_tag"))
    pairs = {"gross_profit": gross_profit(rev), "operating_income": operating_income(rev), "net_income": _pair(t.NET_INCOME),
             "ocf": ocf(), "capex": capex(), "sbc": _pair(t.SBC), "rd_expense": _pair(t.RD), "shares_diluted": _pair(t.DILUTED_SHARES)}
    out = [*keys, "revenue", "revenue_tag"]
    for field, (value, tag) in pairs.items():
        out += [value.alias(field), F.when(value.isNotNull(), tag).alias(f"{field}_tag")]
    return step.select(*out)


def cash_line(value) -> Pair:
    """Cash is required, short-term investments are added when present. ``value(tag)`` gives the usable amount."""
    cce, sti = value(t.CASH), value(t.SHORT_TERM_INVESTMENTS)
    tag = F.when(cce.isNotNull(), F.when(sti.isNotNull(), f"{t.CASH}+{t.SHORT_TERM_INVESTMENTS}").otherwise(t.CASH))
    return cce + F.coalesce(sti, F.lit(0.0)), tag


def _join_tags(*parts: Column) -> Column:
    """One '+' list of the tags named in all parts, each once."""
    return F.concat_ws("+", F.array_distinct(F.split(F.concat_ws("+", *parts), r"\+")))


def family_balance(value, lists) -> Pair:
    """The larger of the total and the sum of both portions of one debt family."""
    total, noncurrent, current = [first_of([(value(x), x) for x in names]) if names else (null(), null("string")) for names in lists]
    both = F.when(noncurrent[0].isNotNull() | current[0].isNotNull(),
                  F.coalesce(noncurrent[0], F.lit(0.0)) + F.coalesce(current[0], F.lit(0.0)))
    return largest_of([total, (both, F.concat_ws("+", noncurrent[1], current[1]))])


def specific_families(df: DataFrame, value) -> DataFrame:
    """L8 over all product families: adds ``specific`` and ``specific_tag``, the sum of the families present."""
    balances = {f: family_balance(value, lists) for f, lists in t.SPECIFIC_FAMILIES.items()}
    df = df.withColumns({**{f"_{f}": v for f, (v, _) in balances.items()}, **{f"_{f}_tag": g for f, (_, g) in balances.items()}})
    cols = [F.col(f"_{f}") for f in balances]
    some = F.coalesce(*cols).isNotNull()
    summed = sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0)))
    return df.withColumns({
        "specific": F.when(some, summed),
        "specific_tag": F.when(some, F.concat_ws("+", *[F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}_tag")) for f in balances])),
    }).drop(*[f"_{f}{s}" for f in balances for s in ("", "_tag")])


def current_portion(df: DataFrame, value) -> DataFrame:
    """Adds ``current``, ``current_tag`` and ``current_inside``, the part that the long-term family already holds."""
    lt_cur, lt_non, lt_all, rollup = value(t.LTD_CURRENT), value(t.LTD_NONCURRENT), value(t.LTD), value(t.DEBT_CURRENT)
    short = first_of([(value(x), x) for x in t.SHORT_TERM_BORROWINGS])
    df = df.withColumns({"_short": short[0], "_short_tag": short[1]})
    st, st_tag = F.col("_short"), F.col("_short_tag")
    is_portion = F.coalesce(lt_all == lt_non + st, F.lit(False))
    separate = F.coalesce(lt_all == lt_non + lt_cur, F.lit(False))
    contained = is_portion | (~separate & same_number(lt_cur, st))
    pack = lambda v, tag, inside: F.struct(v.alias("value"), tag.alias("tag"), inside.alias("inside"))
    parts = (F.when(lt_cur.isNotNull() & st.isNotNull(),
                    F.when(contained & (lt_cur >= st), pack(lt_cur, F.lit(t.LTD_CURRENT), lt_cur))
                    .when(contained, pack(st, st_tag, st))
                    .otherwise(pack(lt_cur + st, F.concat(F.lit(t.LTD_CURRENT + "+"), st_tag), lt_cur)))
             .when(lt_cur.isNotNull(), pack(lt_cur, F.lit(t.LTD_CURRENT), lt_cur))
             .when(st.isNotNull(), pack(st, st_tag, F.lit(0.0))))
    inside = F.when(lt_cur.isNotNull(), F.least(lt_cur, rollup)).otherwise(0.0)
    whole = F.when(rollup.isNotNull(), pack(rollup, F.lit(t.DEBT_CURRENT), inside))
    df = df.withColumns({"_whole": whole, "_parts": parts})
    best = F.when(F.col("_whole").isNull() | (F.col("_parts.value") > F.col("_whole.value")), F.coalesce("_parts", "_whole")).otherwise(F.col("_whole"))
    return (df.withColumn("_cur", best)
            .withColumns({"current": F.col("_cur.value"), "current_tag": F.col("_cur.tag"), "current_inside": F.col("_cur.inside")})
            .drop("_whole", "_parts", "_cur", "_short_tag"))


def lease_at(as_of, date_of, anchor_tag: str, region: str) -> Pair:
    """The finance lease of a region that was measured on the same date as ``anchor_tag``."""
    def usable(tag):
        same = F.coalesce(date_of(tag) == date_of(anchor_tag), F.lit(True))
        return F.when(same, as_of(tag))
    return first_of([(usable(x), x) for x in t.FINANCE_LEASES[region]])


def lease_free(as_of, date_of, rollup_tag: str, region: str) -> Pair:
    """A lease-inclusive rollup without the finance lease of its region; nothing when that leaves no debt."""
    lease, lease_tag = lease_at(as_of, date_of, rollup_tag, region)
    net = as_of(rollup_tag) - F.coalesce(lease, F.lit(0.0))
    tag = F.when(lease.isNull(), rollup_tag).otherwise(F.concat(F.lit(rollup_tag + "-"), lease_tag))
    return F.when(net > 0, net), F.when(net > 0, tag)


def total_debt(df: DataFrame, value, as_of, date_of) -> DataFrame:
    """Adds ``total_debt`` and ``total_debt_tag``.

    ``value(tag)`` is the amount that may still be used after carry-forward, ``as_of(tag)`` and ``date_of(tag)`` the
    newest amount and its date.
    """
    df = current_portion(specific_families(df, value), value)
    spanning = lease_free(as_of, date_of, t.LEASED_SPANNING, "spanning")
    noncurrent = lease_free(as_of, date_of, t.LEASED_NONCURRENT, "noncurrent")
    lease = lease_at(as_of, date_of, t.DEBT_CURRENT, "current")
    df = df.withColumns({"_sp": spanning[0], "_sp_tag": spanning[1], "_nc": noncurrent[0], "_nc_tag": noncurrent[1],
                         "_cl": lease[0], "_cl_tag": lease[1]})
    col, zero = F.col, F.lit(0.0)
    cur, cur_tag, spec, spec_tag = col("current"), col("current_tag"), col("specific"), col("specific_tag")
    lt_non, lt_cur, lt_all = value(t.LTD_NONCURRENT), value(t.LTD_CURRENT), value(t.LTD)
    no_long = lt_non.isNull() & lt_all.isNull()
    beats = lambda v: v.isNotNull() & (spec.isNull() | (v >= spec))
    # current part next to a noncurrent rollup, without the lease when it came from the rollup of current debt
    netted = F.greatest(zero, cur - col("_cl"))
    by_rollup = cur_tag.contains(t.DEBT_CURRENT) & col("_cl").isNotNull()
    side = F.when(by_rollup, F.when(netted != 0, netted)).otherwise(cur)
    side_tag = F.when(by_rollup, F.when(netted != 0, F.concat(cur_tag, F.lit("-"), col("_cl_tag")))).otherwise(cur_tag)
    portions = lt_non + F.coalesce(lt_cur, zero)
    all_larger = F.coalesce(lt_all, zero) > portions
    core = F.greatest(F.coalesce(lt_all, zero), portions)
    core_tag = (F.when(all_larger, t.LTD).when(lt_cur.isNotNull(), f"{t.LTD_NONCURRENT}+{t.LTD_CURRENT}").otherwise(t.LTD_NONCURRENT))
    outside = F.coalesce(F.greatest(zero, cur - col("current_inside")), zero)
    spec_over_all, spec_over_cur = spec > lt_all, spec > cur
    short_tag = first_of([(value(x), x) for x in t.SHORT_TERM_BORROWINGS])[1]
    tiers = [
        (value(t.DEBT_COMBINED).isNotNull(), value(t.DEBT_COMBINED), F.lit(t.DEBT_COMBINED)),
        (no_long & beats(col("_sp")), col("_sp"), col("_sp_tag")),
        (no_long & beats(col("_nc")), col("_nc") + F.coalesce(side, zero), _join_tags(col("_nc_tag"), side_tag)),
        (lt_non.isNotNull(), core + outside, _join_tags(core_tag, F.when(outside > 0, cur_tag))),
        (lt_all.isNotNull(), F.when(spec_over_all, spec).otherwise(lt_all) + F.coalesce(cur, zero),
         _join_tags(F.when(spec_over_all, spec_tag).otherwise(F.lit(t.LTD)), cur_tag)),
        # short-term borrowings alone do not reach this tier: the next one adds them to the product families
        (cur.isNotNull() & (lt_cur.isNotNull() | value(t.DEBT_CURRENT).isNotNull()),
         F.when(spec_over_cur, spec).otherwise(cur), F.when(spec_over_cur, spec_tag).otherwise(cur_tag)),
        (spec.isNotNull() | col("_short").isNotNull(), F.coalesce(spec, zero) + F.coalesce(col("_short"), zero),
         F.concat_ws("+", spec_tag, short_tag)),
    ]
    amount, label = None, None
    for when, v, tag in tiers:
        amount = F.when(when, v) if amount is None else amount.when(when, v)
        label = F.when(when, tag) if label is None else label.when(when, tag)
    return (df.withColumns({"_amount": amount, "_label": label})
            .withColumns({"total_debt": F.when(col("_amount") != 0, col("_amount")),
                          "total_debt_tag": F.when(col("_amount") != 0, col("_label"))})
            .drop("_amount", "_label", "_sp", "_sp_tag", "_nc", "_nc_tag", "_cl", "_cl_tag", "_short"))
