"""Cash-flow expressions: prices from a target return, returns by bisection, growth rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def noi(price: Column, cap_rate: Column) -> Column:
    return price * cap_rate


def prices(irr: Column, exit_cap: Column, entry_noi: Column, growth: Column, years: int) -> tuple[Column, Column]:
    """Entry and exit price: the discounted income of ``years`` years plus the sale at next year's income over the exit rate."""
    income = [entry_noi * F.pow(1 + growth, F.lit(t)) for t in range(years + 1)]
    exit_price = F.try_divide(income[years], exit_cap)
    entry = exit_price / F.pow(1 + irr, F.lit(years))
    for t in range(years):
        entry = entry + income[t] / F.pow(1 + irr, F.lit(t + 1))
    return entry, exit_price


def _root(f, columns: list[Column], low: float, high: float, steps: int = 60) -> Column:
    """Bisection of an increasing or decreasing function of one number, whole batches at once: ``f(x, *columns)`` works on
    arrays. Null if the signs at both ends are the same or not known (a null or NaN among the columns)."""

    @F.pandas_udf("double")
    def run(*values):
        import numpy as np
        import pandas as pd

        v = [x.to_numpy(np.float64) for x in values]
        with np.errstate(all="ignore"):
            a, b = np.full(len(v[0]), low), np.full(len(v[0]), high)
            start, end = np.sign(f(a, *v)), np.sign(f(b, *v))
            known = (start != end) & ~np.isnan(start) & ~np.isnan(end)
            for _ in range(steps):
                m = (a + b) / 2
                same = np.sign(f(m, *v)) == start  # the sign at ``a`` never changes
                a, b = np.where(same, m, a), np.where(same, b, m)
            return pd.Series(np.where(known, (a + b) / 2, np.nan))

    found = run(*[c.cast("double") for c in columns])
    return F.when(~F.isnan(found), found)


def _worth(income, growth, rate, years: int, sale):
    """The worth at ``rate`` of ``years`` incomes that grow, and of a sale after them at ``sale`` times the next income; on numbers or arrays."""
    step, total, power = (1 + growth) / (1 + rate), 0.0, 1.0
    for _ in range(years):
        total, power = total + power, power * step
    return income * (total / (1 + rate) + sale * power)


def irr(entry: Column, exit_: Column, entry_cap: Column, growth: Column, years: int) -> Column:
    """The rate at which income and exit are worth the entry price; null if there is none between -90 % and 1000 %."""

    def gap(r, entry, exit_, cap, growth):
        return _worth(entry * cap, growth, r, years, 0.0) + exit_ / (1 + r) ** years - entry

    return _root(gap, [entry, exit_, entry_cap, growth], -0.9, 10.0)


def implied_growth(target: Column, exit_cap: Column, entry: Column, entry_cap: Column, years: int) -> Column:
    """The income growth at which the entry price gives the target return; null if there is none between -90 % and 200 %."""

    def gap(g, target, exit_cap, entry, cap):
        return _worth(entry * cap, g, target, years, 1 / exit_cap) - entry

    return _root(gap, [target, F.nullif(exit_cap.cast("double"), F.lit(0.0)), entry, entry_cap], -0.9, 2.0)


def cap_rate_growth(price_growth: Column, noi_growth: Column) -> Column:
    return F.try_divide(1 + noi_growth, 1 + price_growth) - 1


def noi_growth(price_growth: Column, cap_growth: Column) -> Column:
    return (1 + price_growth) * (1 + cap_growth) - 1
