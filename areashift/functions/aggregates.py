"""Aggregates with explicit missing-value rules.

Each is a composition of ``sum`` over row expressions, so Spark pre-aggregates on
the map side and a group holding a third of the rows costs one small buffer per
task. "Missing" is always NULL in a result; NaN is used only inside a sum, where it
marks a group that saw a missing value it may not skip.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _nan() -> Column:
    return F.lit(float("nan"))


def _null() -> Column:
    return F.lit(None).cast("double")


def clean(c: Column | str) -> Column:
    """The number as a double, with NaN turned into NULL (Spark sorts NaN above all numbers)."""
    return F.nanvl(as_column(c).cast("double"), _null())


#: Steps of the whole numbers that a double is cut into for an exact sum, as powers of two.
#: The first holds values below 2^100; what is finer than 2^-80 is rounded in every row.
LIMBS = (40, 0, -40, -80)
#: Bits of such a whole number, which has 60 at most, that are added apart from those above.
HALF = 30


def exact_sum(x: Column | str) -> Column:
    """Sum that does not depend on the order of rows or on partitions, to the last bit.

    Every value is cut into whole multiples of 2^40, 1, 2^-40 and 2^-80. Each of these is
    added as two whole numbers of 30 bits and what is above, so nothing is rounded before
    the end and no sum of less than 2^33 rows overflows (more fail where they do), and they
    combine on the map side like any sum. Values from 2^100 on and those that are no numbers
    are added apart, as doubles. NULL over no values.
    """
    x = as_column(x).cast("double")
    usual = F.abs(x) < 2.0**100  # not so for NaN, which Spark takes for the largest
    rest = F.when(usual, x)
    parts = []
    for power in LIMBS:
        limb = F.rint(rest * F.lit(2.0**-power))
        whole = limb.cast("long")
        above = F.sum(F.shiftright(whole, HALF)).cast("decimal(19,0)")
        below = F.sum(whole.bitwiseAND(F.lit((1 << HALF) - 1)))
        both = above * F.lit(1 << HALF).cast("decimal(10,0)") + below.cast("decimal(19,0)")
        parts.append(both.cast("double") * F.lit(2.0**power))
        rest = rest - limb * F.lit(2.0**power)
    high, *low = parts
    for part in low:
        high = high + part
    odd = F.sum(F.when(~usual, x))
    return F.coalesce(high + odd, high, odd)


def weighted_mean(
    x: Column | str,
    w: Column | str,
    na_rm: bool = True,
    where: Column | None = None,
    add: Callable[[Column], Column] = F.sum,
) -> Column:
    """Mean of ``x`` weighted by ``w``, over the rows where ``where`` holds.

    ``na_rm=True`` skips rows with missing ``x``; a missing weight on a remaining row
    makes the mean missing. ``na_rm=False`` makes it missing for any missing weight,
    or a missing ``x`` whose weight is not zero. No weight at all gives NULL. ``add`` is the
    sum used, ``exact_sum`` where results must be equal to the last bit.
    """
    x, w = clean(x), clean(w)
    term = F.when(w == 0, F.lit(0.0)).otherwise(F.coalesce(x, _nan()) * F.coalesce(w, _nan()))
    if na_rm:
        where = x.isNotNull() if where is None else where & x.isNotNull()
    if where is not None:
        term, w = F.when(where, term), F.when(where, w)
    return F.nanvl(F.try_divide(add(term), add(w)), _null())


def allocate_sum(
    x: Column | str, percent: Column | str, add: Callable[[Column], Column] = F.sum
) -> Column:
    """Sum of ``x * percent / 100`` over the rows where both are known; 0 when none is."""
    return F.coalesce(add(clean(x) * clean(percent) / 100), F.lit(0.0))


def total(x: Column | str, add: Callable[[Column], Column] = F.sum) -> Column:
    """Sum of the known values; 0 when there are none."""
    return F.coalesce(add(clean(x)), F.lit(0.0))


def strict_sum(x: Column | str, add: Callable[[Column], Column] = F.sum) -> Column:
    """Sum that is missing when any value is missing; 0 over no rows."""
    return F.nanvl(F.coalesce(add(F.coalesce(clean(x), _nan())), F.lit(0.0)), _null())
