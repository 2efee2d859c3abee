"""Percentage shares that are not stored but follow from the others."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from areashift.functions.aggregates import clean


def residual_share(parts: Sequence[Column | str], digits: int = 1) -> Column:
    """What the parts leave of 100. NULL when a part is; not clamped at 0."""
    return F.round(reduce(lambda left, part: left - clean(part), parts, F.lit(100.0)), digits)


def complement_share(part: Column | str, digits: int = 1) -> Column:
    """100 minus one share."""
    return residual_share([part], digits)
