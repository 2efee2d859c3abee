"""Build an overlap crosswalk: which share of each unit lies in which other unit."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areashift.functions import clean
from areashift.operators.joins import left_join, named


def build_crosswalk(
    overlaps: DataFrame,
    source: str,
    target: str,
    shares: Mapping[str, tuple[str | None, str | None]],
) -> DataFrame:
    """One row per overlapping pair, with percent shares of the source and of the target.

    ``shares`` maps a quantity column to the names of its (share of source, share of
    target) columns; None leaves a share out, and leaving out all of one side saves
    shuffling the pairs by that unit. A share is NULL where the unit's total is 0 or
    unknown.

    Unit totals are grouped sums joined back, not window sums: a window would bring
    all pairs of one unit into one task. The join on the source comes last, so that a
    later join on the source finds the pairs already partitioned.
    """
    pairs = overlaps.groupBy(source, target).agg(
        *[F.sum(clean(named(q))).alias(f"__q{i}") for i, q in enumerate(shares)]
    )

    # (unit, output share name, quantity) in the order the columns come out.
    wanted = [
        (unit, name, i)
        for i, names in enumerate(shares.values())
        for unit, name in zip((source, target), names)
        if name is not None
    ]
    whole = pairs
    for unit, prefix in ((target, "__t"), (source, "__s")):
        needed = [i for of, _, i in wanted if of == unit]
        if needed:
            totals = pairs.groupBy(unit).agg(
                *[F.sum(f"__q{i}").alias(f"{prefix}{i}") for i in needed]
            )
            whole = left_join(whole, totals, [unit])

    percents = [
        F.try_divide(
            100 * F.col(f"__q{i}"), F.col(f"{'__s' if unit == source else '__t'}{i}")
        ).alias(name)
        for unit, name, i in wanted
    ]
    return whole.select(named(source), named(target), *percents)
