"""Roll unit rates up to one figure under alternative weights, and explain the gaps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from areashift.functions import strict_sum, to_number, weighted_mean
from areashift.operators.joins import Keys, full_join, left_join, named


def sums_by(rows: DataFrame, key: str, sums: Mapping[str, str]) -> DataFrame:
    """Strict sums per key; ``sums`` maps an output name to the column summed."""
    return rows.groupBy(key).agg(*[strict_sum(named(c)).alias(n) for n, c in sums.items()])


def regional_frame(
    weights: DataFrame,
    rates: DataFrame,
    keys: Keys,
    numeric: Sequence[str],
    alternatives: Sequence[DataFrame],
    key: str,
) -> DataFrame:
    """Weights and rates of each unit, with further columns attached by the unit's key.

    Each alternative holds ``key`` and its own columns, one row per unit; attaching by
    key does not depend on the tables listing the units in the same order.
    """
    frame = full_join(weights, rates, keys)
    frame = frame.withColumns({c: to_number(named(c)) for c in numeric})
    for alternative in alternatives:
        frame = left_join(frame, alternative, [key])
    return frame


def regional_rollup(frame: DataFrame, means: Mapping[str, tuple[str, str]]) -> DataFrame:
    """One row of strict weighted means; ``means`` maps a name to (rate, weight)."""
    return frame.agg(
        *[
            weighted_mean(named(rate), named(weight), na_rm=False).alias(name)
            for name, (rate, weight) in means.items()
        ]
    )


def discrepancy(
    units: DataFrame,
    key: str,
    rate: str,
    weight: str,
    frame: DataFrame,
    shown: Sequence[str],
    name: str = "unit_mean",
) -> DataFrame:
    """Mean of the units per key beside the key's own figures."""
    means = units.groupBy(key).agg(
        weighted_mean(named(rate), named(weight), na_rm=False).alias(name)
    )
    return left_join(means, frame.select(named(key), *[named(c) for c in shown]), [key])
