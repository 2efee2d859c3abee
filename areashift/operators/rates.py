"""Bring two vintages of a rate together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areashift.functions import to_number
from areashift.operators.joins import Keys, key_pairs, named


def join_vintages(
    current: DataFrame,
    prior: DataFrame,
    keys: Keys,
    current_rate: str,
    prior_rate: str,
    numeric: tuple[str, ...] = (),
    difference: str = "dif",
) -> DataFrame:
    """Units of either vintage, rates as numbers, with current minus prior.

    A unit whose name changed between vintages does not match itself: the name is
    part of the key, so it leaves two half rows.

    Both vintages go through one aggregate over the keys, as a full join could not be split:
    combined on the map side, many rows of one key are found out without meeting in a task.
    A unit that a vintage has twice is refused.
    """
    pairs = key_pairs(keys)
    prior = prior.withColumnsRenamed({b: a for a, b in pairs})
    names = [a for a, _ in pairs]
    rest = {0: [c for c in current.columns if c not in names], 1: [c for c in prior.columns if c not in names]}
    clashes = [c for c in rest[0] if c.lower() in {x.lower() for x in rest[1]}]
    if clashes:
        raise ValueError(f"both vintages have {clashes}; rename them first")

    as_number = {current_rate, prior_rate, *numeric}

    def side(rows: DataFrame, is_current: bool) -> DataFrame:
        # numbers already here, as the greatest of texts would need a sort
        values = [to_number(named(c)).alias(c) if c in as_number else named(c) for c in rest[0 if is_current else 1]]
        return rows.select(*[named(k) for k in names], *values, F.lit(is_current).alias("__current"))

    both = side(current, True).unionByName(side(prior, False), allowMissingColumns=True)
    columns = [*rest[0], *rest[1]]
    of_current = F.col("__current")
    grouped = both.groupBy(*[named(k) for k in names]).agg(
        F.greatest(F.count_if(of_current), F.count_if(~of_current)).alias("__most"),
        *[F.max(named(c)).alias(c) for c in columns],
    )
    message = F.concat(
        F.lit("unit occurs twice in one vintage: "),
        F.concat_ws(", ", *[F.coalesce(named(k).cast("string"), F.lit("NULL")) for k in names]),
    )
    single = F.when(F.col("__most") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    units = grouped.where(single).select(*[named(c) for c in (*current.columns, *rest[1])])
    return units.withColumn(difference, named(current_rate) - named(prior_rate))


def both_present(rows: DataFrame, *measures: str) -> DataFrame:
    """Rows where no measure is missing."""
    return rows.where(F.expr(" AND ".join(f"`{m}` IS NOT NULL" for m in measures)))


def align_vintages(
    current: DataFrame,
    prior: DataFrame,
    keys: Keys,
    current_rate: str,
    prior_rate: str,
    numeric: tuple[str, ...] = (),
    difference: str = "dif",
) -> DataFrame:
    """Units with both rates."""
    joined = join_vintages(
        current, prior, keys, current_rate, prior_rate, numeric, difference
    )
    return both_present(joined, current_rate, prior_rate)
