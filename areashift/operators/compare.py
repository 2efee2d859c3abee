"""Weighted comparison of two periods by class and group, with totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areashift.functions import clean, exact_sum, weighted_mean
from areashift.operators.joins import named

ALL = "all"


@dataclass(frozen=True)
class Period:
    """Which columns hold a period's class, rate and weight."""

    label: str
    rate: str
    weight: str


def _label(dimension: str, total_label: str) -> Column:
    # grouping() tells a total from a group whose own key is NULL; one whose key reads like
    # the total would be taken for it.
    own = named(dimension).cast("string")
    refused = F.raise_error(F.lit(f"{dimension} has a value named like the total: {total_label}"))
    return (
        F.when(F.grouping(named(dimension)) == 1, F.lit(total_label))
        .when(own == total_label, refused.cast("string"))
        .otherwise(own)
        .alias(dimension)
    )


def totals_cube(
    rows: DataFrame,
    dimensions: Sequence[str],
    measures: Mapping[str, Column],
    total_label: str = ALL,
) -> DataFrame:
    """Measures for every combination of the dimensions and of their totals."""
    cube = rows.cube(*[named(d) for d in dimensions]).agg(
        *[_label(d, total_label).alias(f"__{d}") for d in dimensions],
        *[measure.alias(name) for name, measure in measures.items()],
    )
    return cube.select(*[named(f"__{d}").alias(d) for d in dimensions], *measures)


def _by_period(
    units: DataFrame, group: str, prior: Period, current: Period, unit: Sequence[str]
) -> DataFrame:
    """One row per unit and period, where both rate and weight are known."""

    def entry(period: Period, is_prior: bool) -> Column:
        return F.struct(
            F.lit(is_prior).alias("__prior"),
            named(period.label).cast("string").alias("class"),
            clean(named(period.rate)).alias("__rate"),
            clean(named(period.weight)).alias("__weight"),
        )

    both = F.inline(F.array(entry(prior, True), entry(current, False)))
    kept = [named(u).alias(f"__unit{i}") for i, u in enumerate(unit)]
    return units.select(named(group).cast("string").alias("group"), *kept, both).where(
        F.col("__rate").isNotNull() & F.col("__weight").isNotNull()
    )


def _period_measures(copies: Column | None = None, exact: bool = False) -> dict[str, Column]:
    """Mean and count per period; a row stands for ``copies`` rows where that is given."""
    is_prior = F.col("__prior")
    weight = F.col("__weight") if copies is None else F.col("__weight") * copies

    def mean(which: Column) -> Column:
        add = exact_sum if exact else F.sum
        return weighted_mean("__rate", weight, na_rm=False, where=which, add=add)

    def count(which: Column) -> Column:
        if copies is None:
            return F.count_if(which)
        return F.sum(F.when(which, copies).otherwise(F.lit(0)))

    return {
        "prior": mean(is_prior),
        "current": mean(~is_prior),
        "n_prior": count(is_prior),
        "n_current": count(~is_prior),
    }


def _once_in_total(long: DataFrame, total_label: str, exact: bool = False) -> DataFrame:
    """Cells in which the total over groups holds a unit once, however many groups it has.

    Grouping by everything but the group first leaves one row per unit for the total,
    beside its rows per group, in one pass over ``long``.
    """
    rest = [c for c in long.columns if c != "group"]
    rows = long.groupingSets(
        [[F.col("group"), *map(F.col, rest)], [*map(F.col, rest)]], "group", *rest
    ).agg(F.grouping("group").alias("__total"), F.count(F.lit(1)).alias("__rows"))
    is_total = F.col("__total") == 1
    rows = rows.withColumn("__copies", F.when(is_total, F.lit(1)).otherwise(F.col("__rows")))
    measures = _period_measures(F.col("__copies"), exact)
    cells = rows.groupingSets(
        [["class", "group", "__total"], ["group", "__total"]], "class", "group", "__total"
    ).agg(
        _label("class", total_label).alias("__class"),
        *[measure.alias(name) for name, measure in measures.items()],
    )
    refused = F.raise_error(F.lit(f"a group is named like the total: {total_label}"))
    group = (
        F.when(is_total, F.lit(total_label))
        .when(F.col("group") == total_label, refused.cast("string"))
        .otherwise(F.col("group"))
    )
    return cells.select(F.col("__class").alias("class"), group.alias("group"), *measures)


def compare_periods(
    units: DataFrame,
    group: str,
    prior: Period,
    current: Period,
    total_label: str = ALL,
    dedupe_total: bool = False,
    unit: Sequence[str] = (),
    exact: bool = False,
) -> DataFrame:
    """Columns class, group, prior, current, difference, n_prior, n_current.

    Units are classed anew in each period, so ``difference`` holds both the change of
    rates and the change of membership. A (class, group) known only in the current
    period is left out. ``n`` counts units, those without weight too.

    A unit in two groups counts twice in the total over groups. With
    ``dedupe_total=True`` it counts once; ``unit`` then names its key columns.

    Both periods go through one aggregate: each unit is laid out as one row per
    period, so the plan above ``units`` runs once and nothing has to be cached. With
    ``exact`` means do not depend on how units are dealt, to the last bit.
    """
    long = _by_period(units, group, prior, current, unit if dedupe_total else ())
    if dedupe_total:
        if not unit:
            raise ValueError("dedupe_total needs the unit's key columns")
        cells = _once_in_total(long, total_label, exact)
    else:
        cells = totals_cube(long, ["class", "group"], _period_measures(exact=exact), total_label)
    return cells.where(F.col("n_prior") > 0).select(
        "class",
        "group",
        "prior",
        "current",
        (F.col("current") - F.col("prior")).alias("difference"),
        "n_prior",
        F.nullif(F.col("n_current"), F.lit(0)).alias("n_current"),
    )


def class_view(comparison: DataFrame, label: str) -> DataFrame:
    """The comparison's rows of one class."""
    return comparison.where(F.col("class") == label)
