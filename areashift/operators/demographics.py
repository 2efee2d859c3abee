"""From survey variables to named measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areashift.functions import clean, complement_share, residual_share, split_code
from areashift.operators.joins import named
from areashift.schemas import Demographics


def widen_variables(
    facts: DataFrame,
    variables: Sequence[str],
    keys: Sequence[str] = ("GEOID", "NAME"),
    variable: str = "variable",
    estimate: str = "estimate",
    margin: str | None = "moe",
) -> DataFrame:
    """One row per unit; per variable its estimate ``<variable>E`` and margin ``<variable>M``.

    One aggregate of conditional maxima: a pivot would group twice and shuffle twice.
    A unit that repeats a variable is refused, as the maximum would hide it.
    """
    cells = []
    for v in variables:
        mine = F.col(variable) == v
        refused = F.raise_error(F.lit(f"variable {v} occurs twice for one unit"))
        for column, mark in ((estimate, "E"), (margin, "M")):
            if column is None:
                continue
            value = F.max(F.when(mine, clean(column)))
            if mark == "E":
                value = F.when(F.count_if(mine) > 1, refused.cast("double")).otherwise(value)
            cells.append(value.alias(f"{v}{mark}"))
    wanted = facts.where(F.col(variable).isin(list(variables)))
    return wanted.groupBy(*[named(k) for k in keys]).agg(*cells)


def clean_demographics(wide: DataFrame, vintage: Demographics, split: bool = True) -> DataFrame:
    """Named estimates with the residual and complement shares; margins are dropped.

    ``split`` adds the state, county and tract codes cut out of the unit's id.
    """
    columns = ["GEOID"]
    codes = split_code("GEOID", (2, 5), ("state", "county", "tract")) if split else []
    named_estimates = [
        clean(named(source)).alias(measure) for source, measure in vintage.columns.items()
    ]
    tidy = wide.select(*columns, *codes, "NAME", *named_estimates)
    return tidy.withColumns(
        {"other": residual_share(vintage.whole), "nonwh": complement_share("white")}
    )
