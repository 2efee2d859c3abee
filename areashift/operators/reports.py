"""Shape a comparison table for charts and publication."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from areashift.functions import recode
from areashift.operators.compare import ALL
from areashift.operators.joins import named


def chart_frame(
    comparison: DataFrame,
    legends: Mapping[str, str],
    excluded_groups: Sequence[str] = (ALL,),
) -> DataFrame:
    """Long rows of the classes that have a legend, without missing differences."""
    shown = comparison.where(
        F.col("class").isin(list(legends))
        & ~F.col("group").isin(list(excluded_groups))
        & F.col("difference").isNotNull()
    )
    return shown.withColumn("legend", recode("class", legends))


def pivoted_report(
    comparison: DataFrame,
    headings: Mapping[str, str],
    group_heading: str = "group",
    excluded_groups: Sequence[str] = (ALL,),
    scale: float = 100.0,
) -> DataFrame:
    """One row per group and one column per class, differences as fractions.

    ``headings`` maps a class to its column heading; any set of classes will do. A
    class the group lacks is NULL. A repeated (class, group) is refused rather than
    silently reduced.
    """
    chosen = comparison.where(
        F.col("class").isin(list(headings)) & ~F.col("group").isin(list(excluded_groups))
    )

    def cell(label: str):
        mine = F.col("class") == label
        refused = F.raise_error(F.lit(f"class {label} occurs twice in one group"))
        value = F.max(F.when(mine, F.col("difference") / scale))
        return F.when(F.count_if(mine) > 1, refused.cast("double")).otherwise(value)

    cells = [cell(label).alias(heading) for label, heading in headings.items()]
    return chosen.groupBy(F.col("group").alias(group_heading)).agg(*cells)


def pivot_order(headings: Mapping[str, str], group_heading: str = "group") -> list:
    """Report order: the first heading ascending, missing last, then the group."""
    first = next(iter(headings.values()))
    return [F.asc_nulls_last(f"`{first}`"), F.asc_nulls_last(f"`{group_heading}`")]


def ranked_report(
    comparison: DataFrame,
    group: str,
    labels: Mapping[str, str],
    headings: Sequence[str],
    index: str | None = "row_id",
    scale: float = 100.0,
    total_label: str = ALL,
) -> DataFrame:
    """The classes of one group without the total, best prior rate first, rates as fractions.

    ``headings`` names the class, prior, current and the two count columns. A class
    without a label is shown with a missing one. The window has no partitions: it runs
    over the classes of one group, as many rows as the comparison has classes.
    """
    shown = comparison.where((F.col("group") == group) & (F.col("class") != total_label))
    values = [
        recode("class", labels),
        F.col("prior") / scale,
        F.col("current") / scale,
        F.col("n_prior"),
        F.col("n_current"),
    ]
    report = shown.select(*[v.alias(h) for v, h in zip(values, headings, strict=True)])
    order = [F.desc_nulls_last(f"`{headings[1]}`"), F.asc_nulls_last(f"`{headings[0]}`")]
    if index is None:
        return report.orderBy(*order)
    position = F.row_number().over(Window.orderBy(*order)).cast("long").alias(index)
    return report.select(position, *[named(h) for h in headings])
