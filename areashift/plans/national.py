"""National comparison: peer metro groups by majority class, two periods."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from areashift.functions import key_prefix, majority_class
from areashift.operators.compare import ALL, Period, class_view, compare_periods
from areashift.operators.joins import restrict_to
from areashift.operators.peers import assign_groups, focus, top_k
from areashift.operators.reports import (
    chart_frame,
    pivot_order,
    pivoted_report,
    ranked_report,
)
from areashift.plans.inputs import (
    Paths,
    interpolate_tracts,
    join_response,
    response,
    tract_demographics,
)
from areashift.schemas import (
    CLASS_LABELS,
    CLASS_ORDER,
    LEGENDS,
    PEERS,
    PIVOT_HEADINGS,
    POPULATION,
    RANKED_HEADINGS,
    THRESHOLD,
)
from areashift.sources.readers import pull_demographics, read_crosswalk, read_group_lookup
from areashift.sources.writers import materialize, write_export, write_report

PRIOR = Period("race_maj10", "FSRR2010", "hunit10")
CURRENT = Period("race_maj18", "CRRALL", "hunit18")


def classify(units: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Majority class in each vintage."""
    return units.withColumns(
        {
            f"race_maj{s}": majority_class({c: f"{c}{s}" for c in CLASS_ORDER}, threshold)
            for s in ("10", "18")
        }
    )


def in_counties(rows: DataFrame, code: str, counties: DataFrame) -> DataFrame:
    """Rows whose tract code starts with one of the counties' codes."""
    prefixed = rows.withColumn("__county", key_prefix(code, 5))
    return restrict_to(prefixed, "__county", counties, "County_GEOID").drop("__county")


def tract_units(
    spark: SparkSession,
    paths: Paths,
    unallocated: bool = True,
    counties: DataFrame | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The central table: interpolated demographics, rates and classes per new tract.

    A new tract depends on its own crosswalk rows only, so with ``counties`` all others
    are left out before anything is joined, and rates and demographics of states that none
    of these rows come from are not read. Old tracts outside the crosswalk gather under no
    new tract, so where that row is wanted their states are read as well.
    """
    crosswalk = read_crosswalk(spark, paths.crosswalk)
    old_states, new_states = None, None
    if counties is not None:
        crosswalk = in_counties(crosswalk, "GEOID20", counties)
        new_states = counties.select(key_prefix("County_GEOID", 2).alias("state"))
        if not unallocated:
            old_states = crosswalk.select(key_prefix("GEOID10", 2).alias("state"))
    rated = response(spark, paths, "tract", new_states)
    if counties is not None:
        rated = in_counties(rated, "GEOID", counties)
    interpolated = interpolate_tracts(
        crosswalk, *tract_demographics(spark, paths, states=old_states), unallocated=unallocated
    )
    return classify(join_response(interpolated, rated), threshold)


def peer_metros(spark: SparkSession, paths: Paths, k: int = PEERS) -> DataFrame:
    """The largest metro areas by population."""
    wide = pull_demographics(spark, paths.facts, 2018, "acs5", [POPULATION], "metro")
    sizes = wide.selectExpr("NAME", f"{POPULATION}E AS Popul", "GEOID")
    return top_k(sizes, "Popul", k, "GEOID")


def metro_units(
    spark: SparkSession, paths: Paths, k: int = PEERS, threshold: float = THRESHOLD
) -> DataFrame:
    """Tracts of the peer metro areas, once per group they belong to."""
    lookup = read_group_lookup(spark, paths.group_lookup)
    peers = restrict_to(lookup, "MSA_GEOID", peer_metros(spark, paths, k), "GEOID")
    units = tract_units(spark, paths, False, peers, threshold).withColumn(
        "stateCountyFIPS", key_prefix("GEOID20", 5)
    )
    return assign_groups(units, peers, "stateCountyFIPS", "County_GEOID")


def compare(units: DataFrame, dedupe_total: bool = False) -> DataFrame:
    """Housing-weighted mean rates by class and metro, with totals and differences."""
    return compare_periods(
        units, "MSA", PRIOR, CURRENT, dedupe_total=dedupe_total, unit=["GEOID20"]
    )


def published(comparison: DataFrame) -> DataFrame:
    """The comparison under its published column names."""
    return comparison.selectExpr(
        "class AS race",
        "prior AS responses10",
        "current AS responses20",
        "difference",
        "n_prior AS n10",
        "n_current AS n20",
        "`group` AS MSA",
    )


def run(
    spark: SparkSession,
    paths: Paths,
    out: str,
    focus_label: str,
    headings: Mapping[str, str] = PIVOT_HEADINGS,
    threshold: float = THRESHOLD,
    peers: int = PEERS,
) -> dict[str, DataFrame]:
    """Write the focus tracts, the comparison, its views by class, the chart's data and both
    reports under ``out``.

    ``headings`` are the classes and columns of the report of changes, ``threshold`` the
    share above which a class is the majority, ``peers`` the number of groups. The tracts and the comparison feed several outputs each, so they are written once
    as tables and read back. Returns the tables by name.
    """
    units = materialize(metro_units(spark, paths, peers, threshold), f"{out}/tables/metro_units")
    comparison = materialize(compare(units), f"{out}/tables/comparison")

    write_export(focus(units, "MSA", focus_label), f"{out}/focus_tracts")
    pivoted = pivoted_report(
        comparison, headings, "MSA", excluded_groups=[ALL, focus_label]
    )
    write_report(pivoted, pivot_order(headings, "MSA"), f"{out}/group_changes")
    ranked = ranked_report(comparison, focus_label, CLASS_LABELS, RANKED_HEADINGS)
    write_report(ranked, ["row_id"], f"{out}/class_ranking", index=None)

    views = {c: class_view(comparison, c) for c in [ALL, *CLASS_LABELS]}
    for label, view in views.items():
        write_export(published(view), f"{out}/class_{label}")
    write_export(published(comparison), f"{out}/comparison")
    write_export(chart_frame(comparison, LEGENDS), f"{out}/chart")
    return {
        "units": units,
        "comparison": published(comparison),
        "chart": chart_frame(comparison, LEGENDS),
        "pivoted": pivoted,
        "ranked": ranked,
        **{f"class_{c}": view for c, view in views.items()},
    }
