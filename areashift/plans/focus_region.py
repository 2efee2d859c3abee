"""Targeted pull for one region, and the checks that the interpolation holds there."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areashift.operators.cases import case_verdicts as verdicts_by_case
from areashift.operators.checks import (
    Conserved,
    closed_case_check,
    conservation_check,
    inherited_check,
    missing_report,
    target_check,
)
from areashift.operators.frames import frame_equality
from areashift.operators.interpolate import SourceSet
from areashift.operators.joins import left_join, restrict_to
from areashift.operators.peers import partition_union
from areashift.operators.rates import join_vintages
from areashift.plans.inputs import (
    Paths,
    Region,
    demographics,
    interpolate_tracts,
    join_response,
    rates,
    region_crosswalk,
    response,
    tract_demographics,
    unit_keys,
)
from areashift.schemas import DEMOGRAPHICS_2018
from areashift.sources.readers import read_crosswalk, read_place_list
from areashift.sources.writers import materialize, write_export


@dataclass(frozen=True)
class Case:
    """Old tracts and the new tracts they became."""

    sources: tuple[str, ...]
    targets: tuple[str, ...]


# The tracts looked at one by one.
MERGED = Case(("17031490400", "17031490300"), ("17031490200",))
SPLIT = Case(("17031806003",), ("17031806005", "17031806006"))
REDRAWN = Case(("17197980100", "17197884103", "17197880903"), ("17197880903",))

VINTAGES = {"10": ("HU10PCT_T10", "HU10PCT_T20"), "18": ("HUCURPCT_T10", "HUCURPCT_T20")}


@dataclass(frozen=True)
class RegionTables:
    crosswalk: DataFrame
    demographics_2010: DataFrame
    demographics_2018: DataFrame
    interpolated: DataFrame

    def vintage(self, suffix: str) -> DataFrame:
        return {"10": self.demographics_2010, "18": self.demographics_2018}[suffix]


def region_tables(spark: SparkSession, paths: Paths, region: Region = Region()) -> RegionTables:
    """The region's crosswalk and demographics, filtered at the source, and interpolated."""
    crosswalk = region_crosswalk(read_crosswalk(spark, paths.crosswalk), region)
    before = tract_demographics(spark, paths, region)
    return RegionTables(crosswalk, *before, interpolate_tracts(crosswalk, *before))


def region_response(spark: SparkSession, paths: Paths, region: Region = Region()) -> DataFrame:
    """Tracts of the region with both rates."""
    tracts = response(spark, paths, "tract", region.state)
    return tracts.where(F.col("county").isin(list(region.counties)))


def region_tracts(spark: SparkSession, paths: Paths, region: Region = Region()) -> DataFrame:
    """Interpolated demographics joined to the region's rates."""
    interpolated = region_tables(spark, paths, region).interpolated
    return join_response(interpolated, region_response(spark, paths, region))


def place_response(spark: SparkSession, paths: Paths, region: Region = Region()) -> DataFrame:
    """Listed places with both rates."""
    places = response(spark, paths, "place", region.state)
    return restrict_to(places, "GEO_ID", read_place_list(spark, paths.place_list), "GEO_ID")


def region_places(spark: SparkSession, paths: Paths, region: Region = Region()) -> DataFrame:
    """Listed places with rates and demographics."""
    measures = demographics(spark, paths, DEMOGRAPHICS_2018, 2018, "place", region.state)
    return left_join(place_response(spark, paths, region), measures, ["GEOID", "NAME"])


def missing_responses(
    spark: SparkSession, paths: Paths, geography: str, region: Region = Region()
) -> DataFrame:
    """How many of the state's units lack a rate in either period."""
    current, prior = rates(spark, paths, geography, region.state)
    joined = join_vintages(current, prior, unit_keys(geography), "CRRALL", "FSRR2010")
    return missing_report(joined, ["CRRALL", "FSRR2010"])


def conservation(tables: RegionTables, tolerance: float = 1e-4) -> DataFrame:
    """Population, housing and mean income before and after, both vintages.

    The vintages stand under one another with columns of their own, so that all
    figures come from one look at the interpolated tracts.
    """
    measures = ("popul", "hunit", "hhinc")
    before = partition_union(
        [
            tables.vintage(s).select(*[F.col(m).alias(f"{m}{s}") for m in measures])
            for s in VINTAGES
        ]
    )
    figures = []
    for s in VINTAGES:
        figures += [Conserved(f"{m}{s}", f"{m}{s}", f"{m}{s}") for m in ("popul", "hunit")]
        income, people = f"hhinc{s}", f"popul{s}"
        figures.append(Conserved(income, income, income, people, people))
    return conservation_check(before, tables.interpolated, figures, tolerance)


def case_verdicts(
    tables: RegionTables,
    merged: Case = MERGED,
    split: Case = SPLIT,
    redrawn: Case = REDRAWN,
) -> DataFrame:
    """The merged, split and redrawn tracts against figures worked out directly."""
    checks = []
    for suffix, (of_source, of_target) in VINTAGES.items():
        before = tables.vintage(suffix)
        both = SourceSet(before, "GEOID", "", ["hhinc"], of_target, ["popul"], of_source)
        names = [f"hhinc{suffix}", f"popul{suffix}"]
        for label, case in (("merged", merged), ("split", split)):
            checks.append(
                closed_case_check(
                    f"{label}{suffix}",
                    tables.interpolated,
                    "GEOID20",
                    case.targets,
                    f"popul{suffix}",
                    before,
                    "GEOID",
                    case.sources,
                    "popul",
                )
            )
        checks.append(
            target_check(
                tables.interpolated,
                tables.crosswalk,
                "GEOID10",
                "GEOID20",
                both,
                names,
                [*merged.targets, *redrawn.targets],
            )
        )
        inherited = SourceSet(before, "GEOID", "", ["white"], of_target)
        checks.append(
            inherited_check(
                tables.interpolated,
                tables.crosswalk,
                "GEOID10",
                "GEOID20",
                inherited,
                [f"white{suffix}"],
                split.targets,
            )
        )
    return partition_union(checks)


def all_case_verdicts(tables: RegionTables) -> DataFrame:
    """Every merged, split or redrawn group of tracts, found from the overlaps, both vintages."""
    parts = []
    for suffix, (of_source, of_target) in VINTAGES.items():
        both = SourceSet(tables.vintage(suffix), "GEOID", "", ["hhinc", "white"], of_target, ["popul"], of_source)
        names = [f"{m}{suffix}" for m in both.measures]
        verdicts = verdicts_by_case(tables.crosswalk, "GEOID10", "GEOID20", both, tables.interpolated, names)
        parts.append(verdicts.withColumn("vintage", F.lit(suffix)))
    return partition_union(parts)


def same_as_national(
    region_units: DataFrame, national_units: DataFrame, tolerance: float = 1e-6
) -> DataFrame:
    """Whether filtering first and filtering last give the same tracts, cell by cell."""
    columns = [c for c in region_units.columns if c != "GEOID20"]

    def rated(units: DataFrame) -> DataFrame:
        return units.where(F.col("GEO_ID").isNotNull())

    return frame_equality(
        rated(region_units), rated(national_units), ["GEOID20"], columns, tolerance
    )


def run(
    spark: SparkSession,
    paths: Paths,
    out: str,
    national_tracts: DataFrame | None = None,
    region: Region = Region(),
) -> dict[str, DataFrame]:
    """Write the place table and every check under ``out``.

    ``national_tracts`` are the region's tracts as the national comparison has them; when
    given, both are compared. The interpolated tracts feed several checks, so they are
    written once as a table.
    """
    tables = region_tables(spark, paths, region)
    interpolated = materialize(tables.interpolated, f"{out}/tables/region_interpolated")
    tables = replace(tables, interpolated=interpolated)
    results = {
        "focus_places": region_places(spark, paths, region),
        "conservation": conservation(tables),
        "cases": case_verdicts(tables),
        "all_cases": all_case_verdicts(tables),
        "missing_tracts": missing_responses(spark, paths, "tract", region),
        "missing_places": missing_responses(spark, paths, "place", region),
    }
    if national_tracts is not None:
        tracts = join_response(interpolated, region_response(spark, paths, region))
        results["same_as_national"] = same_as_national(tracts, national_tracts)
    for name, rows in results.items():
        write_export(rows, f"{out}/{name}")
    return results
