"""Where the landed files lie, and the steps the three analyses share."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areashift.functions import strip_prefix
from areashift.operators.demographics import clean_demographics
from areashift.operators.interpolate import SourceSet, areal_interpolate
from areashift.operators.joins import full_join
from areashift.operators.rates import align_vintages
from areashift.schemas import (
    COUNTS,
    DEMOGRAPHICS_2010,
    DEMOGRAPHICS_2018,
    MEANS_2010,
    MEANS_2018,
    PLACE_PREFIX,
    REGION_COUNTIES,
    REGION_STATE,
    TRACT_PREFIX,
    UNIT_CODES,
    Demographics,
    current_rates,
    prior_rates,
)
from areashift.sources.readers import States, pull_demographics, read_rates


@dataclass(frozen=True)
class Paths:
    """Locations of the landed inputs. Rate folders hold one folder per geography."""

    facts: str
    current_rates: str
    prior_rates: str
    crosswalk: str
    group_lookup: str
    place_list: str = ""
    snapshot: str = ""
    rates_format: str = "parquet"


@dataclass(frozen=True)
class Region:
    """A state and the counties studied within it."""

    state: str = REGION_STATE
    counties: Sequence[str] = tuple(REGION_COUNTIES)


def demographics(
    spark: SparkSession,
    paths: Paths,
    vintage: Demographics,
    year: int,
    geography: str = "tract",
    state: States = None,
    counties: Sequence[str] | None = None,
) -> DataFrame:
    """Named measures of one five-year survey."""
    wide = pull_demographics(
        spark, paths.facts, year, "acs5", list(vintage.variables), geography, state, counties
    )
    return clean_demographics(wide, vintage, split=geography == "tract")


def tract_demographics(
    spark: SparkSession, paths: Paths, region: Region | None = None, states: States = None
) -> tuple[DataFrame, DataFrame]:
    """Both vintages for all tracts, for those of a region, or of some states."""
    scope = (region.state, region.counties) if region else (states, None)
    return (
        demographics(spark, paths, DEMOGRAPHICS_2010, 2010, "tract", *scope),
        demographics(spark, paths, DEMOGRAPHICS_2018, 2018, "tract", *scope),
    )


def rates(
    spark: SparkSession, paths: Paths, geography: str, state: States = None
) -> tuple[DataFrame, DataFrame]:
    """Current and prior rates of one geography."""

    def one(folder: str, schema) -> DataFrame:
        return read_rates(spark, f"{folder}/{geography}", schema, paths.rates_format, state)

    return (
        one(paths.current_rates, current_rates(geography)),
        one(paths.prior_rates, prior_rates(geography)),
    )


def unit_keys(geography: str) -> list[str]:
    return ["GEO_ID", *UNIT_CODES[geography], "NAME"]


def response(
    spark: SparkSession, paths: Paths, geography: str, state: States = None
) -> DataFrame:
    """Units with both rates, and their difference."""
    current, prior = rates(spark, paths, geography, state)
    aligned = align_vintages(
        current, prior, unit_keys(geography), "CRRALL", "FSRR2010", numeric=("CRRINT",)
    )
    prefix = {"tract": TRACT_PREFIX, "place": PLACE_PREFIX}[geography]
    return aligned.select(
        strip_prefix("GEO_ID", prefix).alias("GEOID"),
        "GEO_ID",
        *UNIT_CODES[geography],
        "NAME",
        "CRRALL",
        "CRRINT",
        "RESP_DATE",
        "FSRR2010",
        "dif",
    )


def interpolate_tracts(
    crosswalk: DataFrame,
    demographics_2010: DataFrame,
    demographics_2018: DataFrame,
    unallocated: bool = True,
) -> DataFrame:
    """Both vintages on the new tracts: 2010 by its own housing, 2018 by current housing."""
    sets = [
        SourceSet(
            demographics_2010, "GEOID", "10", MEANS_2010, "HU10PCT_T20", COUNTS, "HU10PCT_T10"
        ),
        SourceSet(
            demographics_2018, "GEOID", "18", MEANS_2018, "HUCURPCT_T20", COUNTS, "HUCURPCT_T10"
        ),
    ]
    return areal_interpolate(crosswalk, "GEOID10", "GEOID20", sets, unallocated)


def join_response(interpolated: DataFrame, rates_: DataFrame) -> DataFrame:
    """Interpolated tracts with their rates, tracts of either side kept.

    Both sides hold a tract once, and every rate has its tract: plain equality lets the
    join reuse the partitioning of the interpolation's aggregate.
    """
    return full_join(interpolated, rates_, [("GEOID20", "GEOID")], null_safe=False)


def region_crosswalk(crosswalk: DataFrame, region: Region) -> DataFrame:
    """Overlaps whose old tract lies in the region."""
    return crosswalk.where(
        (F.col("STATEFP10") == region.state) & F.col("COUNTYFP10").isin(list(region.counties))
    )
