"""One mean rate for the region, under different weights and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areashift.functions import has_level, split_code
from areashift.operators.joins import full_join, named, restrict_to
from areashift.operators.regional import (
    discrepancy,
    regional_frame,
    regional_rollup,
    sums_by,
)
from areashift.plans.inputs import Paths, Region, rates, tract_demographics, unit_keys
from areashift.schemas import COUNTY_PREFIX, HOUSING
from areashift.sources.readers import pull_demographics, read_snapshot
from areashift.sources.writers import materialize, write_export

MEANS = {
    "current": ("CRRALL", "hunit18"),
    "current_tract_housing": ("CRRALL", "hunit18alt"),
    "snapshot": ("CRRALL0819", "hunit18"),
    "prior": ("FSRR2010", "hunit10"),
    "prior_tract_housing": ("FSRR2010", "hunit10alt"),
}


def county_snapshot(spark: SparkSession, paths: Paths, region: Region = Region()) -> DataFrame:
    """The region's county rates on the day of the snapshot."""
    levels = read_snapshot(spark, paths.snapshot).where(has_level("GEO_ID", COUNTY_PREFIX))
    cut = levels.select(*split_code("GEO_ID", (9, 11), ("prefix", "state", "county")), "CRRALL")
    return cut.where(
        (F.col("state") == region.state) & F.col("county").isin(list(region.counties))
    ).select("state", "county", "CRRALL")


def county_response(spark: SparkSession, paths: Paths, region: Region = Region()) -> DataFrame:
    """Both rates of the region's counties, one of them possibly missing."""
    current, prior = rates(spark, paths, "county", region.state)
    joined = full_join(current, prior, unit_keys("county"))
    return joined.where(F.col("county").isin(list(region.counties)))


def county_housing(
    spark: SparkSession, paths: Paths, counties: DataFrame, region: Region = Region()
) -> DataFrame:
    """Housing units of the given counties in two one-year surveys."""

    def year(y: int, name: str) -> DataFrame:
        wide = pull_demographics(
            spark, paths.facts, y, "acs1", [HOUSING], "county", region.state
        )
        kept = restrict_to(wide, "NAME", counties, "NAME")
        return kept.select("GEOID", "NAME", named(f"{HOUSING}E").alias(name))

    both = full_join(year(2010, "hunit10"), year(2018, "hunit18"), ["GEOID", "NAME"])
    codes = split_code("GEOID", (2,), ("state", "county"))
    return both.select(*codes, "NAME", "hunit10", "hunit18")


def region_frame(spark: SparkSession, paths: Paths, region: Region = Region()) -> DataFrame:
    """Counties with rates, both housing counts, tract sums of housing and the snapshot."""
    counties = county_response(spark, paths, region)
    tracts_2010, tracts_2018 = tract_demographics(spark, paths, region)
    alternatives = [
        sums_by(tracts_2018, "county", {"hunit18alt": "hunit"}),
        sums_by(tracts_2010, "county", {"hunit10alt": "hunit"}),
        county_snapshot(spark, paths, region).select(
            "county", F.col("CRRALL").alias("CRRALL0819")
        ),
    ]
    return regional_frame(
        county_housing(spark, paths, counties, region),
        counties,
        ["state", "county", "NAME"],
        ["CRRALL", "FSRR2010"],
        alternatives,
        "county",
    )


def region_means(frame: DataFrame) -> DataFrame:
    """Five means in one row."""
    return regional_rollup(frame, MEANS)


def county_discrepancy(tracts: DataFrame, frame: DataFrame) -> DataFrame:
    """Tract-based prior mean of each county beside the county's own rate."""
    return discrepancy(
        tracts, "county", "FSRR2010", "hunit10", frame, ["FSRR2010", "NAME"], "sum"
    )


def run(
    spark: SparkSession,
    paths: Paths,
    out: str,
    tracts: DataFrame,
    region: Region = Region(),
) -> dict[str, DataFrame]:
    """Write the means and, for the region's ``tracts``, the discrepancy by county."""
    frame = materialize(region_frame(spark, paths, region), f"{out}/tables/region_counties")
    results = {
        "region_means": region_means(frame),
        "county_discrepancy": county_discrepancy(tracts, frame),
    }
    for name, rows in results.items():
        write_export(rows, f"{out}/{name}")
    return results
