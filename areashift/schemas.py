"""Schemas of the input tables, and the values they are read with.

Every code is a string: a code read as a number loses its leading zeros.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)


def _schema(strings: str = "", doubles: str = "") -> StructType:
    return StructType(
        [StructField(c, StringType()) for c in strings.split()]
        + [StructField(c, DoubleType()) for c in doubles.split()]
    )


# Column names of the landed inputs.
FACTS = StructType(
    [
        StructField("geography", StringType()),
        StructField("survey", StringType()),
        StructField("year", IntegerType()),
        StructField("state", StringType()),
        StructField("county", StringType()),
        StructField("GEOID", StringType()),
        StructField("NAME", StringType()),
        StructField("variable", StringType()),
        StructField("estimate", DoubleType()),
        StructField("moe", DoubleType()),
    ]
)
FACT_PARTITIONS = ["geography", "year", "survey", "state"]

# Units of a rate table by geography: the codes beside GEO_ID and NAME.
UNIT_CODES = {
    "tract": ["state", "county", "tract"],
    "place": ["state", "place"],
    "county": ["state", "county"],
}


def current_rates(geography: str) -> StructType:
    """Rates arrive as text and are cast with the vintages aligned."""
    codes = " ".join(UNIT_CODES[geography])
    return _schema(f"NAME GEO_ID {codes} CRRALL CRRINT RESP_DATE")


def prior_rates(geography: str) -> StructType:
    return _schema(f"NAME GEO_ID {' '.join(UNIT_CODES[geography])} FSRR2010")


CROSSWALK = _schema(
    "GEOID10 GEOID20 STATEFP10 COUNTYFP10",
    "HU10PCT_T10 HU10PCT_T20 HUCURPCT_T10 HUCURPCT_T20",
)
COUNTY_GROUP = _schema("MSA_GEOID MSA County_GEOID County")
PLACE_LIST = _schema("GEO_ID")
SNAPSHOT = _schema("GEO_ID", "CRRALL")


@dataclass(frozen=True)
class Demographics:
    """Which survey variable holds which measure in one vintage.

    ``whole`` names the shares that, with the residual, make up 100.
    """

    variables: Mapping[str, str]
    whole: tuple[str, ...] = ("hispa", "white", "black", "asian")

    @property
    def columns(self) -> dict[str, str]:
        """Estimate column of the wide table to measure."""
        return {f"{variable}E": measure for variable, measure in self.variables.items()}


# Variable ids of the two survey vintages, and what they measure.
DEMOGRAPHICS_2010 = Demographics(
    {
        "B01001_001": "popul",
        "B11005_001": "hhold",
        "B25001_001": "hunit",
        "B19013_001": "hhinc",
        "DP05_0066P": "hispa",
        "DP05_0072P": "white",
        "DP05_0073P": "black",
        "DP05_0075P": "asian",
    }
)
DEMOGRAPHICS_2018 = Demographics(
    {
        "B01001_001": "popul",
        "B11005_001": "hhold",
        "B25001_001": "hunit",
        "B19013_001": "hhinc",
        "S1701_C03_001": "povty",
        "S1602_C04_001": "lmeng",
        "DP05_0071P": "hispa",
        "DP05_0077P": "white",
        "DP05_0078P": "black",
        "DP05_0080P": "asian",
    }
)
POPULATION = "B01001_001"
HOUSING = "B25001_001"

# Measures averaged and measures allocated in the interpolation.
MEANS_2010 = ["hhinc", "hispa", "white", "black", "asian", "other", "nonwh"]
MEANS_2018 = MEANS_2010 + ["povty", "lmeng"]
COUNTS = ["popul", "hhold", "hunit"]

# Classes in the order they are tested, with their display labels.
CLASS_ORDER = ["hispa", "black", "asian", "white", "other"]
CLASS_LABELS = {
    "hispa": "Hispanic",
    "black": "Black",
    "asian": "Asian",
    "white": "White",
    "other": "Other",
    "none": "No Majority",
}
THRESHOLD = 50.0
PEERS = 20

# Headings and legends of the published tables.
PIVOT_HEADINGS = {"all": "Overall Change", "hispa": "Hispanic Tract Change"}
PIVOT_HEADINGS_ALL_CLASSES = {
    "all": "Overall Change",
    "black": "Black Tract Change",
    "hispa": "Hispanic Tract Change",
    "white": "White Tract Change",
    "none": "No Majority Tract Change",
}
RANKED_HEADINGS = [
    "Tract Racial Majority",
    "2010 Self-Response Rate",
    "2020 Self-Response Rate",
    "Tracts in 2010",
    "Tracts in 2020",
]
LEGENDS = {
    "all": "Overall Difference",
    "hispa": "Difference in Majority-Hispanic Tracts",
}

# Public codes of the study region and the prefixes of full identifiers.
REGION_STATE = "17"
REGION_COUNTIES = ["031", "043", "089", "093", "097", "111", "197"]
TRACT_PREFIX = "1400000US"
PLACE_PREFIX = "1600000US"
COUNTY_PREFIX = "0500000US"

# The state codes in use, 50 states and the federal district.
STATE_CODES = (
    "01 02 04 05 06 08 09 10 11 12 13 15 16 17 18 19 20 21 22 23 24 25 26 27 28 29 30 "
    "31 32 33 34 35 36 37 38 39 40 41 42 44 45 46 47 48 49 50 51 53 54 55 56"
).split()
