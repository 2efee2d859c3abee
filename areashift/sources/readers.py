"""Read landed files: Parquet facts, rate tables, and delimited lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from areashift.functions import normalize_code, strip_parenthetical, to_number
from areashift.operators.demographics import widen_variables
from areashift.operators.joins import named, restrict_to
from areashift.schemas import (
    COUNTY_GROUP,
    CROSSWALK,
    FACTS,
    PLACE_LIST,
    SNAPSHOT,
    STATE_CODES,
)


#: States to read: one, a list, the first column of a table, or all.
States = str | Sequence[str] | DataFrame | None


def in_states(rows: DataFrame, states: States) -> DataFrame:
    """Rows of the states. Where rows are partitioned by state, others are not read: a list
    is known to the scan, and a table that Spark can broadcast prunes it when the query runs.
    """
    if states is None:
        return rows
    if isinstance(states, DataFrame):
        return restrict_to(rows, "state", states.distinct(), states.columns[0])
    return rows.where(F.col("state").isin([states] if isinstance(states, str) else list(states)))


def read_facts(
    spark: SparkSession,
    path: str,
    year: int,
    survey: str,
    geography: str,
    state: States = None,
    counties: Sequence[str] | None = None,
    variables: Sequence[str] | None = None,
) -> DataFrame:
    """Long facts of one survey. Year, survey, geography and state prune partitions."""
    facts = spark.read.schema(FACTS).parquet(path)
    facts = facts.where(
        (F.col("geography") == geography) & (F.col("year") == year) & (F.col("survey") == survey)
    )
    facts = in_states(facts, state)
    if counties is not None:
        facts = facts.where(F.col("county").isin(list(counties)))
    if variables is not None:
        facts = facts.where(F.col("variable").isin(list(variables)))
    return facts


def pull_demographics(
    spark: SparkSession,
    path: str,
    year: int,
    survey: str,
    variables: Sequence[str],
    geography: str = "tract",
    state: States = None,
    counties: Sequence[str] | None = None,
) -> DataFrame:
    """One wide row per unit with the wanted variables."""
    facts = read_facts(spark, path, year, survey, geography, state, counties, variables)
    return widen_variables(facts, variables)


def read_rates(
    spark: SparkSession,
    path: str,
    schema: StructType,
    format: str = "parquet",
    state: States = None,
    multiline: bool = False,
) -> DataFrame:
    """One vintage of rates, from Parquet, JSON lines or CSV."""
    if format == "csv":
        rates = read_delimited(spark, path, schema, multiline=multiline)
    else:
        rates = spark.read.schema(schema).format(format).load(path)
    return in_states(rates, state)


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType,
    separator: str = ",",
    multiline: bool = True,
) -> DataFrame:
    """CSV columns picked by header name, typed by the schema; ``NA`` is missing.

    Columns may stand in any order and more may be present. Text that does not fit a
    numeric type becomes NULL. Nothing is inferred, so codes keep their leading zeros.

    Cells may hold line breaks, and each file is read by one task. With ``multiline=False``
    files are split over tasks, and a line that has other cells than the header, as half of
    a record with a line break in a quoted cell has, is refused.
    """
    raw = spark.read.csv(
        path,
        header=True,
        sep=separator,
        nullValue="NA",
        escape='"',
        inferSchema=False,
        multiLine=multiline,
        mode="PERMISSIVE" if multiline else "FAILFAST",
    )
    if not multiline:
        # cells are counted only where all columns are parsed
        whole = F.struct(*[named(c) for c in raw.columns])
        raw = raw.where(whole.isNotNull())

    def typed(f: StructField):
        if f.dataType == StringType():
            return named(f.name)
        if f.dataType == DoubleType():
            return to_number(named(f.name)).alias(f.name)
        return named(f.name).try_cast(f.dataType).alias(f.name)

    return raw.select(*[typed(f) for f in schema.fields])


def read_crosswalk(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Overlap shares of old and new units, all codes padded to their width."""
    widths = {"GEOID10": 11, "GEOID20": 11, "STATEFP10": 2, "COUNTYFP10": 3}
    return read_delimited(spark, path, CROSSWALK, multiline=multiline).withColumns(
        {c: normalize_code(c, width) for c, width in widths.items()}
    )


def read_group_lookup(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """County to metro group; ``county_name`` keeps clear of the ``county`` code."""
    lookup = read_delimited(spark, path, COUNTY_GROUP, multiline=multiline)
    return lookup.select(
        "MSA_GEOID",
        strip_parenthetical("MSA").alias("MSA"),
        normalize_code("County_GEOID", 5).alias("County_GEOID"),
        F.col("County").alias("county_name"),
    )


def read_place_list(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Full identifiers of the places to keep."""
    return read_delimited(spark, path, PLACE_LIST, multiline=multiline)


def read_snapshot(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Rates of all summary levels on one day. A byte-order mark is not part of the header."""
    return read_delimited(spark, path, SNAPSHOT, multiline=multiline)


def state_codes(spark: SparkSession) -> DataFrame:
    """The states and the federal district."""
    return spark.createDataFrame([(c,) for c in STATE_CODES], "state_code string")
