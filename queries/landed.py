"""Queries over files: rows of the tables landed as a user's files would be, and read back.

``land`` is an action and writes to the shared folder; everything after it is a plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areashift.functions import has_level, normalize_code, split_code, strip_prefix
from areashift.operators.checks import source_check, summarize_checks, target_check
from areashift.operators.compare import ALL
from areashift.operators.demographics import clean_demographics
from areashift.operators.interpolate import SourceSet, areal_interpolate
from areashift.operators.joins import keyed_join, left_join, named, restrict_to
from areashift.operators.peers import partition_union
from areashift.operators.rates import join_vintages
from areashift.operators.reports import pivot_order, pivoted_report
from areashift.plans.inputs import Region, region_crosswalk
from areashift.schemas import COUNTY_PREFIX, TRACT_PREFIX, Demographics, current_rates
from areashift.session import scratch_folder
from areashift.sources.landing import land_changed, land_missing, land_rates
from areashift.sources.readers import (
    pull_demographics,
    read_crosswalk,
    read_group_lookup,
    read_place_list,
    read_rates,
    read_snapshot,
    state_codes,
)
from areashift.sources.writers import land_facts, with_row_index, write_export
from queries import star
from queries.star import table

HEADINGS = {"all": "Overall Change", "R": "Returned Change"}


def land(spark: SparkSession, rows: DataFrame, name: str, format: str = "csv") -> str:
    """Write rows as files of a format and return their folder. An action."""
    folder = scratch_folder(spark, name)
    if format == "csv":
        write_export(rows, folder)
    else:
        rows.write.mode("overwrite").format(format).save(folder)
    return folder


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "supplier")
    code = F.concat(normalize_code("s_nationkey", 2), normalize_code("s_suppkey", 9))
    return units.select(
        code.alias("code"), "s_name", normalize_code("s_nationkey", 2).alias("state"), "s_acctbal"
    )


def q_read_rates(spark, sf_dir):
    """Rates of two states landed as JSON lines and as CSV, where they arrive as text."""
    rates = suppliers(spark, sf_dir).select(
        F.concat(F.lit(TRACT_PREFIX), "code").alias("GEO_ID"),
        F.col("s_name").alias("NAME"),
        "state",
        F.col("s_acctbal").cast("string").alias("CRRALL"),
    )
    schema = current_rates("county")
    parts = [
        read_rates(spark, land(spark, columns, f"rates-{format}", format), schema, format, ["03", "04"])
        .select(F.lit(format).alias("format"), *rates.columns)
        for format, columns in (
            ("json", rates),
            # CSV by header name: the columns in another order, with all that the schema names
            ("csv", rates.select(F.lit("x").alias("RESP_DATE"), F.lit(None).cast("string").alias("CRRINT"),
                                 F.lit("").alias("county"), "state", "CRRALL", "GEO_ID", "NAME")),
        )
    ]
    return partition_union(parts)


def q_read_crosswalk(spark, sf_dir):
    """Overlaps landed with codes that lost their zeros, read padded, and cut to a region."""
    pairs = star.crosswalk(spark, sf_dir)
    part = lambda n: (F.col("supplier") % n).cast("string")
    rows = pairs.select(
        (F.col("supplier") + 1000).cast("string").alias("GEOID10"),
        F.col("order").cast("string").alias("GEOID20"),
        part(7).alias("STATEFP10"),
        part(11).alias("COUNTYFP10"),
        F.col("all_s").alias("HU10PCT_T10"),
        F.col("all_t").alias("HU10PCT_T20"),
        F.lit(0.0).alias("HUCURPCT_T10"),
        F.lit(0.0).alias("HUCURPCT_T20"),
    )
    read = read_crosswalk(spark, land(spark, rows, "crosswalk"))
    kept = region_crosswalk(read, Region("03", ("002", "005")))
    shares = [F.round(c, 6).alias(c) for c in ("HU10PCT_T10", "HU10PCT_T20")]
    return kept.select("GEOID10", "GEOID20", "STATEFP10", "COUNTYFP10", *shares)


def q_read_group_lookup(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    regions = table(spark, sf_dir, "region")
    joined = left_join(nations, regions, [("n_regionkey", "r_regionkey")])
    rows = joined.select(
        F.col("n_nationkey").cast("string").alias("MSA_GEOID"),
        F.concat("r_name", F.lit(" (Metro Area)")).alias("MSA"),
        F.col("n_nationkey").cast("string").alias("County_GEOID"),
        F.col("n_name").alias("County"),
    )
    return read_group_lookup(spark, land(spark, rows, "groups"))


def q_read_place_list(spark, sf_dir):
    """Suppliers on a list of places."""
    units = suppliers(spark, sf_dir)
    listed = units.where("s_acctbal > 5000").select(F.concat(F.lit(TRACT_PREFIX), "code").alias("GEO_ID"))
    places = read_place_list(spark, land(spark, listed, "places"))
    places = places.select(strip_prefix("GEO_ID", TRACT_PREFIX).alias("place"))
    return restrict_to(units, "code", places, "place").select("code", "s_name")


def q_read_snapshot(spark, sf_dir):
    """A snapshot of two summary levels, with a byte-order mark: one level, cut in two."""
    units = suppliers(spark, sf_dir)
    level = lambda prefix: units.select(F.concat(F.lit(prefix), "code").alias("GEO_ID"), "s_acctbal")
    rows = level(COUNTY_PREFIX).unionByName(level(TRACT_PREFIX))
    rows = rows.withColumnsRenamed({"GEO_ID": "\ufeffGEO_ID", "s_acctbal": "CRRALL"})
    read = read_snapshot(spark, land(spark, rows, "snapshot"))
    codes = split_code(strip_prefix("GEO_ID", COUNTY_PREFIX), (2,), ("state", "county"))
    return read.where(has_level("GEO_ID", COUNTY_PREFIX)).select(*codes, "CRRALL")


def q_other_geographies(spark, sf_dir):
    """Facts of counties and places in three states, which are not split into codes."""
    customers = table(spark, sf_dir, "customer").select(
        F.concat(normalize_code("c_nationkey", 2), normalize_code("c_custkey", 9)).alias("code"),
        F.col("c_name").alias("s_name"),
        normalize_code("c_nationkey", 2).alias("state"),
        F.col("c_acctbal").alias("s_acctbal"),
    )

    def facts(units: DataFrame, geography: str) -> DataFrame:
        whole = F.floor("s_acctbal").cast("double")
        values = F.inline(
            F.array(
                F.struct(F.lit("v1").alias("variable"), whole.alias("estimate")),
                F.struct(F.lit("v2").alias("variable"), (whole / 2).alias("estimate")),
            )
        )
        rows = units.select("*", values)
        return rows.select(
            F.lit(geography).alias("geography"), F.lit("acs1").alias("survey"), F.lit(2018).alias("year"),
            "state", F.substring("code", 3, 3).alias("county"), F.col("code").alias("GEOID"),
            F.col("s_name").alias("NAME"), "variable", "estimate", F.lit(0.0).alias("moe"),
        )

    folder = scratch_folder(spark, "facts")
    land_facts(facts(suppliers(spark, sf_dir), "county").unionByName(facts(customers, "place")), folder)
    vintage = Demographics({"v1": "white", "v2": "black"}, whole=("white", "black"))
    levels = []
    for geography in ("county", "place"):
        wide = pull_demographics(spark, folder, 2018, "acs1", ["v1", "v2"], geography, ["01", "05", "09"])
        tidy = clean_demographics(wide, vintage, split=False)
        tidy = tidy.withColumns({m: F.round(m, 6) for m in ("white", "black")})
        levels.append(tidy.withColumn("geography", F.lit(geography)))
    return partition_union(levels)


def q_one_sided_presence(spark, sf_dir):
    """Parts with a current rate and no prior one, by name of the columns."""
    current, prior = star.part_vintages(spark, sf_dir)
    joined = join_vintages(current, prior, ["full_id", "name"], "rate18", "rate10")
    only = joined.where(F.col("rate10").isNull() & F.col("rate18").isNotNull())
    return only.select("full_id", F.round("rate18", 6).alias("rate18"))


def year_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long facts of suppliers by year and nation."""
    lines = table(spark, sf_dir, "lineitem").groupBy(
        "l_suppkey", "l_returnflag", F.year("l_shipdate").alias("year")
    )
    sums = lines.agg(F.sum("l_quantity").alias("estimate"), F.sum("l_discount").alias("moe"))
    units = star.supplier_units(spark, sf_dir)
    return left_join(sums, units, [("l_suppkey", "supplier")]).select(
        F.lit("supplier").alias("geography"), F.lit("lines").alias("survey"), "year",
        F.substring("unit", 1, 2).alias("state"), F.substring("unit", 3, 3).alias("county"),
        F.col("unit").alias("GEOID"), F.col("name").alias("NAME"), F.col("l_returnflag").alias("variable"),
        "estimate", F.round("moe", 2).alias("moe"),
    )


def q_landed_again(spark, sf_dir):
    """What four landings write: the years before 2000, all that is missing, the same again,
    and one nation whose estimates of a year were corrected; and what is read in the end."""
    folder = scratch_folder(spark, "facts")
    facts = year_facts(spark, sf_dir)
    stored = land(spark, facts, "pulled", "parquet")
    facts = spark.read.schema(facts.schema).parquet(stored)
    keys = ["geography", "year", "survey", "state"]

    def load(missing: DataFrame) -> DataFrame:
        return keyed_join(facts, missing, keys, "left_semi")

    corrected = (F.col("state") == "03") & (F.col("year") == 1997)
    landings = [
        lambda: land_changed(facts.where("year < 2000"), folder).select("year", "state"),
        lambda: land_missing(facts, load, folder).select("year", "state"),
        lambda: land_changed(facts, folder).select("year", "state"),
        lambda: land_changed(
            facts.where("year >= 1997").withColumn("estimate", F.when(corrected, -1.0).otherwise(F.col("estimate"))), folder
        ).select("year", "state"),
    ]
    rows = [landed().withColumn("step", F.lit(f"landing {i + 1}")) for i, landed in enumerate(landings)]
    read = spark.read.schema(facts.schema).parquet(folder).groupBy("year", "state").agg(
        F.count(F.lit(1)).cast("double").alias("units"), F.sum("estimate").alias("total")
    )
    return partition_union([*rows, read.withColumn("step", F.lit("read"))])


def q_peer_facts(spark, sf_dir):
    """Wide facts of one year for the nations with the most customers, whose partitions alone
    are read."""
    folder = scratch_folder(spark, "facts")
    land_facts(year_facts(spark, sf_dir), folder)
    peers = star.peer_groups(spark, sf_dir).select(normalize_code("c_nationkey", 2).alias("state"))
    wide = pull_demographics(spark, folder, 2000, "lines", ["A", "N", "R"], "supplier", peers)
    return wide.withColumns({c: F.round(named(c), 4) for c, kind in wide.dtypes if kind == "double"})


def q_landed_rates(spark, sf_dir):
    """Rates of all nations landed by nation, two of them landed again with other rates, and
    three read back."""
    rates = suppliers(spark, sf_dir).select(
        F.concat(F.lit(COUNTY_PREFIX), "code").alias("GEO_ID"), F.col("s_name").alias("NAME"), "state",
        F.substring("code", 3, 9).alias("county"), F.col("s_acctbal").cast("string").alias("CRRALL"),
        F.lit(None).cast("string").alias("CRRINT"), F.lit("2020-08-19").alias("RESP_DATE"),
    )
    folder = scratch_folder(spark, "rates")
    land_rates(rates, folder)
    newer = F.when(F.col("state").isin("03", "04"), F.lit("99.5")).otherwise(F.col("CRRALL"))
    land_rates(rates.where("state < '10'").withColumn("CRRALL", newer), folder)
    return read_rates(spark, folder, current_rates("county"), state=["03", "05", "11"])


def q_chosen_targets(spark, sf_dir):
    """Checks of the targets of one region and of the sources still pending only."""
    crosswalk = star.crosswalk(spark, sf_dir)
    orders = star.order_attributes(spark, sf_dir)
    one = SourceSet(orders, "order", "", counts=["orders"], count_weight="all_s")
    got = areal_interpolate(crosswalk, "order", "supplier", [one], unallocated=False)
    here = star.focus_suppliers(spark, sf_dir).select("supplier")
    pending = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey")
    return summarize_checks(
        partition_union(
            [
                target_check(got, crosswalk, "order", "supplier", one, targets=here),
                source_check(crosswalk, "order", one, sources=pending),
            ]
        )
    )


def q_ascending_report(spark, sf_dir):
    """The pivoted report in its order, numbered."""
    report = pivoted_report(
        star.comparison(spark, sf_dir), HEADINGS, "Nation", excluded_groups=[ALL, star.FOCUS]
    )
    numbered = with_row_index(report, pivot_order(HEADINGS, "Nation"))
    return numbered.select(
        "row_id", "Nation", *[F.round(named(h), 6).alias(h) for h in HEADINGS.values()]
    )


def q_state_codes(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(
        normalize_code("n_nationkey", 2).alias("code"), F.col("n_name").alias("name")
    )
    return restrict_to(nations, "code", state_codes(spark), "state_code")
