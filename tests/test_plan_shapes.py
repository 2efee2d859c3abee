"""What Spark makes of the queries: no Python, no products, pushed filters, split hot keys."""

import re

import pytest
from pyspark.sql import functions as F

from areashift.operators.compare import Period, compare_periods
from areashift.operators.crosswalk import build_crosswalk
from areashift.operators.frames import frame_equality
from areashift.operators.interpolate import SourceSet, areal_interpolate
from areashift.operators.peers import assign_groups
from areashift.operators.rates import align_vintages
from conftest import TESTDATA
from queries import spark as operators, star

SMALL = TESTDATA / "sf0.001"
QUERIES = operators.queries()
needs_tables = pytest.mark.skipif(not SMALL.is_dir(), reason="needs the test tables")


def plan(df, mode="executedPlan"):
    return getattr(df._jdf.queryExecution(), mode)().toString()


def final_plan(df):
    """The plan adaptive execution ended with."""
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


@pytest.fixture
def settings(spark):
    """Set session options for one test."""
    before = {}

    def use(**options):
        for key, value in options.items():
            key = key.replace("__", ".")
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield use
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


UNWANTED = {
    "Python", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin", "BroadcastExchange",
    "ObjectHashAggregate", "SortAggregate", "Window",
}
# Bounded by the number of classes, and by the number of partitions.
ALLOWED = {"ranked_report": {"Window"}, "row_index": {"Window", "BroadcastExchange"}}
ALLOWED["ascending_report"] = ALLOWED["tied_row_index"] = ALLOWED["row_index"]
# The numbers of differing buckets, of which there are a fixed number.
ALLOWED["frame_multiplicity"] = {"BroadcastExchange"}
# And the greatest of texts, over rows that differ only.
ALLOWED["frame_differences"] = {"BroadcastExchange", "SortAggregate"}


@needs_tables
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_stays_in_the_engine(spark, settings, name):
    # Without broadcasts, as at a size where none is possible.
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    text = plan(QUERIES[name](spark, str(SMALL)))
    found = {operator for operator in UNWANTED if operator in text}
    assert found == ALLOWED.get(name, set())


@needs_tables
def test_scan_reads_what_it_needs(spark):
    text = plan(star.flag_shares(spark, str(SMALL), "l_suppkey", 1996))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(l_shipdate", text)
    (schema,) = set(re.findall(r"ReadSchema: struct<([^>]*)", text))
    read = {c.split(":")[0] for c in schema.split(",")}
    assert read == {"l_suppkey", "l_quantity", "l_returnflag", "l_shipdate"}


@needs_tables
def test_top_groups_needs_no_full_sort(spark):
    assert "TakeOrderedAndProject" in plan(star.peer_groups(spark, str(SMALL)))


@needs_tables
def test_small_lookups_are_broadcast_by_size(spark):
    units = star.supplier_units(spark, str(SMALL))
    text = final_plan(star.peer_units(units, spark, str(SMALL)))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_comparison_is_one_aggregate(frame):
    units = frame("c string, g string, r double, w double", ("a", "G", 1.0, 1.0))
    period = Period("c", "r", "w")
    text = plan(compare_periods(units, "g", period, period), "optimizedPlan")
    assert text.count("Aggregate [") == 1 and text.count("Expand") == 1
    assert "Join" not in text


def test_aligning_is_one_aggregate(frame):
    a = frame("k string, x string", ("u", "1"))
    b = frame("k string, y double", ("u", 1.0))
    text = plan(align_vintages(a, b, ["k"], "x", "y"), "optimizedPlan")
    assert text.count("Aggregate [") == 1 and "Join" not in text


@pytest.fixture
def skewed(spark, settings):
    """Overlaps with a third of the rows on one source and a third on one target."""
    settings(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__shuffle__partitions="16",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="20KB",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
    )
    number = F.col("id")
    return spark.range(240_000).select(
        F.when(number % 3 == 0, F.lit(0)).otherwise(F.pmod(F.hash("id"), F.lit(50000))).alias("s"),
        F.when(number % 3 == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), F.lit(50000))).alias("t"),
        (1.0 + number % 7).alias("q"),
    )


def skew_joins(text):
    return text.count("SortMergeJoin(skew=true)")


def test_hot_units_are_split_in_the_crosswalk(spark, skewed):
    shares = build_crosswalk(skewed, "s", "t", {"q": ("of_s", "of_t")})
    assert skew_joins(final_plan(shares)) == 2
    sums = shares.groupBy("s").agg(F.sum("of_s").alias("n"))
    assert sums.where("abs(n - 100) > 1e-6").count() == 0


def test_hot_sources_are_split_in_the_interpolation(spark, skewed):
    pairs = skewed.groupBy("s", "t").agg(F.sum("q").alias("w"))
    units = spark.range(60000).selectExpr("id AS s", "CAST(id AS DOUBLE) AS x", "1.0D AS n")
    sets = [SourceSet(units, "s", suffix, ["x"], "w", ["n"], "w") for suffix in ("10", "18")]
    result = areal_interpolate(pairs, "s", "t", sets)
    assert skew_joins(final_plan(result)) >= 1

    # Against the plain definition, with another plan.
    rows = pairs.toPandas().merge(units.toPandas(), on="s", how="left")
    rows["xw"], rows["nw"] = rows.x * rows.w, rows.n * rows.w / 100
    want = rows.groupby("t")[["xw", "w", "nw"]].sum()
    got = result.where("t IS NOT NULL").toPandas().set_index("t").sort_index()
    assert len(got) == len(want)
    assert (got.x10 - want.xw / want.w).abs().max() < 1e-6
    assert (got.n18 - want.nw).abs().max() < 1e-6
    assert result.where("t IS NULL").count() == 1


def test_hot_keys_are_split_in_the_group_lookup(spark, skewed):
    lookup = spark.range(5000).selectExpr("id AS key", "concat('g', id % 7) AS g")
    assert skew_joins(final_plan(assign_groups(skewed, lookup, "s", "key"))) == 1


def test_checks_are_one_row_without_products(frame):
    a = frame("k string, x double", ("a", 1.0))
    text = plan(frame_equality(a, a, ["k"], ["x"]))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_deduplicated_comparison_reads_the_units_once(frame):
    units = frame("u string, c string, g string, r double, w double", ("x", "a", "G", 1.0, 1.0))
    period = Period("c", "r", "w")
    compared = compare_periods(units, "g", period, period, dedupe_total=True, unit=["u"])
    text = plan(compared, "optimizedPlan")
    assert "Union" not in text and "Join" not in text
    assert text.count("LogicalRDD") + text.count("LocalRelation") == 1
