"""A crosswalk landed by both units: the same results, and no shuffle of its pairs."""

import re

import pytest
from pyspark.sql import functions as F

from areashift.operators import SourceSet, areal_interpolate
from areashift.operators.checks import source_check, target_check
from areashift.sources import crosswalks
from areashift.sources.crosswalks import land_crosswalk, open_crosswalk
from conftest import rows_of

BUCKETS = 8  # as the session's shuffle partitions


@pytest.fixture(autouse=True)
def no_broadcasts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def pairs(spark, tmp_path_factory):
    """Overlaps with a third of the rows on one source and a third on one target."""
    n = F.col("id")
    rows = spark.range(6000).select(
        F.when(n % 3 == 0, F.lit(0)).otherwise(F.pmod(F.hash("id"), F.lit(900))).alias("s"),
        F.when(n % 3 == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), F.lit(900))).alias("t"),
        (1.0 + n % 7).alias("w"),
    )
    folder = str(tmp_path_factory.mktemp("pairs"))
    rows.groupBy("s", "t").agg(F.sum("w").alias("w")).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


@pytest.fixture
def sets(spark):
    units = spark.range(1000).selectExpr("id AS unit", "CAST(id AS DOUBLE) AS x", "1.0D AS n")
    return [SourceSet(units.where("unit % 5 <> 1"), "unit", s, ["x"], "w", ["n"], "w") for s in ("10", "18")]


def same(one, other):
    def rows(df):
        return sorted((str(r[0]), *[None if v is None else round(v, 6) for v in r[1:]]) for r in df.collect())

    assert rows(one) == rows(other)


@pytest.mark.parametrize("unallocated", [True, False])
@pytest.mark.parametrize("way", [("s", "t"), ("t", "s")])
def test_same_results_either_way(pairs, sets, tmp_path, way, unallocated):
    landed = land_crosswalk(pairs, str(tmp_path), "s", "t")
    assert rows_of(landed.by_source.hot_units) == rows_of(landed.by_target.hot_units) == [(0,)]
    same(
        areal_interpolate(landed, *way, sets, unallocated),
        areal_interpolate(pairs, *way, sets, unallocated),
    )


def exchanges(text):
    return [line for line in text.splitlines() if re.search(r"\bExchange\b", line)]


def test_pairs_are_not_shuffled(spark, pairs, sets, tmp_path):
    rest = pairs.where("s <> 0 AND t <> 0")
    landed = land_crosswalk(rest, str(tmp_path), "s", "t")
    assert landed.by_source.hot is None and landed.by_target.hot is None
    text = plan(areal_interpolate(landed, "s", "t", sets))
    # attributes, once for the join and once for those in no pair, and the partial sums
    found = exchanges(text)
    assert sum("hashpartitioning(t" in e for e in found) == 1
    assert sum("REPARTITION_BY_NUM" in e for e in found) == len(found) - 1 <= 2
    assert text.count("Bucketed: true") == 2
    plain = plan(areal_interpolate(rest, "s", "t", sets))
    assert len(exchanges(plain)) > len(exchanges(text))


def test_checks_group_by_either_unit_without_a_shuffle(pairs, sets, tmp_path):
    landed = land_crosswalk(pairs.where("s <> 0 AND t <> 0"), str(tmp_path), "s", "t")
    for side in (landed.by_source, landed.by_target):
        sums = side.all_pairs().groupBy(side.unit).agg(F.sum("w"))
        assert not exchanges(plan(sums))
    own = source_check(landed.by_source.all_pairs(), "s", sets[0])
    assert rows_of(own) == rows_of(source_check(pairs.where("s <> 0 AND t <> 0"), "s", sets[0]))


def test_opened_again(spark, pairs, sets, tmp_path):
    land_crosswalk(pairs, str(tmp_path), "s", "t", buckets=16)
    again = open_crosswalk(spark, str(tmp_path))
    assert (again.source, again.target, again.by_target.buckets) == ("s", "t", 16)
    assert "Bucketed: true" in plan(areal_interpolate(again, "s", "t", sets))
    assert sorted(map(tuple, again.by_source.all_pairs().collect())) == sorted(map(tuple, pairs.collect()))
    assert sorted(map(tuple, again.by_target.all_pairs().collect())) == sorted(map(tuple, pairs.collect()))


def test_one_file_a_bucket(spark, pairs, tmp_path):
    landed = land_crosswalk(pairs.where("s <> 0"), str(tmp_path), "s", "t")
    assert len(landed.by_source.pairs.inputFiles()) == BUCKETS


def test_missing_units_are_refused(frame, tmp_path):
    for row in ((None, "a", 1.0), ("a", None, 1.0)):
        with pytest.raises(Exception, match="needs a source and a target"):
            land_crosswalk(frame("s string, t string, w double", ("x", "y", 1.0), row), str(tmp_path), "s", "t")


def test_other_units_are_refused(frame, tmp_path):
    landed = land_crosswalk(frame("s string, t string, w double", ("x", "y", 1.0)), str(tmp_path), "s", "t")
    with pytest.raises(ValueError, match="landed by s and t"):
        landed.by("u")


def test_odd_names_and_an_empty_crosswalk(frame, tmp_path):
    pairs = frame("`old unit` string, `new.unit` string, `a share` double", ("x", "y", 50.0), ("x", "z", 50.0))
    units = frame("u string, n double", ("x", 10.0), ("v", 1.0))
    one = SourceSet(units, "u", "", counts=["n"], count_weight="a share")
    for i, rows in enumerate((pairs, pairs.limit(0))):
        landed = land_crosswalk(rows, f"{tmp_path}/{i}", "old unit", "new.unit")
        got = areal_interpolate(landed, "old unit", "`new.unit`", [one])
        want = [("y", 5.0), ("z", 5.0), (None, 0.0)] if not i else [(None, 0.0)]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_buckets_grow_with_the_pairs(pairs, sets, tmp_path, monkeypatch):
    """A bucket, and so a task's memory, does not: there were as many as shuffle partitions."""
    monkeypatch.setattr(crosswalks, "BUCKET_PAIRS", 100)
    landed = land_crosswalk(pairs, str(tmp_path), "s", "t")
    wanted = -(-pairs.count() // 100)
    assert wanted > BUCKETS and landed.by_source.buckets == landed.by_target.buckets == wanted
    same(areal_interpolate(landed, "s", "t", sets), areal_interpolate(pairs, "s", "t", sets))


def test_target_check_of_landed_pairs(pairs, sets, tmp_path):
    """The same verdicts, and pairs that go from their buckets into the join."""
    landed = land_crosswalk(pairs.where("s <> 0 AND t <> 0"), str(tmp_path), "s", "t")
    got = areal_interpolate(landed, "s", "t", sets[:1])
    for targets in (None, list(range(60))):
        checked = target_check(got, landed, "s", "t", sets[0], targets=targets)
        plain = target_check(got, landed.by_target.all_pairs(), "s", "t", sets[0], targets=targets)
        rows = [sorted(((r.unit, r.case, r.passed, *[None if v is None else round(v, 6) for v in (r.interpolated, r.recomputed)])
                       for r in df.collect()), key=str) for df in (checked, plain)]
        assert rows[0] == rows[1] and rows[0]
