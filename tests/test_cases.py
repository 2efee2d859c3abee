"""Cases of changed boundaries, and units chosen by long lists."""

import random
import time

import pytest
from pyspark.sql import functions as F

from areashift.operators import SourceSet, areal_interpolate
from areashift.operators.cases import case_verdicts, connected, overlap_cases, units_of_case
from areashift.operators.checks import closed_case_check, source_check, target_check
from areashift.operators.joins import LITERALS, among, chosen_keys
from conftest import rows_of


def roots(edges):
    """Smallest node in reach of every node, by merging sets."""
    group = {n: n for e in edges for n in e}
    for a, b in edges:
        a, b = group[a], group[b]
        for n, g in group.items():
            if g in (a, b):
                group[n] = min(a, b)
    return sorted(group.items())


def shuffled_path(n):
    order = list(range(n))
    random.Random(2).shuffle(order)
    return list(zip(order, order[1:]))


GRAPHS = {
    "path": shuffled_path(120),
    "star": [(50, i) for i in range(100)] + [(i, 50) for i in range(40)],
    "random": [tuple(random.Random(i).sample(range(200), 2)) for i in range(130)],
    "loops": [(1, 1), (2, 2), (2, 3), (2, 3), (9, 9)],
    "joined stars": [(0, i) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 40)] + [(39, 139)],
}


@pytest.mark.parametrize("name", sorted(GRAPHS))
def test_connected(frame, name):
    edges = GRAPHS[name]
    assert rows_of(connected(frame("a long, b long", *edges), "a", "b").orderBy("node")) == sorted(
        roots(edges), key=lambda r: (str(r[0]), str(r[1]))
    )


def test_connected_rounds_grow_slowly(frame, monkeypatch):
    """A path is the worst shape there is; its rounds stay near the logarithm of its length."""
    from areashift.operators import cases

    tables = []
    plain = cases.kept
    monkeypatch.setattr(cases, "kept", lambda rows, name: tables.append(name) or plain(rows, name))
    connected(frame("a long, b long", *zip(range(400), range(1, 401))), "a", "b").count()
    assert tables.count("topped") <= 14


def test_connected_without_edges(frame):
    assert connected(frame("a long, b long", (None, 1), (2, None)), "a", "b").count() == 0


PAIRS = [  # shares of source and of target, as FIXTURES.md has them
    ("merge1", "m", 100.0, 32.2), ("merge2", "m", 100.0, 67.8),
    ("split", "s1", 45.0, 100.0), ("split", "s2", 55.0, 100.0),
    ("p1", "p", 10.0, 5.0), ("p2", "p", 2.0, 1.0), ("p", "p", 96.0, 94.0), ("p", "q", 4.0, 100.0),
    ("same", "same", 100.0, 100.0), ("zero", "nil", 0.0, 0.0), (None, "x", 1.0, 1.0), ("y", None, 1.0, 1.0),
]


@pytest.fixture
def pairs(frame):
    return frame("s string, t string, of_s double, of_t double", *PAIRS)


def test_cases_by_kind(pairs):
    own, got, cases = overlap_cases(pairs, "s", "t", ["of_s", "of_t"])
    assert rows_of(cases.select("first_source", "first_target", "kind", "sources", "targets")) == [
        ("merge1", "m", "merge", 2, 1),
        ("p", "p", "boundary", 3, 2),
        ("same", "same", "unchanged", 1, 1),
        ("split", "s1", "split", 1, 2),
    ]
    redrawn = cases.where("kind = 'boundary'")
    assert rows_of(units_of_case(own, "source", redrawn).select("source")) == [("p",), ("p1",), ("p2",)]
    assert rows_of(units_of_case(got, "target", redrawn).select("target")) == [("p",), ("q",)]


def test_pairs_without_shares_count_when_none_are_named(pairs):
    _, _, cases = overlap_cases(pairs, "s", "t")
    assert cases.where("first_source = 'zero'").count() == 1


def test_empty_crosswalk(pairs):
    own, got, cases = overlap_cases(pairs.limit(0), "s", "t")
    assert (own.count(), got.count(), cases.count()) == (0, 0, 0)


@pytest.fixture
def attributes(frame):
    rows = [
        ("merge1", 1000.0, 20.0), ("merge2", 2000.0, 30.0), ("split", 5000.0, 61.3), ("p1", 50.0, 10.0),
        ("p2", 400.0, None), ("p", 3000.0, 40.0), ("same", None, 5.0), ("y", 9.0, 9.0),
    ]
    return SourceSet(frame("s string, n double, x double", *rows), "s", "", ["x"], "of_t", ["n"], "of_s")


def test_every_case_has_a_verdict(pairs, attributes):
    """p1 and p2 hand out only a part of what they have, so their case cannot be closed; the
    source without a count has no verdict."""
    got = areal_interpolate(pairs, "s", "t", [attributes], unallocated=False)
    rows = {(r.first_source, r.measure): r for r in case_verdicts(pairs, "s", "t", attributes, got).collect()}
    assert len(rows) == 8
    assert {k: r.passed for k, r in rows.items() if k[1] == "n"} == {
        ("merge1", "n"): True, ("split", "n"): True, ("p", "n"): False, ("same", "n"): None
    }
    merged = rows["merge1", "n"]
    assert (merged.before_low, merged.before_high, merged.after_low, merged.test) == (3000.0, 3000.0, 3000.0, "total")
    assert all(rows[c, "x"].passed for c in ("merge1", "split", "p", "same"))
    split = rows["split", "x"]
    assert (split.before_low, split.before_high, split.after_low, split.after_high) == (61.3,) * 4
    assert (split.kind, split.sources, split.targets, split.test) == ("split", 1, 2, "range")


def test_a_wrong_mean_or_total_fails(pairs, attributes):
    got = areal_interpolate(pairs, "s", "t", [attributes], unallocated=False)
    spoilt = got.withColumns(
        {
            "x": F.when(F.col("t") == "s2", F.col("x") + 0.01).otherwise(F.col("x")),
            "n": F.when(F.col("t") == "m", F.col("n") - 0.01).otherwise(F.col("n")),
        }
    )
    rows = {(r.first_source, r.measure): r.passed for r in case_verdicts(pairs, "s", "t", attributes, spoilt).collect()}
    assert rows["split", "x"] is False and rows["merge1", "n"] is False
    assert rows["merge1", "x"] and rows["split", "n"]


@pytest.mark.parametrize("n", [LITERALS, LITERALS + 1, 1000])
def test_chosen_by_list_or_table(frame, spark, n):
    rows = frame("k long, x string", *[(i, str(i)) for i in range(0, 3000, 2)], (None, "none"))
    chosen = [*range(n - 2), None, 5][:n]
    want = [(i, str(i)) for i in range(0, n - 2, 2)]
    by_list, by_table = among(rows, "k", chosen), among(rows, "k", spark.createDataFrame([(c,) for c in chosen], "z long"))
    assert sorted(map(tuple, by_list.collect())) == sorted(map(tuple, by_table.collect())) == want
    texts = rows.select(F.col("k").cast("string").alias("k"), "x")
    assert sorted(int(r.k) for r in among(texts, "k", chosen).collect()) == [i for i, _ in want]


def test_all_and_none_chosen(frame):
    rows = frame("k long", (1,), (None,))
    assert among(rows, "k", None).count() == 2
    assert among(rows, "k", []).count() == 0


def test_checks_take_tables_of_keys(pairs, attributes, frame):
    got = areal_interpolate(pairs, "s", "t", [attributes], unallocated=False)
    keys = frame("key string", ("m",), ("s1",), ("m",))
    by_list = target_check(got, pairs, "s", "t", attributes, targets=["m", "s1"])
    assert rows_of(target_check(got, pairs, "s", "t", attributes, targets=keys)) == rows_of(by_list)
    sources = frame("key string", ("split",))
    assert rows_of(source_check(pairs, "s", attributes, sources=sources)) == [("split", "split", "n", 5000.0, 5000.0, True)]
    row = closed_case_check("c", got, "t", keys, "n", attributes.rows, "s", frame("k string", ("merge1",), ("merge2",), ("split",)), "n")
    assert row.first().targets_found == 2


def test_a_long_list_is_no_part_of_the_plan(spark, tmp_path):
    rows = spark.range(300_000).withColumn("x", F.rand(1))
    rows.write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    chosen_keys(rows, "id", range(1000))  # the first use of a session starts more than this
    start = time.perf_counter()
    kept = among(rows, "id", range(100_000))
    plan = kept._jdf.queryExecution().toString()
    assert time.perf_counter() - start < 2  # 0.3 s where nothing else runs
    assert len(plan) < 10_000
    assert kept.count() == 100_000


def test_a_long_list_filters_the_large_side_before_its_shuffle(spark, tmp_path):
    """Where neither side can be broadcast: its range in the scan, its Bloom filter after."""
    options = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    }
    before = {k: spark.conf.get(k) for k in options}
    spark.range(50_000).withColumn("x", F.rand(1)).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    try:
        for key, value in options.items():
            spark.conf.set(key, value)
        kept = among(rows, "id", list(range(100, 20_000, 7)))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "might_contain" in plan
        assert "GreaterThanOrEqual(id,100)" in plan and "LessThanOrEqual(id,19994)" in plan
        assert kept.count() == len(range(100, 20_000, 7))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
