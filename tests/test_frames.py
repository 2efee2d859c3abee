"""Equality of tables by fingerprints against a plain comparison."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from areashift.operators import frames
from areashift.operators.frames import fingerprints, frame_differences, frame_equality

SCHEMA = "k string, x double, s string"
COLUMNS = ["x", "s"]


def plain(left, right, tolerance=0.0):
    """(n_rows, match_x, match_s, differences) by counting rows under each key."""
    sides = defaultdict(lambda: (Counter(), Counter()))
    for rows, i in ((left, 0), (right, 1)):
        for k, x, s in rows:
            sides[k][i][x, s] += 1
    n = [0, 0, 0]
    found = {}
    for k, (a, b) in sides.items():
        both = a & b
        over = a - both, b - both
        n[0] += max(a.total(), b.total())
        n[1] += both.total()
        n[2] += both.total()
        if not over[0] and not over[1]:
            continue
        columns = None
        if over[0].total() == over[1].total() == 1:
            (x, s), (y, t) = next(iter(over[0])), next(iter(over[1]))
            near = x == y or (None not in (x, y) and abs(x - y) <= tolerance * max(abs(x), 1))
            n[1] += near
            n[2] += s == t
            columns = [c for c, same in (("x", near), ("s", s == t)) if not same]
        if columns != []:
            found[k] = (over[0].total(), over[1].total(), columns)
    return (*n, found)


def check(frame, left, right, tolerance=0.0, buckets=8):
    a, b = frame(SCHEMA, *left), frame(SCHEMA, *right)
    row = frame_equality(a, b, ["k"], COLUMNS, tolerance, buckets).first()
    n, x, s, found = plain(left, right, tolerance)
    assert (row.n_rows, row.match_x, row.match_s, row.min_matches) == (n, x, s, min(x, s))
    assert row.equal == (min(x, s) == n)
    got = frame_differences(a, b, ["k"], COLUMNS, tolerance, buckets).collect()
    assert {r.k: (r.only_left, r.only_right, r["columns"]) for r in got} == found


def some_rows(rng, n):
    return [(rng.choice([*"abcdefgh", None]), rng.choice([None, 1.0, 2.5]), rng.choice(["p", "q", None])) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_any_rows(frame, seed):
    rng = random.Random(seed)
    left = some_rows(rng, 25)
    changed = left[2:] + some_rows(rng, 3)
    rng.shuffle(changed)
    check(frame, left, changed)


def test_repeated_rows_in_another_order(frame):
    rows = [("a", 1.0, "p")] * 5 + [("b", None, None)] * 3 + [("a", 2.0, "p")]
    check(frame, rows, rows[::-1])
    check(frame, rows, rows[1:])
    check(frame, rows, [("a", 1.0, "p")])


def test_tolerance_on_both_sides_of_an_edge(frame):
    """Values so close that some pairs straddle an edge between two cells, and some beyond."""
    rng = random.Random(1)
    left = [(f"k{i}", (1 if i % 2 else -1) * 10 ** rng.uniform(-3, 12), "s") for i in range(400)]
    near = [(k, x + 0.9e-6 * max(abs(x), 1) * rng.uniform(-1, 1), s) for k, x, s in left]
    check(frame, left, near, 1e-6, 64)
    far = [(k, x + (3e-6 * max(abs(x), 1) if i % 50 == 0 else 0), s) for i, (k, x, s) in enumerate(near)]
    check(frame, left, far, 1e-6, 64)


def test_cells_hold_close_values_only(frame):
    """Equal cells mean values within the tolerance, at any size."""
    rng = random.Random(2)
    rows = [(rng.choice([-1, 1]) * 10 ** rng.uniform(-9, 15),) for _ in range(300)]
    values = frame("x double", *[(x * (1 + d),) for (x,) in rows for d in (0, 1e-7, 2e-6)])
    cells = values.groupBy(*[c.alias(f"c{i}") for i, c in enumerate(frames._cell(F.col("x"), "double", 1e-6))])
    for r in cells.agg(F.min("x").alias("low"), F.max("x").alias("high")).collect():
        assert r.high - r.low <= 1e-6 * max(min(abs(r.low), abs(r.high)), 1)


def test_not_numbers(frame):
    odd = [("a", float("nan"), "x"), ("b", float("inf"), "x"), ("c", float("-inf"), "x"), ("d", -0.0, "x")]
    for tolerance in (0.0, 1e-6):
        assert frame_equality(frame(SCHEMA, *odd), frame(SCHEMA, *odd[:3], ("d", 0.0, "x")), ["k"], COLUMNS, tolerance).first().equal
        other = frame(SCHEMA, odd[0], ("b", float("-inf"), "x"), odd[2], odd[3])
        row = frame_equality(frame(SCHEMA, *odd), other, ["k"], COLUMNS, tolerance).first()
        assert (row.n_rows, row.match_x, row.equal) == (4, 3, False)


def test_empty_tables_and_odd_names(frame):
    a = frame("`a key` long, `v.1` double, `__left` int", (1, 2.0, 3))
    assert frame_equality(a, a, ["a key"], ["v.1"]).first().equal
    assert frame_equality(a.limit(0), a.limit(0), ["a key"], ["v.1"]).first().equal
    row = frame_equality(a, a.limit(0), ["a key"], ["v.1"]).first()
    assert (row.n_rows, row["match_v.1"], row.equal) == (1, 0, False)


def test_equal_tables_are_never_joined(spark, frame, monkeypatch):
    monkeypatch.setattr(frames, "_settled", lambda *a: pytest.fail("read again"))
    rows = spark.range(10_000).selectExpr("id % 100 AS k", "id * 0.1D AS x")
    assert frame_equality(rows, rows.repartition(13), ["k"], ["x"]).first().equal


def test_fingerprints_are_one_aggregate_combined_before_the_shuffle(spark, frame):
    rows = spark.range(1000).selectExpr("id % 10 AS k", "id * 0.1D AS x")
    text = fingerprints(rows, rows, ["k"], ["x"])._jdf.queryExecution().executedPlan().toString()
    assert text.count("HashAggregate") == 2 and text.count("Exchange") == 1 and "Join" not in text


def test_only_rows_of_differing_buckets_are_shuffled(spark):
    left = spark.range(50_000).selectExpr("id AS k", "id * 0.1D AS x")
    right = left.withColumn("x", F.expr("CASE WHEN k = 7 THEN 0 ELSE x END"))
    marks = fingerprints(left, right, ["k"], ["x"], buckets=1 << 14).where("NOT same")
    assert marks.count() == 1 and marks.first().n_left < 30
    (row,) = frame_differences(left, right, ["k"], ["x"]).collect()
    assert (row.k, row.only_left, row.only_right, row["columns"]) == (7, 1, 1, ["x"])
