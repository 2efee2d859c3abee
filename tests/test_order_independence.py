"""Results that do not depend on how rows are dealt, and keys that many rows share."""

import math
import random
import statistics

import duckdb
import pytest
from pyspark.sql import functions as F

from areashift.functions import allocate_sum, exact_sum, strict_sum, total, weighted_mean
from areashift.operators import SourceSet, areal_interpolate
from areashift.operators.compare import Period, compare_periods
from areashift.operators.rates import align_vintages, join_vintages
from areashift.sources.writers import with_row_index
from conftest import rows_of

# exact sums


def wild(n, seed, low=-20, high=20):
    rng = random.Random(seed)
    return [rng.choice([-1, 1]) * 10 ** rng.uniform(low, high) for _ in range(n)]


@pytest.mark.parametrize("low, high", [(-20, 20), (-3, 3), (0, 29), (-30, -22)])
def test_exact_sum_is_the_sum(frame, low, high):
    values = wild(2000, low, low, high)
    values += [-v for v in values[:1900]]
    random.Random(1).shuffle(values)
    got = frame("x double", *[(v,) for v in values]).repartition(7).agg(exact_sum("x")).first()[0]
    # exact but for what is finer than 2^-80 in a value, and the rounding of the result
    assert got == pytest.approx(math.fsum(values), rel=1e-15, abs=len(values) * 2.0**-80)


def test_odd_values(frame):
    inf, nan = float("inf"), float("nan")

    def of(*values):
        return frame("x double", *[(v,) for v in values]).agg(exact_sum("x")).first()[0]

    assert of(1.0, None, 2.5) == 3.5 and of(None) is None
    assert of(-0.0) == 0.0 and of(1.0, inf) == inf and of(-inf, 2.0) == -inf
    assert math.isnan(of(inf, -inf)) and math.isnan(of(nan, 1.0))
    assert of(1e300, 1.0, 1e300) == 2e300 and of(2.0**100, -(2.0**100), 0.1) == 0.1
    assert frame("x double").agg(exact_sum("x")).first()[0] is None


def bits(rows):
    """Every value as it is stored."""
    return sorted(str([v.hex() if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.fixture(scope="module")
def measured(spark):
    rows = [(i % 5, v, abs(math.sin(i))) for i, v in enumerate(wild(5000, 9, -6, 9))]
    return spark.createDataFrame(rows, "k long, x double, w double")


def test_aggregates_are_equal_to_the_bit(measured):
    def run(rows):
        return bits(
            rows.groupBy("k").agg(
                weighted_mean("x", "w", add=exact_sum), allocate_sum("x", "w", exact_sum),
                total("x", exact_sum), strict_sum("x", exact_sum),
            ).collect()
        )

    plain = [bits(measured.repartition(n, "w").groupBy("k").agg(F.sum("x")).collect()) for n in (1, 64)]
    assert run(measured.coalesce(1)) == run(measured.repartition(64, "w")) == run(measured.orderBy("x"))
    assert plain[0] != plain[1]  # which plain sums are not


def test_exact_agrees_with_plain_rules(frame):
    """Missing values and weights count the same."""
    rows = [("a", 10.0, 50.0), ("a", None, 50.0), ("b", 1.0, None), ("b", 2.0, 3.0), ("c", None, 1.0), ("d", 1.0, 0.0),
            ("e", None, 0.0), ("e", 4.0, 2.0), ("f", float("nan"), 1.0)]
    grouped = frame("k string, x double, w double", *rows).groupBy("k")
    for aggregate in (weighted_mean, lambda *a, **k: weighted_mean(*a, na_rm=False, **k)):
        assert rows_of(grouped.agg(aggregate("x", "w", add=exact_sum).alias("m"))) == rows_of(grouped.agg(aggregate("x", "w").alias("m")))
    for one in (strict_sum, total):
        assert rows_of(grouped.agg(one("x", exact_sum).alias("m"))) == rows_of(grouped.agg(one("x").alias("m")))


def test_interpolation_and_comparison_are_equal_to_the_bit(spark, measured):
    pairs = measured.select(F.abs(F.hash("x") % 97).alias("s"), F.col("k").alias("t"), F.col("w").alias("share"))
    units = spark.createDataFrame([(i, v, abs(v)) for i, v in enumerate(wild(97, 4, -3, 6))], "s long, x double, n double")
    found, compared = set(), set()
    for n in (1, 64):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        dealt = pairs.repartition(n, "share")
        one = SourceSet(units, "s", "", ["x"], "share", ["n"], "share")
        found.add(str(bits(areal_interpolate(dealt, "s", "t", [one], exact=True).collect())))
        rates = measured.repartition(n, "w").selectExpr("string(k % 2) AS c", "string(k) AS g", "x AS r", "w")
        period = Period("c", "r", "w")
        compared.add(str(bits(compare_periods(rates, "g", period, period, exact=True).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(found) == len(compared) == 1


def test_exact_sums_combine_before_the_shuffle(frame):
    rows = frame("k string, x double", ("a", 1.0))
    text = rows.groupBy("k").agg(exact_sum("x"))._jdf.queryExecution().executedPlan().toString()
    assert text.count("HashAggregate") == 2 and "partial_sum" in text and "SortAggregate" not in text


# numbers of rows over ties


def test_ties_are_dealt_over_tasks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n = F.col("id")
        rows = spark.range(48_000).select(F.when(n % 3 == 0, F.lit(7)).otherwise(n % 1000).alias("x"), n.alias("y"))
        same = spark.range(48_000).select(F.when(n % 3 == 0, F.lit(7)).otherwise(n % 1000).alias("x"))
        for table in (rows, same):  # a third of the rows tied, and equal as a whole
            numbered = with_row_index(table, [F.asc("x")])
            sizes = [r["count"] for r in numbered.groupBy(F.spark_partition_id()).count().collect()]
            assert len(sizes) > 10 and max(sizes) <= 2 * statistics.median(sizes)
            ids = numbered.select("row_id", "x").toPandas().sort_values("row_id")
            assert (ids.row_id.to_numpy() == range(1, 48_001)).all() and ids.x.is_monotonic_increasing
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_ties_are_numbered_alike_whatever_the_partitions(spark):
    rows = spark.range(900).selectExpr("id % 3 AS x", "id AS y", "map('a', id) AS m")
    numbered = [rows_of(with_row_index(r, [F.desc("x")]).select("row_id", "x", "y")) for r in (rows.coalesce(1), rows.repartition(9))]
    assert numbered[0] == numbered[1]


# vintages


def test_a_hot_repeated_unit_is_refused(spark):
    many = spark.range(10_000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k", "1.0D AS r18")
    once = spark.range(10_000).selectExpr("id AS k", "2.0D AS r10")
    for current, prior in ((many, once), (once.toDF("k", "r18"), many.toDF("k", "r10"))):
        with pytest.raises(Exception, match="unit occurs twice in one vintage: 0"):
            align_vintages(current, prior, ["k"], "r18", "r10").collect()


def test_vintages_as_a_full_join_has_them(frame):
    current = frame("id string, name string, r18 string, day string", ("a", "A", "64.1", "d"), ("b", "B", "x", None),
                    ("c", "C", "50", "e"), (None, "N", "1", "f"), ("d", "D", None, "g"))
    prior = frame("code string, name string, r10 double, `odd col` int", ("a", "A", 66.0, 1), ("b", "B", 70.0, 2),
                  ("c", "C2", 52.0, 3), (None, "N", 2.0, 4), ("e", "E", float("nan"), 5))
    joined = join_vintages(current, prior, [("id", "code"), "name"], "r18", "r10")
    assert joined.columns == ["id", "name", "r18", "day", "r10", "odd col", "dif"]
    assert rows_of(joined) == rows_of(
        frame(
            "id string, name string, r18 double, day string, r10 double, o int, dif double",
            ("a", "A", 64.1, "d", 66.0, 1, 64.1 - 66.0), ("b", "B", None, None, 70.0, 2, None),
            ("c", "C", 50.0, "e", None, None, None), ("c", "C2", None, None, 52.0, 3, None),
            (None, "N", 1.0, "f", 2.0, 4, -1.0), ("d", "D", None, "g", None, None, None), ("e", "E", None, None, None, 5, None),
        )
    )
    with pytest.raises(ValueError, match="both vintages have"):
        join_vintages(current, prior.withColumn("day", F.lit(1)), [("id", "code"), "name"], "r18", "r10")


def test_empty_vintages(frame):
    current, prior = frame("k string, r18 string", ("a", "1")), frame("k string, r10 double", ("a", 2.0))
    assert join_vintages(current.limit(0), prior.limit(0), ["k"], "r18", "r10").count() == 0
    assert rows_of(join_vintages(current, prior.limit(0), ["k"], "r18", "r10")) == [("a", 1.0, None, None)]


def test_distinct_numbers_are_found_by_tasks_of_bounded_rows(spark, tmp_path, monkeypatch):
    """More lines, more tasks, whatever the shuffle partitions; missing and repeated keys count alike."""
    from queries import oracle
    from queries import spark as named_queries

    rows = [(i % 400 if i % 50 else None, i % 3, "ANR"[i % 3] if i % 7 else None) for i in range(3000)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_returnflag string")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(named_queries, "TASK_ROWS", 100)
    found = named_queries.queries()["tied_row_index"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 30), REPARTITION_BY_NUM") == 2
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet' WHERE l_returnflag IS NOT NULL")
    known = named_queries.queries()["tied_row_index"](spark, str(tmp_path)).where("l_returnflag IS NOT NULL")
    n = 3000 - sum(r[2] is None for r in rows)  # missing flags come first in Spark
    want = duck.execute("SELECT l_returnflag, count(*), count(*), count(DISTINCT CASE WHEN l_orderkey IS NOT NULL THEN (l_orderkey, l_linenumber) END) FROM lineitem GROUP BY 1 ORDER BY 1").fetchall()
    got = rows_of(known)
    assert [(r[0], r[3], r[4], r[5]) for r in got] == want
    assert got[0][1] == 3000 - n + 1 and got[-1][2] == 3000
    assert all(a[2] + 1 == b[1] for a, b in zip(got, got[1:]))


def test_exact_sums_add_whole_numbers(frame):
    """No decimals before the last step, which cost several times as much to add."""
    text = frame("k string, x double", ("a", 1.0)).groupBy("k").agg(exact_sum("x"))._jdf.queryExecution().executedPlan().toString()
    partial = [line for line in text.splitlines() if "partial_sum" in line]
    assert partial and not any("decimal" in line for line in partial)
    for big in (2.0**99, -(2.0**99), 2.0**80 + 2.0**40, -1.5, -(2.0**-70)):
        assert frame("x double", *[(big,)] * 64).agg(exact_sum("x")).first()[0] == 64 * big
