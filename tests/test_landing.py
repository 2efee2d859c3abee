"""Landing that repeats, and reading of chosen states only."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from areashift.plans import national
from areashift.schemas import current_rates
from areashift.sources.landing import land_changed, land_missing, land_rates, manifest, not_landed, partition_prints
from areashift.sources.readers import read_facts, read_rates
from areashift.sources.writers import land_facts
from conftest import rows_of

SCHEMA = (
    "geography string, survey string, year int, state string, county string, GEOID string, NAME string, "
    "variable string, estimate double, moe double"
)


def fact(state, unit, estimate, year=2018, geography="tract"):
    return (geography, "acs5", year, state, "001", f"{state}{unit}", f"N{unit}", "v", estimate, None)


ROWS = [fact(s, str(i), float(i), y) for s in ("01", "02", "17") for y in (2010, 2018) for i in range(5)]


@pytest.fixture
def facts(frame):
    return frame(SCHEMA, *ROWS)


def files(path):
    found = glob.glob(f"{path}/geography=*/**/*.parquet", recursive=True)
    return {f: os.path.getmtime(f) for f in found}


def landed(spark, path):
    return sorted(map(tuple, spark.read.schema(SCHEMA).parquet(path).select(*[c.split()[0] for c in SCHEMA.split(", ")]).collect()), key=str)


def keys(df):
    return rows_of(df.select("year", "state"))


def test_second_landing_writes_nothing(spark, facts, tmp_path):
    path = str(tmp_path / "facts")
    assert len(keys(land_changed(facts, path))) == 6
    before = files(path)
    again = land_changed(facts.orderBy(F.desc("estimate")).repartition(5), path)
    assert again.count() == 0 and files(path) == before
    assert landed(spark, path) == sorted(ROWS, key=str)


def test_a_changed_state_is_one_partition(spark, facts, tmp_path):
    path = str(tmp_path / "facts")
    land_changed(facts, path)
    before = files(path)
    hit = (F.col("state") == "02") & (F.col("year") == 2018)
    fewer = facts.where(~(hit & (F.col("estimate") == 3)))
    assert keys(land_changed(fewer, path)) == [(2018, "02")]
    after = files(path)
    assert {f for f in after if "year=2018" in f and "state=02" in f}.isdisjoint(before)
    rest = {f for f in before if not ("year=2018" in f and "state=02" in f)}
    assert {f: after[f] for f in rest} == {f: before[f] for f in rest}
    assert landed(spark, path) == sorted((r for r in ROWS if (*r[2:4], r[8]) != (2018, "02", 3.0)), key=str)
    assert keys(land_changed(facts.where("year = 2018"), path)) == [(2018, "02")]
    assert landed(spark, path) == sorted(ROWS, key=str)


def test_only_missing_partitions_are_loaded(spark, facts, tmp_path):
    path, asked = str(tmp_path / "facts"), []

    def load(missing):
        asked.append(keys(missing))
        return facts.join(missing, missing.columns, "left_semi")

    first = facts.where("state <> '17'")
    assert len(keys(land_missing(first, load, path))) == 4
    assert keys(land_missing(facts, load, path)) == [(2010, "17"), (2018, "17")]
    assert land_missing(facts, load, path).count() == 0
    assert asked[1:] == [[(2010, "17"), (2018, "17")]]
    assert not_landed(facts.select("state").limit(0), path).count() == 0
    assert landed(spark, path) == sorted(ROWS, key=str)


def test_a_landing_that_broke_off_is_repeated(spark, facts, tmp_path):
    """Data without its manifest: a broken landing leaves partitions that count as missing."""
    path = str(tmp_path / "facts")
    land_facts(facts.where("state = '01'").withColumn("estimate", F.lit(0.0)), path)
    os.makedirs(f"{path}/_manifest/1")
    assert manifest(spark, path, facts.select("state").schema).count() == 0
    assert len(keys(land_changed(facts, path))) == 6
    assert landed(spark, path) == sorted(ROWS, key=str)


def test_repeated_rows_missing_states_and_nothing(spark, frame, tmp_path):
    path = str(tmp_path / "facts")
    rows = [fact("01", "1", 1.0), fact("01", "1", 1.0), fact(None, "2", None)]
    assert len(keys(land_changed(frame(SCHEMA, *rows), path))) == 2
    assert keys(land_changed(frame(SCHEMA, *rows[1:]), path)) == [(2018, "01")]
    assert land_changed(frame(SCHEMA, *rows[1:]), path).count() == 0
    assert land_changed(frame(SCHEMA, *rows).limit(0), path).count() == 0
    assert landed(spark, path) == sorted(rows[1:], key=str)


def test_prints_do_not_depend_on_order_or_columns_order(facts):
    one = partition_prints(facts, ["year", "state"])
    other = partition_prints(facts.select(*reversed(facts.columns)).repartition(7, "GEOID"), ["year", "state"])
    assert rows_of(one) == rows_of(other)
    assert len({tuple(r)[2:] for r in one.collect()}) == 6


def test_rates_by_state(spark, frame, tmp_path):
    path = str(tmp_path / "rates")
    schema = current_rates("tract")
    names = [f.name for f in schema.fields]
    rows = [{"state": s, "GEO_ID": f"g{s}{i}", "CRRALL": "50.5"} for s in ("01", "02") for i in range(3)]
    rates = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)
    assert rows_of(land_rates(rates, path).select("state")) == [("01",), ("02",)]
    assert land_rates(rates, path).count() == 0
    read = read_rates(spark, path, schema, state="02")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(state" in plan and "(state" in plan and read.count() == 3
    assert sorted(map(tuple, read_rates(spark, path, schema).select(*names).collect()), key=str) == sorted(
        map(tuple, rates.collect()), key=str
    )


@pytest.fixture
def lookup(spark, frame, tmp_path):
    frame("state string, metro string", ("17", "Chicago"), ("01", "Birmingham")).write.parquet(f"{tmp_path}/lookup")
    return spark.read.parquet(f"{tmp_path}/lookup").where("metro = 'Chicago'").select("state")


def test_a_lookup_prunes_the_partitions_of_facts(spark, facts, lookup, tmp_path):
    path = str(tmp_path / "facts")
    land_facts(facts, path)
    read = read_facts(spark, path, 2018, "acs5", "tract", state=lookup)
    plan = spark._jvm.PythonSQLUtils.explainString(read._jdf.queryExecution(), "formatted")
    (filters,) = [line for line in plan.splitlines() if "PartitionFilters" in line]
    assert "dynamicpruning" in filters and "state" in filters
    assert rows_of(read.select("GEOID")) == [(f"17{i}",) for i in range(5)]
    assert rows_of(read_facts(spark, path, 2018, "acs5", "tract", state=["17"])) == rows_of(read)


def test_national_comparison_reads_the_states_of_its_peers(monkeypatch):
    """The plan hands its peers' states on to facts and rates."""
    seen = {}
    monkeypatch.setattr(national, "read_crosswalk", lambda *a: FakeRows("crosswalk"))
    monkeypatch.setattr(national, "in_counties", lambda rows, *a: rows)
    monkeypatch.setattr(national, "response", lambda spark, paths, geography, states: seen.update(rates=states))
    monkeypatch.setattr(national, "tract_demographics", lambda spark, paths, states: seen.update(facts=states) or ())
    monkeypatch.setattr(national, "interpolate_tracts", lambda *a, **k: None)
    monkeypatch.setattr(national, "join_response", lambda *a: None)
    monkeypatch.setattr(national, "classify", lambda *a: None)
    monkeypatch.setattr(national, "key_prefix", lambda column, n: FakeRows(f"{column}/{n}"))

    class Paths:
        crosswalk = ""

    national.tract_units(None, Paths, unallocated=False, counties=FakeRows("counties"))
    assert seen == {"rates": "counties: County_GEOID/2", "facts": "crosswalk: GEOID10/2"}
    national.tract_units(None, Paths, unallocated=True, counties=FakeRows("counties"))
    assert seen["facts"] is None
    national.tract_units(None, Paths)
    assert seen == {"rates": None, "facts": None}


class FakeRows:
    def __init__(self, name):
        self.name = name

    def alias(self, name):
        return self.name

    def select(self, what):
        return f"{self.name}: {what}"
