"""The three analyses end to end on landed files, and the readers and writers under them."""

import csv
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

import landed
from areashift.plans import focus_region, national, regional_average
from areashift.plans.inputs import Region
from areashift.schemas import PIVOT_HEADINGS_ALL_CLASSES, STATE_CODES, current_rates
from areashift.sources.readers import (
    pull_demographics,
    read_crosswalk,
    read_delimited,
    read_facts,
    read_group_lookup,
    read_rates,
    read_snapshot,
    state_codes,
)
from areashift.sources.writers import (
    publish_views,
    with_row_index,
    write_export,
    write_report,
)
from areashift.operators.joins import restrict_to
from areashift.operators.peers import assign_groups, first_codes
from areashift.operators.reports import pivot_order, pivoted_report
from areashift.session import use_checkpoints
from conftest import rows_of

REGION = Region("17", ("031", "197", "043", "089"))
CENTRAL = (
    "GEOID20 hhinc10 hispa10 white10 black10 asian10 other10 nonwh10 popul10 hhold10 hunit10 "
    "hhinc18 hispa18 white18 black18 asian18 other18 nonwh18 povty lmeng popul18 hhold18 hunit18 "
    "GEO_ID state county tract NAME CRRALL CRRINT RESP_DATE FSRR2010 dif race_maj10 race_maj18"
).split()


@pytest.fixture(scope="module")
def paths(spark, tmp_path_factory):
    return landed.land(spark, tmp_path_factory.mktemp("landed"))


# readers


def test_facts_prune_partitions_and_keep_zeros(spark, paths):
    facts = read_facts(spark, paths.facts, 2010, "acs5", "tract", "01")
    assert {r.state for r in facts.select("state").distinct().collect()} == {"01"}
    plan = facts._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :]
    for column in ("geography", "year", "survey", "state"):
        assert f"({column}#" in filters.split("PushedFilters")[0]


def test_demographics_pull(spark, paths):
    wide = pull_demographics(
        spark, paths.facts, 2018, "acs5", ["B01001_001"], "tract", "17", ["031"]
    )
    assert wide.columns == ["GEOID", "NAME", "B01001_001E", "B01001_001M"]
    assert {r.GEOID for r in wide.collect()} == {c for c in landed.OLD_TRACTS if c[:5] == "17031"}


def test_crosswalk_codes(spark, paths):
    rows = {r.GEOID10: r for r in read_crosswalk(spark, paths.crosswalk).collect()}
    assert rows["01001020100"].STATEFP10 == "01" and rows["01001020100"].COUNTYFP10 == "001"
    assert rows["17031490400"].HU10PCT_T20 == 32.2


def test_group_lookup(spark, paths):
    lookup = read_group_lookup(spark, paths.group_lookup)
    assert lookup.columns == ["MSA_GEOID", "MSA", "County_GEOID", "county_name"]
    rows = rows_of(lookup)
    assert ("11111", "Lakes, IL", "17031", "Cook County, IL") in rows
    assert ("22222", "South", "01001", "Autauga") in rows
    assert ("33333", "Small", "17043", None) in rows


def test_byte_order_mark_is_not_in_the_header(spark, paths):
    assert read_snapshot(spark, paths.snapshot).columns == ["GEO_ID", "CRRALL"]


@pytest.mark.parametrize("kind", ["json", "csv"])
def test_rates_in_other_formats(spark, paths, tmp_path, kind):
    rates = read_rates(spark, f"{paths.current_rates}/tract", current_rates("tract"))
    writer = rates.write.option("header", True).option("nullValue", "NA")
    writer.format(kind).save(str(tmp_path / kind))
    again = read_rates(spark, str(tmp_path / kind), current_rates("tract"), kind, "01")
    assert rows_of(again) == rows_of(rates.where("state = '01'"))


def test_delimited_numbers_do_not_fail(spark, tmp_path):
    (tmp_path / "x.csv").write_text('GEO_ID,CRRALL\n"a ""b""",oops\nc,NA\nd,1.5\n')
    rows = rows_of(read_delimited(spark, str(tmp_path / "x.csv"), read_snapshot_schema()))
    assert rows == [('a "b"', None), ("c", None), ("d", 1.5)]


def read_snapshot_schema():
    from areashift.schemas import SNAPSHOT

    return SNAPSHOT


def test_state_codes(spark):
    codes = [r[0] for r in first_codes(state_codes(spark), "state_code", 51).collect()]
    assert codes == STATE_CODES and len(codes) == 51 and codes[0] == "01"


# national comparison


@pytest.fixture(scope="module")
def national_units(spark, paths):
    return national.metro_units(spark, paths, k=2).cache()


def test_central_table(spark, paths):
    tracts = national.tract_units(spark, paths)
    assert tracts.columns == CENTRAL
    rows = {r.GEOID20: r for r in tracts.collect()}
    merged = rows["17031490200"]
    assert merged.popul10 == 3000.0 and merged.hunit18 == 1500.0
    assert merged.hhinc10 == pytest.approx(46780) and merged.race_maj10 == "hispa"
    assert merged.dif == -5.0 and merged.CRRALL == 55.0 and merged.povty == pytest.approx(12.5)
    assert rows["17031806005"].race_maj18 == "white"
    assert rows["17197880903"].race_maj10 == "none"
    assert rows["17043000200"].hunit10 == 0.0 and rows["17043000200"].race_maj10 == "none"
    # No usable current rate: the interpolated tract stays, without rates.
    assert rows["17043000901"].GEO_ID is None
    assert rows[None].popul10 == 0.0 and rows[None].white10 is None


def test_peer_metros(spark, paths):
    assert [r.GEOID for r in national.peer_metros(spark, paths, 2).collect()] == ["11111", "22222"]


def test_metro_units(national_units):
    got = rows_of(national_units.select("GEOID20", "MSA"))
    assert got == [
        ("01001020100", "South"),
        ("17031490200", "Focus Region"), ("17031490200", "Lakes, IL"),
        ("17031806005", "Focus Region"), ("17031806005", "Lakes, IL"),
        ("17031806006", "Focus Region"), ("17031806006", "Lakes, IL"),
        ("17197880903", "Lakes, IL"),
    ]


def test_peers_filtered_first_or_last(spark, paths, national_units):
    everything = national.tract_units(spark, paths).withColumn(
        "stateCountyFIPS", F.substring("GEOID20", 1, 5)
    )
    lookup = read_group_lookup(spark, paths.group_lookup)
    grouped = assign_groups(everything, lookup, "stateCountyFIPS", "County_GEOID")
    last = restrict_to(grouped, "MSA_GEOID", national.peer_metros(spark, paths, 2), "GEOID")
    assert national_units.columns == last.columns
    assert rows_of(national_units) == rows_of(last)


def test_national_comparison(national_units):
    table = national.published(national.compare(national_units))
    assert table.columns == [
        "race", "responses10", "responses20", "difference", "n10", "n20", "MSA",
    ]
    rows = {(r.race, r.MSA): r for r in table.collect()}
    lakes = rows[("all", "Lakes, IL")]
    weights = (1500.0, 1125.0, 1375.0, 1530.0)
    prior = sum(w * r for w, r in zip(weights, (60, 78, 74, 65))) / sum(weights)
    assert lakes.responses10 == pytest.approx(prior) and lakes.n10 == 4
    assert rows[("all", "all")].n10 == 8
    once = national.compare(national_units, dedupe_total=True)
    assert once.where("class = 'all' AND `group` = 'all'").first().n_prior == 5


def test_national_run(spark, paths, tmp_path):
    tables = national.run(spark, paths, str(tmp_path), "Focus Region")
    assert tables["units"].columns[:35] == CENTRAL
    focus = read_csv(tmp_path / "focus_tracts")
    assert len(focus) == 4 and focus[0][:35] == CENTRAL

    pivoted = read_csv(tmp_path / "group_changes")
    assert pivoted[0] == ["row_id", "MSA", "Overall Change", "Hispanic Tract Change"]
    assert [r[:2] for r in pivoted[1:]] == [["1", "South"], ["2", "Lakes, IL"], ["3", "Small"]]
    assert pivoted[1][3] == "NA"
    assert float(pivoted[1][2]) == pytest.approx(-0.05)

    ranked = read_csv(tmp_path / "class_ranking")
    assert ranked[0][1] == "Tract Racial Majority"
    assert [r[:2] for r in ranked[1:]] == [["1", "White"], ["2", "Hispanic"]]
    assert [r[4:] for r in ranked[1:]] == [["2", "2"], ["1", "1"]]
    assert rows_of(tables["class_hispa"].select("group")) == [
        ("Focus Region",), ("Lakes, IL",), ("all",),
    ]
    assert tables["chart"].where("`group` = 'all'").count() == 0


# focus region


@pytest.fixture(scope="module")
def region(spark, paths):
    return focus_region.region_tables(spark, paths, REGION)


def test_region_filters_reach_the_scan(region):
    plan = region.demographics_2010._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "(state#" in plan
    assert region.crosswalk.count() == 9


def test_conservation_in_the_region(region):
    got = {r.figure: r for r in focus_region.conservation(region).collect()}
    assert set(got) == {f"{m}{s}" for m in ("popul", "hunit", "hhinc") for s in ("10", "18")}
    # The fixture drops people on purpose: shares below 100, one tract out of the crosswalk.
    assert got["popul10"].before == 17500.0 and got["popul10"].after == pytest.approx(11060.0)
    assert not got["popul10"].passed


def test_case_verdicts(region):
    rows = focus_region.case_verdicts(region).collect()
    got = {(r.case, r.unit, r.measure, i) for i, r in enumerate(rows) if r.passed}
    names = {(c, u, m) for c, u, m, _ in got}
    assert ("merged10", None, "popul") in names and ("split18", None, "popul") in names
    assert ("averaged", "17031490200", "hhinc") in names
    assert ("allocated", "17197880903", "popul") in names
    assert ("inherited", "17031806005", "white") in names
    assert not [r for r in rows if r.passed is False]
    undecided = {(r.case, r.unit, r.measure) for r in rows if r.passed is None}
    assert undecided == {("averaged", "17197880903", "hhinc")}


def test_region_places(spark, paths):
    (row,) = focus_region.region_places(spark, paths, REGION).collect()
    assert row.GEOID == "1714000" and row.dif == pytest.approx(2.5)
    assert (row.other, row.nonwh, row.popul) == (5.0, 40.0, 100.0)


def test_region_run(spark, paths, tmp_path):
    everywhere = national.tract_units(spark, paths).where(
        (F.col("state") == "17") & F.col("county").isin(list(REGION.counties))
    )
    results = focus_region.run(spark, paths, str(tmp_path), everywhere, REGION)
    assert results["same_as_national"].first().equal
    written = {name: read_csv(tmp_path / name) for name in results}
    assert len(written["focus_places"]) == 2 and len(written["conservation"]) == 7
    assert written["focus_places"][0][:5] == ["GEOID", "GEO_ID", "state", "place", "NAME"]


def test_missing_responses(spark, paths):
    report = focus_region.missing_responses(spark, paths, "tract", REGION).first()
    assert (report.units, report.missing_any) == (6, 1)
    report = focus_region.missing_responses(spark, paths, "place", REGION).first()
    assert (report.units, report.missing_CRRALL) == (3, 1)


def test_filter_first_equals_filter_last(spark, paths):
    here = focus_region.region_tracts(spark, paths, REGION)
    everywhere = national.tract_units(spark, paths).where(
        (F.col("state") == "17") & F.col("county").isin(list(REGION.counties))
    )
    result = focus_region.same_as_national(here, everywhere).first()
    assert result.n_rows == 5 and result.equal


# regional average


def test_region_average(spark, paths):
    frame = regional_average.region_frame(spark, paths, REGION)
    rows = {r.county: r for r in frame.collect()}
    assert set(rows) == {"031", "197"}
    assert (rows["031"].hunit10, rows["031"].hunit18) == (6010.0, 6018.0)
    assert rows["031"].hunit18alt == 4000.0 and rows["197"].CRRALL0819 == 74.5
    means = regional_average.region_means(frame).first()
    assert means.prior == pytest.approx((66 * 6010 + 77 * 6110) / 12120)
    assert means.current_tract_housing == pytest.approx((63.1 * 4000 + 75.2 * 4000) / 8000)
    assert means.snapshot == pytest.approx((65 * 6018 + 74.5 * 6118) / 12136)


def test_county_discrepancy(spark, paths, national_units):
    focus = national_units.where("MSA = 'Focus Region'")
    frame = regional_average.region_frame(spark, paths, REGION)
    (row,) = regional_average.county_discrepancy(focus, frame).collect()
    want = (60 * 1500 + 78 * 1125 + 74 * 1375) / 4000
    assert (row.county, row.FSRR2010, row.NAME) == ("031", 66.0, "County 031")
    assert row["sum"] == pytest.approx(want)


def test_average_run(spark, paths, national_units, tmp_path):
    focus = national_units.where("MSA = 'Focus Region'")
    regional_average.run(spark, paths, str(tmp_path), focus, REGION)
    assert read_csv(tmp_path / "region_means")[0] == list(regional_average.MEANS)
    assert len(read_csv(tmp_path / "county_discrepancy")) == 2


# writers


def read_csv(folder):
    rows = []
    for part in sorted(Path(folder).glob("part-*.csv")):
        with open(part, newline="") as f:
            body = list(csv.reader(f))
        rows += body if not rows else body[1:]
    return rows


def test_row_index_over_many_partitions(spark):
    rows = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("x")).repartition(13)
    indexed = with_row_index(rows, [F.desc("x")])
    assert [tuple(r) for r in indexed.orderBy("row_id").collect()] == [
        (i + 1, 4999 - i) for i in range(5000)
    ]


def test_report_files_are_in_order(spark, tmp_path):
    rows = spark.range(0, 300).select((F.col("id") * 31 % 300).alias("x")).repartition(5)
    write_report(rows, [F.asc("x")], str(tmp_path / "r"))
    body = read_csv(tmp_path / "r")
    assert body[0] == ["row_id", "x"]
    assert [tuple(map(int, r)) for r in body[1:]] == [(i + 1, i) for i in range(300)]


def test_export_keeps_values(frame, tmp_path):
    rows = frame("s string, x double", (" a, b ", 1.5), ('q"', None), (None, 2.0))
    write_export(rows, str(tmp_path / "e"))
    assert sorted(read_csv(tmp_path / "e")[1:]) == [[" a, b ", "1.5"], ["NA", "2.0"], ['q"', "NA"]]


def test_views(spark, frame):
    table = frame("class string, x int", ("all", 1), ("hispa", 2))
    assert publish_views(spark, table, ["all", "hispa"]) == ["class_all", "class_hispa"]
    assert spark.sql("SELECT x FROM class_hispa").first().x == 2


def test_checkpoints_need_a_shared_folder(spark):
    use_checkpoints(spark)
    assert spark.sparkContext.getCheckpointDir()


# shape of the published reports


def test_published_report_shape(spark):
    groups = spark.range(21).selectExpr("concat('Metro ', lpad(id, 2, '0')) AS `group`", "id")
    classes = spark.createDataFrame(
        [(c, i) for i, c in enumerate(PIVOT_HEADINGS_ALL_CLASSES)], "class string, i int"
    )
    cells = groups.join(classes, F.expr("NOT (class = 'black' AND id % 4 = 0)")).selectExpr(
        "class", "`group`", "60D AS prior", "61D AS current",
        "CAST((id * 7) % 20 - 10 + i AS DOUBLE) AS difference", "2L AS n_prior", "2L AS n_current",
    )
    report = pivoted_report(
        cells, PIVOT_HEADINGS_ALL_CLASSES, "MSA", excluded_groups=["all", "Metro 20"]
    )
    rows = report.orderBy(*pivot_order(PIVOT_HEADINGS_ALL_CLASSES, "MSA")).collect()
    assert report.columns == ["MSA", *PIVOT_HEADINGS_ALL_CLASSES.values()]
    assert len(rows) == 20 and "Metro 20" not in {r.MSA for r in rows}
    overall = [r["Overall Change"] for r in rows]
    assert overall == sorted(overall) and max(map(abs, overall)) < 1
    assert sum(r["Black Tract Change"] is None for r in rows) == 5


def test_checkpoints_go_where_all_machines_see_them():
    class Context:
        master = "spark://host:7077"
        folder = None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        def __init__(self, **conf):
            self.conf, self.sparkContext = conf, Context()

    unset = Session(**{"spark.sql.warehouse.dir": "hdfs:///warehouse"})
    use_checkpoints(unset)
    assert unset.sparkContext.folder == "hdfs:///warehouse/_scratch"
    shared = Session(**{"spark.checkpoint.dir": "hdfs:///shared"})
    use_checkpoints(shared)
    assert shared.sparkContext.folder == "hdfs:///shared"


def test_command_line(spark, paths, tmp_path):
    from areashift.__main__ import main

    arguments = ["--out", str(tmp_path), "--focus-label", "Focus Region", "--counties", "031", "197"]
    for name, value in vars(paths).items():
        arguments += [f"--{name.replace('_', '-')}", value]
    main([*arguments, "--all-classes", "--threshold", "45", "--peers", "3"])
    for name in (
        "focus_tracts", "group_changes", "class_ranking", "focus_places", "region_means",
        "comparison", "chart", "class_all",
    ):
        assert len(read_csv(tmp_path / name)) > 1, name
    header = read_csv(tmp_path / "group_changes")[0]
    assert header == ["row_id", "MSA", *PIVOT_HEADINGS_ALL_CLASSES.values()]
    assert read_csv(tmp_path / "comparison")[0] == [
        "race", "responses10", "responses20", "difference", "n10", "n20", "MSA",
    ]


def test_cells_with_line_breaks(frame, spark, tmp_path):
    schema = StructType([StructField("s", StringType()), StructField("x", DoubleType())])
    rows = frame("s string, x double", ("a\nb", 1.0), ('c "d",\r\ne', 2.0), ("f", None)).coalesce(1)
    write_export(rows, str(tmp_path / "t"))
    read = read_delimited(spark, str(tmp_path / "t"), schema)
    assert rows_of(read) == rows_of(rows)
    with pytest.raises(Exception, match="(?i)malformed"):
        read_delimited(spark, str(tmp_path / "t"), schema, multiline=False).collect()
    write_export(rows.where("x IS NULL"), str(tmp_path / "u"))
    plain = read_delimited(spark, str(tmp_path / "u"), schema, multiline=False)
    assert rows_of(plain) == [("f", None)]
