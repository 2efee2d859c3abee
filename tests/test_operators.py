import random

import pytest
from pyspark.sql import functions as F

from areashift.operators.checks import (
    Conserved,
    closed_case_check,
    conservation_check,
    inherited_check,
    missing_report,
    source_check,
    summarize_checks,
    target_check,
)
from areashift.operators.compare import Period, class_view, compare_periods, totals_cube
from areashift.operators.crosswalk import build_crosswalk
from areashift.operators.demographics import clean_demographics, widen_variables
from areashift.operators.frames import frame_equality
from areashift.operators.interpolate import (
    SourceSet,
    areal_interpolate,
    attach_attributes,
    interpolate_counts,
    interpolate_means,
)
from areashift.operators.joins import (
    full_join,
    keyed_join,
    left_join,
    restrict_to,
    suffix_collisions,
)
from areashift.operators.peers import (
    assign_groups,
    first_codes,
    focus,
    partition_union,
    top_k,
)
from areashift.operators.rates import align_vintages, join_vintages
from areashift.operators.regional import discrepancy, regional_frame, regional_rollup, sums_by
from areashift.operators.reports import (
    chart_frame,
    pivot_order,
    pivoted_report,
    ranked_report,
)
from areashift.schemas import CLASS_LABELS, DEMOGRAPHICS_2010, RANKED_HEADINGS
from conftest import rows_of

CROSSWALK = [
    ("17031490400", "17031490200", 100.0, 32.2),
    ("17031490300", "17031490200", 100.0, 67.8),
    ("17031806003", "17031806005", 45.0, 100.0),
    ("17031806003", "17031806006", 55.0, 100.0),
    ("17197980100", "17197880903", 10.0, 5.0),
    ("17197884103", "17197880903", 2.0, 1.0),
    ("17197880903", "17197880903", 96.0, 94.0),
    ("17043000100", "17043000200", 0.0, 0.0),
    ("17043000900", "17043000901", 100.0, 100.0),
]
ATTRIBUTES = [
    ("17031490400", 1000.0, 40000.0, 20.0),
    ("17031490300", 2000.0, 50000.0, 30.0),
    ("17031806003", 5000.0, 70000.0, 61.3),
    ("17197980100", 1000.0, None, 50.0),
    ("17197884103", 4000.0, 60000.0, 50.0),
    ("17197880903", 3000.0, 80000.0, 50.0),
    ("17043000100", 800.0, 55000.0, 90.0),
    ("17089000100", 700.0, 45000.0, 10.0),
]
INTERPOLATED = {
    "17031490200": (3000.0, 46780.0, 26.78),
    "17031806005": (2250.0, 70000.0, 61.3),
    "17031806006": (2750.0, 70000.0, 61.3),
    "17197880903": (3060.0, 79789.473684, 50.0),
    "17043000200": (0.0, None, None),
    "17043000901": (0.0, None, None),
    None: (0.0, None, None),
}


@pytest.fixture
def crosswalk(frame):
    return frame("GEOID10 string, GEOID20 string, T10 double, T20 double", *CROSSWALK)


@pytest.fixture
def attributes(frame):
    return frame("GEOID string, popul double, hhinc double, white double", *ATTRIBUTES)


def one_set(attributes, suffix=""):
    return SourceSet(attributes, "GEOID", suffix, ["hhinc", "white"], "T20", ["popul"], "T10")


def as_expected(rows):
    assert set(rows) == set(INTERPOLATED)
    for key, want in INTERPOLATED.items():
        assert rows[key] == tuple(
            None if v is None else pytest.approx(v) for v in want
        ), key


# interpolation


def test_interpolation_by_hand(crosswalk, attributes):
    result = areal_interpolate(crosswalk, "GEOID10", "GEOID20", [one_set(attributes)])
    as_expected({r.GEOID20: (r.popul, r.hhinc, r.white) for r in result.collect()})


def test_two_vintages_in_one_pass(crosswalk, attributes):
    doubled = attributes.select("GEOID", (F.col("popul") * 2).alias("popul"), "hhinc", "white")
    later = SourceSet(
        doubled.withColumn("povty", F.lit(7.0)),
        "GEOID",
        "18",
        ["hhinc", "white", "povty"],
        "T20",
        ["popul"],
        "T10",
    )
    sets = [one_set(attributes, "10"), later]
    result = areal_interpolate(crosswalk, "GEOID10", "GEOID20", sets)
    assert result.columns == [
        "GEOID20", "hhinc10", "white10", "popul10", "hhinc18", "white18", "povty", "popul18",
    ]
    rows = result.collect()
    as_expected({r.GEOID20: (r.popul10, r.hhinc10, r.white10) for r in rows})
    as_expected({r.GEOID20: (r.popul18 / 2, r.hhinc18, r.white18) for r in rows})
    without = areal_interpolate(crosswalk, "GEOID10", "GEOID20", sets, unallocated=False)
    assert {r.GEOID20 for r in without.collect()} == set(INTERPOLATED) - {None}


def test_vintages_with_different_sources(crosswalk, attributes):
    # A source known in one vintage only must not lose or gain rows of the other.
    early = attributes.where("GEOID <> '17031490300'")
    late = attributes.where("GEOID <> '17031806003'")
    result = areal_interpolate(
        crosswalk, "GEOID10", "GEOID20", [one_set(early, "10"), one_set(late, "18")]
    )
    rows = {r.GEOID20: r for r in result.collect()}
    assert rows["17031490200"].popul10 == 1000.0 and rows["17031490200"].popul18 == 3000.0
    assert rows["17031490200"].hhinc10 == pytest.approx(40000.0)
    assert rows["17031806005"].popul18 == 0.0 and rows["17031806005"].hhinc18 is None


def test_repeated_source_is_refused(crosswalk, attributes):
    twice = attributes.unionByName(attributes.limit(1))
    sets = [one_set(attributes, "10"), one_set(twice, "18")]
    with pytest.raises(Exception, match="occurs twice in one set"):
        areal_interpolate(crosswalk, "GEOID10", "GEOID20", sets).collect()


def test_repeated_source_is_refused_with_one_set_too(crosswalk, attributes):
    twice = attributes.unionByName(attributes.limit(1))
    with pytest.raises(Exception, match="occurs twice in one set"):
        areal_interpolate(crosswalk, "GEOID10", "GEOID20", [one_set(twice, "10")]).collect()


def test_source_set_needs_weights(attributes):
    with pytest.raises(ValueError):
        SourceSet(attributes, "GEOID", means=["hhinc"]).weights


def test_means_and_counts_alone(crosswalk, attributes):
    args = (crosswalk, attributes, "GEOID10", "GEOID", "GEOID20")
    means = {r.GEOID20: r for r in interpolate_means(*args, ["hhinc", "white"], "T20").collect()}
    counts = {r.GEOID20: r for r in interpolate_counts(*args, ["popul"], "T10").collect()}
    as_expected({k: (counts[k].popul, means[k].hhinc, means[k].white) for k in means})


def test_attach_keeps_both_sides(crosswalk, attributes):
    attached = attach_attributes(crosswalk, attributes, "GEOID10", "GEOID")
    plain = full_join(crosswalk, attributes, [("GEOID10", "GEOID")])
    assert rows_of(attached) == rows_of(plain)
    assert attached.count() == 10


def test_identity_crosswalk_changes_nothing(frame, attributes):
    known = attributes.where("hhinc IS NOT NULL")
    identity = known.selectExpr("GEOID AS a", "GEOID AS b", "100D AS T10", "100D AS T20")
    result = areal_interpolate(identity, "a", "b", [one_set(known)])
    assert rows_of(result.select("b", "popul", "hhinc", "white")) == rows_of(
        known.select("GEOID", "popul", "hhinc", "white")
    )


def test_result_does_not_depend_on_partitioning(crosswalk, attributes):
    def run(n):
        result = areal_interpolate(
            crosswalk.repartition(n), "GEOID10", "GEOID20", [one_set(attributes.repartition(n))]
        )
        return rows_of(result.select("GEOID20", *[F.round(c, 6) for c in ("popul", "hhinc", "white")]))

    assert run(1) == run(7)


def test_build_crosswalk(frame):
    overlaps = frame(
        "s string, t string, q double",
        ("a", "x", 10.0), ("a", "x", 20.0), ("a", "y", 70.0), ("b", "y", 30.0), ("c", "z", 0.0),
        (None, "z", 5.0),
    )
    result = build_crosswalk(overlaps, "s", "t", {"q": ("of_s", "of_t")})
    assert rows_of(result) == [
        ("a", "x", 30.0, 100.0),
        ("a", "y", 70.0, 70.0),
        ("b", "y", 100.0, 30.0),
        ("c", "z", None, 0.0),
        (None, "z", 100.0, 100.0),
    ]
    source_only = build_crosswalk(overlaps, "s", "t", {"q": ("of_s", None)})
    assert rows_of(source_only) == rows_of(result.drop("of_t"))


def test_allocation_conserves_totals(spark):
    rows = spark.range(5000).selectExpr("id % 300 AS s", "id % 71 AS t", "1.0D + id % 13 AS q")
    shares = build_crosswalk(rows, "s", "t", {"q": ("of_s", "of_t")})
    units = spark.range(300).selectExpr("id AS s", "CAST((id * 37) % 101 AS DOUBLE) AS n", "4.0D AS flat")
    result = areal_interpolate(
        shares, "s", "t", [SourceSet(units, "s", "", ["flat"], "of_t", ["n"], "of_s")]
    )
    assert result.agg(F.sum("n")).first()[0] == pytest.approx(units.agg(F.sum("n")).first()[0])
    assert result.where("abs(flat - 4) > 1e-9").count() == 0


# joins


def test_null_keys_match_each_other(frame):
    left = frame("k string, a int", (None, 1), ("x", 2))
    right = frame("j string, b int", (None, 3), ("y", 4))
    assert rows_of(full_join(left, right, [("k", "j")]), "k") == [
        ("x", 2, None), ("y", None, 4), (None, 1, 3),
    ]
    assert full_join(left, right, [("k", "j")], null_safe=False).count() == 4
    assert rows_of(left_join(left, right, [("k", "j")]), "k") == [("x", 2, None), (None, 1, 3)]


def test_self_join_by_key(frame):
    df = frame("k string, a int", ("x", 1), ("y", 2))
    summed = df.groupBy("k").agg(F.sum("a").alias("s"))
    assert rows_of(left_join(df, summed, ["k"])) == [("x", 1, 1), ("y", 2, 2)]


def test_collisions(frame):
    left = frame("k string, n int, own int", ("x", 1, 5))
    right = frame("k string, n int", ("x", 2))
    with pytest.raises(ValueError, match="suffix_collisions"):
        left_join(left, right, ["k"])
    joined = left_join(*suffix_collisions(left, right, ["k"], ("10", "18")), ["k"])
    assert joined.columns == ["k", "n10", "own", "n18"]
    cased = right.select("k", F.col("n").alias("OWN"))
    with pytest.raises(ValueError):
        left_join(left, cased, ["k"])


def test_membership_ignores_missing(frame):
    rows = frame("g string, i int", ("a", 1), (None, 2), ("b", 3))
    members = frame("m string", ("a",), ("a",), (None,))
    assert rows_of(restrict_to(rows, "g", members, "m")) == [("a", 1)]
    assert keyed_join(rows, members, [("g", "m")], "left_anti").count() == 1


# rates


def test_align_vintages(frame):
    current = frame(
        "id string, name string, CRRALL string",
        ("a", "A", "64.1"), ("b", "B", "x"), ("c", "C", "50.0"), ("d", "D", "40.0"),
    )
    prior = frame(
        "id string, name string, FSRR2010 double",
        ("a", "A", 66.0), ("b", "B", 70.0), ("c", "C2", 52.0),
    )
    args = (current, prior, ["id", "name"], "CRRALL", "FSRR2010")
    (row,) = align_vintages(*args).collect()
    assert (row.id, row.CRRALL, row.FSRR2010) == ("a", 64.1, 66.0)
    assert row.dif == pytest.approx(-1.9)
    report = missing_report(join_vintages(*args), ["CRRALL", "FSRR2010"]).first()
    assert tuple(report) == (5, 2, 2, 4, 0)


# peers


def test_top_k_and_codes(frame):
    sizes = frame("n string, p double", ("b", 5.0), ("a", 5.0), ("c", 9.0), ("d", None))
    assert [r.n for r in top_k(sizes, "p", 2, "n").collect()] == ["c", "a"]
    assert [r.n for r in top_k(sizes, "p", 9, "n").collect()] == ["c", "a", "b", "d"]
    codes = frame("c string", ("03",), ("01",), ("03",), ("02",), (None,))
    assert [r.c for r in first_codes(codes, "c", 2).collect()] == ["01", "02"]


def test_overlapping_groups(frame):
    units = frame("u string, k string", ("t1", "A"), ("t2", "B"), ("t3", None))
    lookup = frame("key string, g string", ("A", "Metro"), ("A", "Focus"))
    grouped = assign_groups(units, lookup, "k", "key")
    assert rows_of(grouped) == [
        ("t1", "A", "Focus"), ("t1", "A", "Metro"), ("t2", "B", None), ("t3", None, None),
    ]
    assert rows_of(focus(grouped, "g", "Focus")) == [("t1", "A", "Focus")]


def test_partition_union(frame):
    a, b = frame("x int, y int", (1, 2)), frame("y int, z int", (3, 4))
    assert rows_of(partition_union([a, b]), "y") == [(1, 2, None), (None, 3, 4)]


# comparison

UNITS = [
    ("t1", "hispa", "Metro A", 60.0, 100.0),
    ("t1", "hispa", "Focus", 60.0, 100.0),
    ("t2", "white", "Metro A", 80.0, 300.0),
    ("t3", "white", "Metro B", 70.0, 100.0),
    ("t4", "none", "Metro B", 50.0, 0.0),
]
CELLS = {
    ("hispa", "Metro A"): (60.0, 1),
    ("hispa", "Focus"): (60.0, 1),
    ("white", "Metro A"): (80.0, 1),
    ("white", "Metro B"): (70.0, 1),
    ("none", "Metro B"): (None, 1),
    ("all", "Metro A"): (75.0, 2),
    ("all", "Focus"): (60.0, 1),
    ("all", "Metro B"): (70.0, 2),
    ("hispa", "all"): (60.0, 2),
    ("white", "all"): (77.5, 2),
    ("none", "all"): (None, 1),
    ("all", "all"): (pytest.approx(43000 / 600), 5),
}


@pytest.fixture
def units(frame):
    base = frame("unit string, c10 string, grp string, r10 double, w10 double", *UNITS)
    return base.selectExpr("*", "c10 AS c18", "r10 - 10 AS r18", "w10 AS w18")


PRIOR, CURRENT = Period("c10", "r10", "w10"), Period("c18", "r18", "w18")


def test_comparison_cells(units):
    got = compare_periods(units, "grp", PRIOR, CURRENT).collect()
    assert {(r["class"], r.group): (r.prior, r.n_prior) for r in got} == CELLS
    assert {(r["class"], r.group): r.n_current for r in got} == {k: n for k, (_, n) in CELLS.items()}
    assert all(r.difference is None or r.difference == pytest.approx(-10) for r in got)


def test_comparison_counts_units_once_on_request(units):
    got = compare_periods(units, "grp", PRIOR, CURRENT, dedupe_total=True, unit=["unit"]).collect()
    cells = {(r["class"], r.group): (r.prior, r.n_prior) for r in got}
    assert cells == CELLS | {("all", "all"): (74.0, 4), ("hispa", "all"): (60.0, 1)}
    with pytest.raises(ValueError):
        compare_periods(units, "grp", PRIOR, CURRENT, dedupe_total=True)


def test_units_change_class_between_periods(frame):
    units = frame(
        "unit string, c10 string, c18 string, grp string, r10 double, r18 double, w10 double, w18 double",
        ("a", "white", "none", "G", 70.0, 60.0, 1.0, 1.0),
        ("b", "white", "white", "G", 50.0, 40.0, 1.0, 3.0),
        ("c", "black", "black", "G", None, 10.0, 1.0, 1.0),
    )
    got = {
        r["class"]: (r.prior, r.current, r.n_prior, r.n_current)
        for r in compare_periods(units, "grp", PRIOR, CURRENT).where("group = 'G'").collect()
    }
    # "none" and "black" are only known in the current period: left out.
    assert got == {
        "white": (60.0, 40.0, 2, 1),
        "all": (60.0, pytest.approx((60 + 120 + 10) / 5), 2, 3),
    }


def test_class_missing_in_current_period_keeps_row(frame):
    units = frame(
        "unit string, c10 string, c18 string, grp string, r10 double, r18 double, w10 double, w18 double",
        ("a", "white", "none", "G", 70.0, 60.0, 1.0, 1.0),
    )
    row = class_view(compare_periods(units, "grp", PRIOR, CURRENT), "white").where("group = 'G'").first()
    assert (row.prior, row.current, row.difference, row.n_prior, row.n_current) == (
        70.0, None, None, 1, None,
    )


def test_rates_that_are_not_numbers_are_left_out(frame):
    units = frame(
        "unit string, c10 string, c18 string, grp string, r10 double, r18 double, w10 double, w18 double",
        ("a", "white", "white", "G", float("nan"), 5.0, 1.0, float("nan")),
        ("b", "white", "white", "G", 5.0, 7.0, 1.0, 1.0),
    )
    got = compare_periods(units, "grp", PRIOR, CURRENT).collect()
    assert {(r.prior, r.current, r.n_prior, r.n_current) for r in got} == {(5.0, 7.0, 1, 1)}


@pytest.mark.parametrize("dedupe", [False, True])
def test_a_value_named_like_the_total_is_refused(frame, dedupe):
    schema = "unit string, c10 string, c18 string, grp string, r10 double, r18 double, w10 double, w18 double"
    for cells in (("all", "all", "G"), ("white", "white", "all")):
        units = frame(schema, ("a", *cells, 1.0, 1.0, 1.0, 1.0))
        with pytest.raises(Exception, match="named like the total"):
            compare_periods(units, "grp", PRIOR, CURRENT, dedupe_total=dedupe, unit=["unit"]).collect()


def test_total_is_not_the_null_group(frame):
    df = frame("c string, g string, x double", ("a", None, 1.0), ("a", "G", 2.0))
    cube = totals_cube(df, ["c", "g"], {"n": F.count(F.lit(1)), "s": F.sum("x")})
    assert rows_of(cube, "c", "g") == [
        ("a", "G", 1, 2.0), ("a", "all", 2, 3.0), ("a", None, 1, 1.0),
        ("all", "G", 1, 2.0), ("all", "all", 2, 3.0), ("all", None, 1, 1.0),
    ]


# reports

COMPARISON = "class string, `group` string, prior double, current double, difference double, n_prior long, n_current long"


def comparison_rows(frame, *cells):
    rows = [(c, g, p, None if d is None else p + d, d, 3, 4) for c, g, p, d in cells]
    return frame(COMPARISON, *rows)


def test_pivoted_report(frame):
    table = comparison_rows(
        frame,
        ("all", "M1", 60.0, -2.0), ("hispa", "M1", 60.0, -5.0), ("all", "M2", 60.0, 1.0),
        ("all", "M3", 60.0, None), ("hispa", "M3", 60.0, -1.0), ("all", "all", 60.0, 3.0),
        ("white", "M1", 60.0, 9.0), ("all", "Focus", 60.0, 2.0),
    )
    headings = {"all": "Overall Change", "hispa": "Hispanic Tract Change"}
    report = pivoted_report(table, headings, "MSA", excluded_groups=["all", "Focus"])
    assert report.columns == ["MSA", "Overall Change", "Hispanic Tract Change"]
    ordered = report.orderBy(*pivot_order(headings, "MSA")).collect()
    assert [tuple(r) for r in ordered] == [
        ("M1", -0.02, -0.05), ("M2", 0.01, None), ("M3", None, -0.01),
    ]
    wide = pivoted_report(table, headings | {"white": "White Tract Change"}, "MSA")
    assert wide.columns[-1] == "White Tract Change"


def test_pivot_refuses_repeated_cells(frame):
    table = comparison_rows(frame, ("all", "M1", 60.0, 1.0), ("all", "M1", 60.0, 2.0))
    with pytest.raises(Exception, match="occurs twice"):
        pivoted_report(table, {"all": "Overall"}).collect()


def test_ranked_report(frame):
    table = comparison_rows(
        frame,
        ("white", "F", 76.0, -1.0), ("none", "F", 66.0, -1.0), ("asian", "F", 63.0, -2.0),
        ("all", "F", 70.0, -1.0), ("white", "G", 99.0, 0.0),
    )
    report = ranked_report(table, "F", CLASS_LABELS, RANKED_HEADINGS)
    assert report.columns == ["row_id", *RANKED_HEADINGS]
    assert [tuple(r) for r in report.orderBy("row_id").collect()] == [
        (1, "White", 0.76, 0.75, 3, 4),
        (2, "No Majority", 0.66, 0.65, 3, 4),
        (3, "Asian", 0.63, 0.61, 3, 4),
    ]
    plain = ranked_report(table, "F", CLASS_LABELS, RANKED_HEADINGS, index=None)
    assert [r[0] for r in plain.collect()] == ["White", "No Majority", "Asian"]


def test_ranked_report_keeps_classes_without_a_label(frame):
    table = comparison_rows(
        frame, ("white", "F", 76.0, -1.0), ("mixed", "F", 80.0, -1.0), ("all", "F", 70.0, -1.0)
    )
    report = ranked_report(table, "F", {"white": "White"}, RANKED_HEADINGS)
    assert [tuple(r)[:3] for r in report.orderBy("row_id").collect()] == [
        (1, None, 0.8), (2, "White", 0.76),
    ]


def test_chart_frame(frame):
    table = comparison_rows(
        frame,
        ("all", "M1", 60.0, -2.0), ("hispa", "M1", 60.0, None), ("white", "M1", 60.0, 1.0),
        ("all", "all", 60.0, 3.0), ("hispa", "Focus", 60.0, 4.0),
    )
    chart = chart_frame(table, {"all": "Overall", "hispa": "Hispanic"})
    assert rows_of(chart.select("group", "legend", "difference")) == [
        ("Focus", "Hispanic", 4.0), ("M1", "Overall", -2.0),
    ]


# demographics


def test_widen_and_clean(frame):
    facts = frame(
        "GEOID string, NAME string, variable string, estimate double, moe double",
        ("17031490200", "T", "B01001_001", 3000.0, 5.0),
        ("17031490200", "T", "DP05_0066P", 20.0, 1.0),
        ("17031490200", "T", "DP05_0072P", 61.3, 1.0),
        ("17031490200", "T", "DP05_0073P", 10.0, 1.0),
        ("17031490200", "T", "DP05_0075P", 5.0, 1.0),
        ("17031490200", "T", "UNUSED", 1.0, 1.0),
    )
    wide = widen_variables(facts, list(DEMOGRAPHICS_2010.variables))
    assert "B01001_001E" in wide.columns and "B01001_001M" in wide.columns
    assert "UNUSEDE" not in wide.columns
    row = clean_demographics(wide, DEMOGRAPHICS_2010).first()
    assert (row.GEOID, row.state, row.county, row.tract) == (
        "17031490200", "17", "031", "490200",
    )
    assert (row.popul, row.hhinc, row.other, row.nonwh) == (3000.0, None, 3.7, 38.7)
    assert "state" not in clean_demographics(wide, DEMOGRAPHICS_2010, split=False).columns
    repeated = facts.unionByName(facts.limit(1))
    with pytest.raises(Exception, match="occurs twice for one unit"):
        widen_variables(repeated, list(DEMOGRAPHICS_2010.variables)).collect()


# regional


def test_regional(frame):
    weights = frame("code string, name string, w double", ("a", "A", 1.0), ("b", "B", 3.0))
    rates = frame("code string, name string, rate string", ("b", "B", "60"), ("a", "A", "80"))
    tracts = frame("code string, h double, r double", ("b", 1.0, 50.0), ("a", 2.0, 90.0), ("b", 1.0, 60.0))
    alternative = sums_by(tracts, "code", {"alt": "h"})
    joined = regional_frame(weights, rates, ["code", "name"], ["rate"], [alternative], "code")
    means = regional_rollup(joined, {"own": ("rate", "w"), "alt": ("rate", "alt")}).first()
    assert (means.own, means.alt) == (65.0, 70.0)
    gaps = discrepancy(tracts, "code", "r", "h", joined, ["rate", "name"], "mean")
    assert rows_of(gaps) == [("a", 90.0, 80.0, "A"), ("b", 55.0, 60.0, "B")]


# checks


def test_conservation(frame):
    before = frame("x double, w double", (100.0, 1.0), (300.0, 1.0))
    after = frame("y double, v double", (200.0, 2.0), (199.99, 0.0), (None, 1.0))
    figures = [Conserved("total", "x", "y"), Conserved("mean", "x", "y", "w", "v")]
    got = {r.figure: r for r in conservation_check(before, after, figures).collect()}
    assert got["total"].before == 400.0 and got["total"].after == pytest.approx(399.99)
    assert got["total"].passed and got["mean"].passed
    assert got["mean"].after == 200.0
    strict = conservation_check(before, after, figures[:1], tolerance=1e-6).first()
    assert not strict.passed and strict.relative_error == pytest.approx(2.5e-5)


def test_cases(crosswalk, attributes):
    both = one_set(attributes)
    result = areal_interpolate(crosswalk, "GEOID10", "GEOID20", [both])

    def closed(targets, sources):
        args = ("GEOID20", targets, "popul", attributes, "GEOID", sources, "popul")
        return closed_case_check("c", result, *args).first()

    assert closed(["17031490200"], ["17031490400", "17031490300"]).passed
    split = closed(["17031806005", "17031806006"], ["17031806003"])
    assert split.passed and split.interpolated == 5000.0
    # A shortfall fails too, not only an excess.
    assert closed(["17031806005"], ["17031806003"]).passed is False

    checked = target_check(result, crosswalk, "GEOID10", "GEOID20", both)
    verdicts = {(r.unit, r.measure): r for r in checked.collect()}
    assert verdicts[("17031490200", "hhinc")].passed
    assert verdicts[("17031490200", "hhinc")].case == "averaged"
    assert verdicts[("17197880903", "popul")].passed
    assert verdicts[("17197880903", "popul")].case == "allocated"
    # A missing income leaves nothing to compare the mean with.
    assert verdicts[("17197880903", "hhinc")].passed is None
    only = target_check(result, crosswalk, "GEOID10", "GEOID20", both, targets=["17031490200"])
    assert only.count() == 3

    inherited = inherited_check(result, crosswalk, "GEOID10", "GEOID20", both)
    units = {(r.unit, r.measure): r.passed for r in inherited.collect()}
    assert units[("17031806005", "white")] and units[("17031806006", "hhinc")]
    assert ("17031490200", "white") not in units

    handed_out = {r.unit: r.passed for r in source_check(crosswalk, "GEOID10", both).collect()}
    assert handed_out["17031806003"] and handed_out["17197980100"] is False
    summary = summarize_checks(source_check(crosswalk, "GEOID10", both)).first()
    assert (summary.units, summary.passed, summary.failed, summary.unknown) == (8, 3, 4, 1)


def test_frame_equality(frame):
    a = frame("k string, x double, s string", ("a", 1.0, "p"), ("b", None, None))
    same = frame("k string, x double, s string", ("b", None, None), ("a", 1.0, "p"))
    assert frame_equality(a, same, ["k"], ["x", "s"]).first().equal
    off = frame("k string, x double, s string", ("a", 1.0 + 1e-9, "p"), ("b", None, None))
    row = frame_equality(a, off, ["k"], ["x", "s"]).first()
    assert (row.n_rows, row.match_x, row.match_s, row.min_matches, row.equal) == (2, 1, 2, 1, False)
    assert frame_equality(a, off, ["k"], ["x", "s"], tolerance=1e-6).first().equal
    extra = frame("k string, x double, s string", ("a", 1.0, "p"), ("b", None, None), ("c", None, None))
    row = frame_equality(a, extra, ["k"], ["x", "s"]).first()
    assert (row.n_rows, row.min_matches, row.equal) == (3, 2, False)


def test_frames_of_different_row_counts_differ(frame):
    twice = frame("k string, x double", ("k", 1.0), ("k", 1.0))
    once = frame("k string, x double", ("k", 1.0))
    for left, right in ((twice, once), (once, twice)):
        row = frame_equality(left, right, ["k"], ["x"]).first()
        assert (row.n_rows, row.match_x, row.equal) == (2, 1, False)
    row = frame_equality(twice, twice, ["k"], ["x"]).first()
    assert (row.n_rows, row.equal) == (2, True)
    assert frame_equality(once.limit(0), once.limit(0), ["k"], ["x"]).first().n_rows == 0


def test_a_closed_case_without_units_has_no_verdict(frame):
    got = frame("t string, n double", ("a", 1.0))
    own = frame("s string, n double", ("x", 1.0))
    row = closed_case_check("c", got, "t", ["typo"], "n", own, "s", ["x"], "n").first()
    assert (row.targets_found, row.sources_found, row.interpolated, row.passed) == (0, 1, None, None)
    assert closed_case_check("c", got, "t", ["a"], "n", own, "s", ["x"], "n").first().passed


def brute_comparison(rows, dedupe):
    """The comparison from its definition, row by row."""

    def cells(rate, weight, label):
        kept = [r for r in rows if r[rate] is not None and r[weight] is not None]
        groups = {}
        for r in kept:
            for c in (r[label], "all"):
                groups.setdefault((c, r["grp"]), []).append(r)
        seen = set()
        for r in kept:
            if dedupe and r["unit"] in seen:
                continue
            seen.add(r["unit"])
            for c in (r[label], "all"):
                groups.setdefault((c, "all"), []).append(r)
        out = {}
        for key, members in groups.items():
            total = sum(m[weight] for m in members)
            mean = sum(m[rate] * m[weight] for m in members) / total if total else None
            out[key] = (mean, len(members))
        return out

    prior, current = cells("r10", "w10", "c10"), cells("r18", "w18", "c18")
    return {
        key: (mean, *current.get(key, (None, None)), n) for key, (mean, n) in prior.items()
    }


@pytest.mark.parametrize("dedupe", [False, True])
def test_comparison_against_brute_force(spark, dedupe):
    rng = random.Random(11)
    rows = []
    for unit in range(400):
        measures = {
            "unit": f"u{unit}",
            "c10": rng.choice(["a", "b", "c"]),
            "c18": rng.choice(["a", "b", "d"]),
            "r10": rng.choice([None, 40.0, 55.5, 80.0]),
            "r18": rng.choice([None, 45.0, 60.0]),
            "w10": rng.choice([None, 0.0, 1.0, 250.0]),
            "w18": rng.choice([0.0, 3.0, 90.0]),
        }
        for group in rng.sample(["G1", "G2", "G3", None], rng.randint(1, 3)):
            rows.append({**measures, "grp": group})
    schema = "unit string, c10 string, c18 string, r10 double, r18 double, w10 double, w18 double, grp string"
    units = spark.createDataFrame(rows, schema).repartition(5)
    got = compare_periods(units, "grp", PRIOR, CURRENT, dedupe_total=dedupe, unit=["unit"])
    cells = {(r["class"], r.group): r for r in got.collect()}
    want = brute_comparison(rows, dedupe)
    assert set(cells) == set(want)
    for key, (prior, current, n_current, n_prior) in want.items():
        row = cells[key]
        assert row.n_prior == n_prior and row.n_current == n_current, key
        for value, expected in ((row.prior, prior), (row.current, current)):
            assert value == (None if expected is None else pytest.approx(expected)), key
