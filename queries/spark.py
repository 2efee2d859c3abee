"""One query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from areashift.functions import (
    complement_share,
    has_level,
    key_prefix,
    normalize_code,
    residual_share,
    split_code,
    strict_sum,
    strip_parenthetical,
    strip_prefix,
    to_number,
    total,
    weighted_mean,
)
from areashift.operators.cases import case_verdicts, overlap_cases
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
from areashift.operators.compare import class_view, compare_periods, totals_cube
from areashift.operators.demographics import clean_demographics, widen_variables
from areashift.operators.frames import frame_differences, frame_equality
from areashift.operators.interpolate import (
    SourceSet,
    areal_interpolate,
    attach_attributes,
    interpolate_counts,
    interpolate_means,
)
from areashift.operators.joins import left_join, named, restrict_to, suffix_collisions
from areashift.operators.peers import first_codes, focus, partition_union
from areashift.operators.rates import align_vintages, join_vintages
from areashift.operators.regional import discrepancy, regional_rollup
from areashift.operators.reports import chart_frame, pivoted_report, ranked_report
from areashift.schemas import Demographics
from areashift.session import configure, scratch_folder
from areashift.sources.crosswalks import land_crosswalk
from areashift.sources.readers import pull_demographics, read_delimited
from areashift.sources.writers import land_facts, materialize, with_row_index, write_export
from queries import landed, star
from queries.star import table

PIVOT = {"all": "Overall Change", "R": "Returned Change", "N": "New Change", "none": "Other Change"}
RANKED = ["Majority Flag", "1996 Rate", "2000 Rate", "Suppliers in 1996", "Suppliers in 2000"]
RANK_LABELS = {"R": "Returned", "A": "Accepted", "none": "No Majority"}
LEGENDS = {"all": "Overall Difference", "R": "Difference in Majority-Returned Suppliers"}
SCOPE_CODES = ["02", "06", "11", "17", "21"]


#: Rows of which a task finds the distinct ones, about.
TASK_ROWS = 1 << 19


def rounded(rows: DataFrame, digits: int = 6, money: int = 2) -> DataFrame:
    """Doubles rounded at the very end, where the order of summing would show.

    Amounts of money are large, so the last digits that sums agree in come earlier.
    """
    places = {c: money if c.startswith(("price", "spend")) else digits for c in rows.columns}
    return rows.select(
        *[
            F.round(named(c), places[c]).alias(c) if kind == "double" else named(c)
            for c, kind in rows.dtypes
        ]
    )


def keyed(rows: DataFrame, money: int = 2) -> DataFrame:
    """Suppliers as text, as the unallocated row has none: clients read a gap in whole
    numbers in different ways."""
    return rounded(rows.withColumn("supplier", F.col("supplier").cast("string")), money=money)


def shown(comparison: DataFrame) -> DataFrame:
    """A comparison with the count that may be missing as a double, for the same reason."""
    return rounded(comparison.withColumn("n_current", F.col("n_current").cast("double")))


def flag_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long facts: per supplier and return flag a quantity, and a discount as its margin."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(
        F.sum("l_quantity").alias("estimate"), F.sum("l_discount").alias("moe")
    )
    joined = left_join(sums, star.supplier_units(spark, sf_dir), [("l_suppkey", "supplier")])
    return joined.select(
        F.col("unit").alias("GEOID"),
        F.col("name").alias("NAME"),
        F.col("l_returnflag").alias("variable"),
        "estimate",
        "moe",
    )


def q_widen_variables(spark, sf_dir):
    return rounded(widen_variables(flag_facts(spark, sf_dir), ["A", "N", "R"]))


def q_clean_demographics(spark, sf_dir):
    wide = widen_variables(flag_facts(spark, sf_dir), ["A", "N", "R"])
    whole = F.col("AE") + F.col("NE") + F.col("RE")
    percents = wide.withColumns(
        {f"{f}E": F.round(F.try_divide(100 * F.col(f"{f}E"), whole), 3) for f in "ANR"}
    )
    vintage = Demographics({"A": "white", "N": "black", "R": "hispa"}, whole=("hispa", "black"))
    return rounded(clean_demographics(percents, vintage))


def q_normalize_codes(spark, sf_dir):
    """Codes as they come: whole numbers, blanks, none at all, and some too long."""
    customers = table(spark, sf_dir, "customer")
    raw = (
        F.when(F.col("c_nationkey") == 0, F.lit("  "))
        .when(F.col("c_nationkey") == 1, F.lit(None))
        .when(F.col("c_nationkey") == 2, F.concat(F.lit(" "), F.col("c_custkey").cast("string")))
        .otherwise(F.col("c_custkey").cast("string"))
    )
    return customers.select(
        "c_custkey",
        normalize_code(raw, 11).alias("code"),
        normalize_code(raw, 2, on_long="null").alias("short_code"),
    )


def q_split_code(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    coded = customers.select(
        F.concat(normalize_code("c_nationkey", 2), normalize_code("c_custkey", 9)).alias("code")
    )
    pieces = split_code("code", (2, 5), ("state", "county", "tract"))
    return coded.select("code", *pieces, key_prefix("code", 5).alias("first_five"))


def q_strip_labels(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    full_id = F.concat(F.lit("1400000US"), normalize_code("p_partkey", 11))
    label = F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))
    return parts.select(
        strip_prefix(full_id, "1400000US").alias("code"),
        strip_parenthetical(label).alias("label"),
    )


def q_cast_numbers(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return parts.select(
        "p_partkey",
        to_number(F.col("p_size").cast("string")).alias("size"),
        to_number("p_name").alias("not_a_number"),
        to_number(F.concat(F.lit(" "), F.col("p_retailprice").cast("string"))).alias("price"),
        to_number(F.concat(F.col("p_size").cast("string"), F.lit("d"))).alias("suffixed"),
    )


def q_scope_filter(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("0400000US"), normalize_code("n_nationkey", 2)).alias("full_id"),
        F.col("n_name").alias("name"),
    )
    customers = table(spark, sf_dir, "customer").select(
        F.concat(
            F.lit("0500000US"), normalize_code("c_nationkey", 2), normalize_code("c_custkey", 9)
        ).alias("full_id"),
        F.col("c_name").alias("name"),
    )
    mixed = nations.unionByName(customers).where(has_level("full_id", "0500000US"))
    pieces = split_code("full_id", (9, 11), ("prefix", "state", "rest"))
    return mixed.select("name", *pieces).where(F.col("state").isin(SCOPE_CODES))


def q_residual_share(spark, sf_dir):
    shares = star.flag_shares(spark, sf_dir, "l_suppkey", star.PRIOR_YEAR)
    return shares.select(
        "l_suppkey",
        residual_share(["A", "N"]).alias("other"),
        complement_share("A").alias("not_a"),
    )


def q_weighted_means(spark, sf_dir):
    # The weight is unknown for pending orders, the price for unspecified priorities.
    known = F.col("o_orderpriority") != "4-NOT SPECIFIED"
    orders = table(spark, sf_dir, "orders").select(
        "o_orderpriority",
        "o_orderstatus",
        F.when(known, F.col("o_totalprice")).alias("x"),
        F.when(F.col("o_orderstatus") != "P", F.length("o_orderpriority") - 5.0).alias("w"),
    )
    return rounded(
        orders.groupBy("o_orderpriority", "o_orderstatus").agg(
            weighted_mean("x", "w", na_rm=True).alias("mean_lenient"),
            weighted_mean("x", "w", na_rm=False).alias("mean_strict"),
            F.count(F.lit(1)).alias("n"),
        ),
        4,
    )


def q_strict_sums(spark, sf_dir):
    orders = star.order_attributes(spark, sf_dir)
    priced = orders.withColumn("is_finished", F.col("finished") > 0)
    return rounded(
        priced.groupBy("is_finished", "urgent").agg(
            strict_sum("price").alias("sum_strict"),
            total("price").alias("sum_lenient"),
            strict_sum("spend").alias("spend"),
        ),
        2,
    )


def q_build_crosswalk(spark, sf_dir):
    return rounded(star.crosswalk(spark, sf_dir))


def q_attach_attributes(spark, sf_dir):
    attached = attach_attributes(
        star.crosswalk(spark, sf_dir), star.order_attributes(spark, sf_dir), "order", "order"
    )
    return keyed(attached, money=6)


def q_interpolate_means(spark, sf_dir):
    return keyed(
        interpolate_means(
            star.crosswalk(spark, sf_dir, of_source=False),
            star.order_attributes(spark, sf_dir),
            "order",
            "order",
            "supplier",
            ["price", "urgent"],
            "all_t",
        )
    )


def q_interpolate_counts(spark, sf_dir):
    return keyed(
        interpolate_counts(
            star.crosswalk(spark, sf_dir, of_target=False),
            star.order_attributes(spark, sf_dir),
            "order",
            "order",
            "supplier",
            ["orders", "spend"],
            "all_s",
        )
    )


def q_areal_interpolate(spark, sf_dir):
    return keyed(star.interpolated(spark, sf_dir))


def q_interpolate_exact(spark, sf_dir):
    """Orders to suppliers with sums that do not depend on how lines are dealt."""
    crosswalk = star.crosswalk(spark, sf_dir)
    return keyed(areal_interpolate(crosswalk, "order", "supplier", star.order_sets(spark, sf_dir), exact=True))


def q_interpolate_landed(spark, sf_dir):
    """Orders to suppliers and suppliers to orders over one landed crosswalk."""
    landed = land_crosswalk(star.crosswalk(spark, sf_dir), scratch_folder(spark, "landed"), "order", "supplier")
    to_suppliers = areal_interpolate(landed, "order", "supplier", star.order_sets(spark, sf_dir))
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("supplier"), (F.col("s_acctbal") / 7).alias("daily"), (F.lit(1.0) / 7).alias("day")
    )
    one = SourceSet(suppliers, "supplier", "", ["daily"], "all_s", ["day"], "all_t")
    to_orders = areal_interpolate(landed, "supplier", "order", [one], unallocated=False)
    to_orders = to_orders.withColumn("order", F.col("order").cast("string"))
    return partition_union([keyed(to_suppliers), rounded(to_orders, 9)])


def q_align_vintages(spark, sf_dir):
    current, prior = star.part_vintages(spark, sf_dir)
    aligned = align_vintages(current, prior, ["full_id", "name"], "rate18", "rate10")
    return rounded(aligned.withColumn("code", strip_prefix("full_id", "1400000US")))


def q_missing_report(spark, sf_dir):
    current, prior = star.part_vintages(spark, sf_dir)
    joined = join_vintages(current, prior, ["full_id", "name"], "rate18", "rate10")
    return missing_report(joined, ["rate10", "rate18"])


def q_enrich_left(spark, sf_dir):
    current, prior = star.part_vintages(spark, sf_dir)
    aligned = align_vintages(current, prior, ["full_id", "name"], "rate18", "rate10")
    parts = table(spark, sf_dir, "part").select(
        F.concat(F.lit("1400000US"), normalize_code("p_partkey", 11)).alias("full_id"),
        F.col("p_name").alias("name"),
        "p_size",
        "p_retailprice",
    )
    return rounded(left_join(aligned, parts, ["full_id", "name"]))


def q_suffix_join(spark, sf_dir):
    prior = star.flag_shares(spark, sf_dir, "l_suppkey", star.PRIOR_YEAR)
    current = star.flag_shares(spark, sf_dir, "l_suppkey", star.CURRENT_YEAR)
    prior, current = suffix_collisions(prior, current, ["l_suppkey"], ("10", "18"))
    return rounded(left_join(prior, current, ["l_suppkey"]))


def q_majority_class(spark, sf_dir):
    units = star.classified(star.aligned_suppliers(spark, sf_dir))
    return units.select("supplier", "unit", "name", "class10", "class18")


def q_final_units(spark, sf_dir):
    return rounded(star.central(spark, sf_dir))


def q_top_groups(spark, sf_dir):
    return star.peer_groups(spark, sf_dir)


def q_assign_groups(spark, sf_dir):
    return star.in_groups(star.supplier_units(spark, sf_dir), spark, sf_dir)


def q_restrict_groups(spark, sf_dir):
    return star.peer_units(star.supplier_units(spark, sf_dir), spark, sf_dir)


def q_focus_group(spark, sf_dir):
    units = star.peer_units(star.supplier_units(spark, sf_dir), spark, sf_dir)
    return focus(units, "grp", star.FOCUS)


def q_totals_cube(spark, sf_dir):
    units = star.classified(star.aligned_suppliers(spark, sf_dir))
    grouped = star.peer_units(units, spark, sf_dir)
    measures = {"mean_rate": weighted_mean("rate10", "A10"), "n": F.count(F.lit(1))}
    return rounded(totals_cube(grouped, ["class10", "grp"], measures))


def q_compare_periods(spark, sf_dir):
    return shown(star.comparison(spark, sf_dir))


def q_compare_dedupe(spark, sf_dir):
    return shown(star.comparison(spark, sf_dir, dedupe_total=True))


def q_class_view(spark, sf_dir):
    return shown(class_view(star.comparison(spark, sf_dir), "none"))


def q_chart_frame(spark, sf_dir):
    return shown(chart_frame(star.comparison(spark, sf_dir), LEGENDS))


def q_pivoted_report(spark, sf_dir):
    report = pivoted_report(
        star.comparison(spark, sf_dir), PIVOT, "Nation", excluded_groups=["all", star.FOCUS]
    )
    return rounded(report)


def q_ranked_report(spark, sf_dir):
    report = ranked_report(star.comparison(spark, sf_dir), star.FOCUS, RANK_LABELS, RANKED)
    return rounded(report.withColumn(RANKED[-1], named(RANKED[-1]).cast("double")))


def q_partition_union(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"),
        normalize_code("c_nationkey", 2).alias("code"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"),
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_acctbal").alias("balance"),
        F.col("s_name").alias("name"),
        normalize_code("s_nationkey", 2).alias("code"),
    )
    return partition_union([customers, suppliers])


def q_first_codes(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    return first_codes(customers.select(normalize_code("c_nationkey", 2).alias("code")), "code", 12)


def q_regional_rollup(spark, sf_dir):
    return rounded(
        regional_rollup(
            star.nation_frame(spark, sf_dir),
            {
                "current": ("rate18", "w18"),
                "current_alt": ("rate18", "w18alt"),
                "snapshot": ("rate_snapshot", "w18"),
                "prior": ("rate10", "w10"),
                "prior_alt": ("rate10", "w10alt"),
            },
        )
    )


def q_discrepancy(spark, sf_dir):
    suppliers = star.supplier_year(spark, sf_dir, star.PRIOR_YEAR)
    nations = star.nation_rates(spark, sf_dir, star.PRIOR_YEAR, "rate10")
    return rounded(discrepancy(suppliers, "code", "rate", "balance", nations, ["rate10", "name"]))


def q_conservation_check(spark, sf_dir):
    """Orders without lines go missing on the way; those with lines do not."""
    figures = [
        Conserved("orders", "orders", "orders"),
        Conserved("with lines", "with_lines", "orders"),
        Conserved("spend", "spend", "spend"),
        Conserved("urgent", "urgent", "urgent", "orders", "orders"),
    ]
    attributes = star.order_attributes(spark, sf_dir)
    crosswalk = star.crosswalk(spark, sf_dir)
    one = SourceSet(attributes, "order", "", ["urgent"], "all_t", ["orders", "spend"], "all_s")
    after = areal_interpolate(crosswalk, "order", "supplier", [one], unallocated=False)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order")).distinct()
    marked = left_join(attributes, lines.withColumn("with_lines", F.lit(1.0)), ["order"])
    return rounded(conservation_check(marked, after, figures, tolerance=1e-4), 3)


def q_case_checks(spark, sf_dir):
    # Read by two interpolations and three checks: landed once, by both of its units.
    landed = land_crosswalk(star.crosswalk(spark, sf_dir), scratch_folder(spark, "landed"), "order", "supplier")
    by_order_pairs = landed.by_source.all_pairs()
    orders = star.order_attributes(spark, sf_dir).withColumn("amount", F.col("spend"))
    means, counts = ["price", "urgent", "amount"], ["orders", "spend"]
    to_suppliers = SourceSet(orders, "order", "", means, "all_t", counts, "all_s")
    by_supplier = areal_interpolate(landed, "order", "supplier", [to_suppliers])

    # The same overlaps the other way round: suppliers cut into orders.
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("supplier"), "s_acctbal"
    )
    to_orders = SourceSet(suppliers, "supplier", "", ["s_acctbal"], "all_s")
    by_order = areal_interpolate(landed, "supplier", "order", [to_orders])

    verdicts = partition_union(
        [
            target_check(by_supplier, landed, "order", "supplier", to_suppliers),
            source_check(by_order_pairs, "order", to_suppliers),
            inherited_check(by_order, by_order_pairs, "supplier", "order", to_orders),
        ]
    )
    return summarize_checks(verdicts)


def q_frame_equality(spark, sf_dir):
    regions = table(spark, sf_dir, "region").where(F.col("r_name") == star.FOCUS_REGION)
    nations = restrict_to(table(spark, sf_dir, "nation"), "n_regionkey", regions, "r_regionkey")
    scope = restrict_to(table(spark, sf_dir, "supplier"), "s_nationkey", nations, "n_nationkey")
    crosswalk = materialize(star.crosswalk(spark, sf_dir), scratch_folder(spark, "crosswalk"))
    sets = star.order_sets(spark, sf_dir)

    def pipeline(pairs: DataFrame) -> DataFrame:
        return areal_interpolate(pairs, "order", "supplier", sets, unallocated=False)

    first = pipeline(restrict_to(crosswalk, "supplier", scope, "s_suppkey"))
    last = restrict_to(pipeline(crosswalk), "supplier", scope, "s_suppkey")
    columns = ["price10", "urgent18", "finished", "orders10", "spend18"]
    return frame_equality(first, last, ["supplier"], columns, tolerance=1e-6)


def q_frame_multiplicity(spark, sf_dir):
    """Nations of the suppliers against those of the customers: as many rows of a key or not."""
    def sides(name: str, key: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.col(key).alias("nation"), F.lit(1.0).alias("one"))

    return frame_equality(
        sides("supplier", "s_nationkey"), sides("nation", "n_nationkey"), ["nation"], ["one"]
    )


def q_frame_differences(spark, sf_dir):
    """Nations of suppliers and of customers, with how many, where they differ."""
    def sides(name: str, key: str, balance: str) -> DataFrame:
        counts = table(spark, sf_dir, name).groupBy(F.col(key).alias("nation"))
        return counts.agg(
            F.count(F.lit(1)).alias("units"), F.max(balance).alias("most"), F.lit("x").alias("same")
        ).withColumn("some", F.when(F.col("nation") % 3 == 0, F.lit(0)).otherwise(F.col("units")))

    left, right = sides("supplier", "s_nationkey", "s_acctbal"), sides("customer", "c_nationkey", "c_acctbal")
    found = frame_differences(left, right, ["nation"], ["units", "most", "same", "some"], tolerance=0.01)
    return found.withColumn("columns", F.array_join("columns", ","))


def q_compare_unknown(spark, sf_dir):
    """A comparison in which some rates and weights are not numbers."""
    units = star.peer_units(star.central(spark, sf_dir, means=False), spark, sf_dir)
    nan = F.lit(float("nan"))
    units = units.withColumns(
        {
            "rate10": F.when(F.col("supplier") % 7 == 0, nan).otherwise(F.col("rate10")),
            "orders18": F.when(F.col("supplier") % 5 == 0, nan).otherwise(F.col("orders18")),
        }
    )
    return shown(compare_periods(units, "grp", star.PRIOR, star.CURRENT))


def q_closed_cases(spark, sf_dir):
    """Orders of all suppliers in whole, of those of a region in part, with unknown prices, and
    of none; the units are chosen by tables of keys."""
    crosswalk = materialize(star.crosswalk(spark, sf_dir), scratch_folder(spark, "crosswalk"))
    orders = star.order_attributes(spark, sf_dir)
    whole = SourceSet(orders, "order", "", counts=["orders", "spend", "price"], count_weight="all_s")
    got = areal_interpolate(crosswalk, "order", "supplier", [whole], unallocated=False)
    got = materialize(got, scratch_folder(spark, "interpolated"))
    every = table(spark, sf_dir, "supplier").select("s_suppkey")
    here = star.focus_suppliers(spark, sf_dir).select("supplier")
    theirs = restrict_to(crosswalk, "supplier", here, "supplier").select("order").distinct()
    cases = [
        ("closed", None, crosswalk.select("order").distinct(), "orders"),
        ("closed by list", every, crosswalk.select("order").distinct(), "orders"),
        ("one region", here, theirs, "spend"),
        ("unknown price", every, theirs, "price"),
        ("mistyped", [-1], theirs, "orders"),
    ]
    rows = [
        closed_case_check(name, got, "supplier", to, measure, orders, "order", of, measure)
        for name, to, of, measure in cases
    ]
    return rounded(partition_union(rows), 3, money=3)


def q_boundary_cases(spark, sf_dir):
    """Every case of orders and parts that returned lines link: totals kept, means in range."""
    crosswalk = materialize(star.returned_crosswalk(spark, sf_dir), scratch_folder(spark, "crosswalk"))
    orders = star.order_attributes(spark, sf_dir)
    one = SourceSet(orders, "order", "", ["urgent", "price"], "q_t", ["orders", "spend"], "q_s")
    got = areal_interpolate(crosswalk, "order", "part", [one], unallocated=False)
    verdicts = case_verdicts(crosswalk, "order", "part", one, got)
    return rounded(verdicts.withColumnsRenamed({"first_source": "first_order", "first_target": "first_part"}), 3)


def q_case_kinds(spark, sf_dir):
    """How many cases of each kind, with their units."""
    _, _, cases = overlap_cases(star.returned_crosswalk(spark, sf_dir), "order", "part", ["q_s", "q_t"])
    return cases.groupBy("kind").agg(
        F.count("*").alias("cases"), F.sum("sources").alias("orders"), F.sum("targets").alias("parts")
    )


def q_landed_facts(spark, sf_dir):
    """Facts of all years landed by year and nation, one year of them read back and widened."""
    lines = table(spark, sf_dir, "lineitem").groupBy(
        "l_suppkey", "l_returnflag", F.year("l_shipdate").alias("year")
    )
    sums = lines.agg(F.sum("l_quantity").alias("estimate"), F.sum("l_discount").alias("moe"))
    units = star.supplier_units(spark, sf_dir)
    facts = left_join(sums, units, [("l_suppkey", "supplier")]).select(
        F.lit("supplier").alias("geography"),
        F.lit("lines").alias("survey"),
        "year",
        key_prefix("unit", 2).alias("state"),
        F.substring("unit", 3, 3).alias("county"),
        F.col("unit").alias("GEOID"),
        F.col("name").alias("NAME"),
        F.col("l_returnflag").alias("variable"),
        "estimate",
        "moe",
    )
    folder = scratch_folder(spark, "facts")
    land_facts(facts, folder)
    flags = ["A", "N", "R"]
    return rounded(pull_demographics(spark, folder, 2000, "lines", flags, "supplier"))


def q_csv_round_trip(spark, sf_dir):
    """Orders written as CSV, missing prices as NA, and read back by header name."""
    folder = scratch_folder(spark, "orders")
    orders = star.order_attributes(spark, sf_dir)
    note = F.when(F.col("urgent") > 0, F.concat(F.lit('a "note",\nof order '), F.col("order").cast("string")))
    write_export(orders.select(F.col("order").cast("string"), note.alias("note"), "price", "spend"), folder)
    schema = StructType(
        [
            StructField("spend", DoubleType()),
            StructField("order", StringType()),
            StructField("note", StringType()),
            StructField("price", DoubleType()),
        ]
    )
    return read_delimited(spark, folder, schema, multiline=True)


def q_row_index(spark, sf_dir):
    """All customers numbered by balance."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return with_row_index(customers, [F.desc_nulls_last("c_acctbal"), F.asc("c_custkey")])


def q_tied_row_index(spark, sf_dir):
    """All lines numbered by their flag alone, of which there are three: where each begins and
    ends, and whether every number is given once."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    numbered = with_row_index(lines, [F.asc("l_returnflag")])
    # numbers and lines are each dealt by themselves, over more tasks for more lines: a task
    # that finds the distinct ones holds them all
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // TASK_ROWS))
    numbers = numbered.repartition(tasks, "row_id").groupBy("l_returnflag", "row_id").agg(F.count(F.lit(1)).alias("times"))
    found = numbers.groupBy("l_returnflag").agg(
        F.min("row_id").alias("first"), F.max("row_id").alias("last"), F.sum("times").alias("n"), F.count("row_id").alias("numbers")
    )
    key = ["l_orderkey", "l_linenumber"]
    once = numbered.repartition(tasks, *key).dropna(subset=key).groupBy("l_returnflag", *key).agg(F.lit(1).alias("one"))
    lines_of = once.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("lines"))
    return left_join(found, lines_of, ["l_returnflag"]).withColumn("lines", F.coalesce("lines", F.lit(0).cast("long")))


def configured(query: Callable[[SparkSession, str], DataFrame]):
    """The query under the adaptive settings its plan relies on."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(configure(spark), sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query of this module by name."""
    return {
        name.removeprefix("q_"): configured(function)
        for module in (globals(), vars(landed))
        for name, function in module.items()
        if name.startswith("q_")
    }
