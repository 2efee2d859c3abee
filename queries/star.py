"""Stand-ins on the star schema for the inputs of the analysis.

Source units are orders, target units suppliers, and an overlap is the quantity of an
order's lines that a supplier delivers. Some orders have no lines: sources outside the
crosswalk. The second pair of shares counts open lines only. A supplier's rate in a
year is the share of its quantity that came back, and its class the return flag that
holds most of its quantity. Groups are nations, and the focus group holds the
suppliers of one region beside their own nation.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from areashift.functions import key_prefix, majority_class, normalize_code, total
from areashift.operators.compare import Period, compare_periods
from areashift.operators.crosswalk import build_crosswalk
from areashift.operators.interpolate import SourceSet, areal_interpolate
from areashift.operators.joins import full_join, left_join, restrict_to
from areashift.operators.peers import assign_groups, top_k
from areashift.operators.regional import regional_frame, sums_by

PRIOR_YEAR, CURRENT_YEAR = 1996, 2000
THRESHOLD = 35.0
PEERS = 10
FOCUS_REGION, FOCUS = "ASIA", "FOCUS"
PRIOR = Period("class10", "rate10", "orders10")
CURRENT = Period("class18", "rate18", "orders18")
LABELS = {"R": "Returned", "A": "Accepted", "N": "New", "none": "No Majority"}


@cache
def schema_of(spark: SparkSession, path: str) -> StructType:
    """A table's schema, looked up in its files once per session."""
    return spark.read.parquet(path).schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return spark.read.schema(schema_of(spark, path)).parquet(path)


def crosswalk(
    spark: SparkSession, sf_dir: str, of_source: bool = True, of_target: bool = True
) -> DataFrame:
    """order, supplier and shares of all lines and open lines, of source and of target."""
    is_open = F.col("l_linestatus") == "O"
    overlaps = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order"),
        F.col("l_suppkey").alias("supplier"),
        F.col("l_quantity").alias("every"),
        F.when(is_open, F.col("l_quantity")).otherwise(0.0).alias("open"),
    )
    shares = {
        "every": ("all_s" if of_source else None, "all_t" if of_target else None),
        "open": ("open_s" if of_source else None, "open_t" if of_target else None),
    }
    return build_crosswalk(overlaps, "order", "supplier", shares)


def returned_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order, part and shares of the large returned lines of the prior year: few enough that
    orders and parts form many separate cases."""
    lines = lines_of(spark, sf_dir, PRIOR_YEAR).where("l_returnflag = 'R' AND l_quantity > 25")
    overlaps = lines.select(
        F.col("l_orderkey").alias("order"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("q")
    )
    return build_crosswalk(overlaps, "order", "part", {"q": ("q_s", "q_t")})


def order_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of the source units; the price is unknown where the priority is."""
    known = F.col("o_orderpriority") != "4-NOT SPECIFIED"
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order"),
        F.when(known, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 100.0).otherwise(0.0).alias("urgent"),
        F.when(F.col("o_orderstatus") == "F", 100.0).otherwise(0.0).alias("finished"),
        F.lit(1.0).alias("orders"),
        (F.col("o_totalprice") / 1000).alias("spend"),
    )


def order_sets(spark: SparkSession, sf_dir: str, means: bool = True) -> list[SourceSet]:
    """Two vintages of the attributes; only the later one has ``finished``."""
    prior = order_attributes(spark, sf_dir)
    current = prior.withColumns({"price": F.col("price") * 1.1, "spend": F.col("spend") * 1.1})
    prior_means = ["price", "urgent"] if means else []
    current_means = ["price", "urgent", "finished"] if means else []
    counts = ["orders", "spend"]
    return [
        SourceSet(prior, "order", "10", prior_means, "all_t", counts, "all_s"),
        SourceSet(current, "order", "18", current_means, "open_t", counts, "open_s"),
    ]


def interpolated(
    spark: SparkSession, sf_dir: str, means: bool = True, unallocated: bool = True
) -> DataFrame:
    """Attributes by supplier. Without means the shares of the target are not needed."""
    return areal_interpolate(
        crosswalk(spark, sf_dir, of_target=means),
        "order",
        "supplier",
        order_sets(spark, sf_dir, means),
        unallocated,
    )


def lines_of(spark: SparkSession, sf_dir: str, year: int) -> DataFrame:
    """Lines shipped in a year, as a range the scan can prune by."""
    return table(spark, sf_dir, "lineitem").where(
        f"l_shipdate >= TIMESTAMP_NTZ'{year}-01-01' AND l_shipdate < TIMESTAMP_NTZ'{year + 1}-01-01'"
    )


def in_year(year: int) -> Column:
    """Whether a line was shipped in a year."""
    return F.expr(
        f"l_shipdate >= TIMESTAMP_NTZ'{year}-01-01' AND l_shipdate < TIMESTAMP_NTZ'{year + 1}-01-01'"
    )


def flag_shares(spark: SparkSession, sf_dir: str, key: str, year: int) -> DataFrame:
    """Percent of a unit's quantity under each return flag in one year."""
    lines = lines_of(spark, sf_dir, year)
    quantity = F.col("l_quantity")
    sums = lines.groupBy(key).agg(
        F.sum(quantity).alias("q"),
        *[total(F.when(F.col("l_returnflag") == f, quantity)).alias(f) for f in "ANR"],
    )
    return sums.select(key, *[F.try_divide(100 * F.col(f), "q").alias(f) for f in "ANR"])


def supplier_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with an 11-character code that nests in their nation's two."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("supplier"),
        F.concat(normalize_code("s_nationkey", 2), normalize_code("s_suppkey", 9)).alias("unit"),
        F.col("s_name").alias("name"),
    )


def aligned_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with a rate in both years, as `align_vintages` gives them for two tables:
    where both vintages come from one table, one scan and one aggregate hold them."""
    years = {"18": in_year(CURRENT_YEAR), "10": in_year(PRIOR_YEAR)}
    quantity = F.col("l_quantity")
    lines = table(spark, sf_dir, "lineitem").where(years["18"] | years["10"])
    sums = lines.groupBy("l_suppkey").agg(
        *[F.sum(F.when(own, quantity)).alias(f"q{s}") for s, own in years.items()],
        *[
            total(F.when(own & (F.col("l_returnflag") == f), quantity)).alias(f"{f}{s}")
            for s, own in years.items()
            for f in "ANR"
        ],
    )
    shares = sums.where("q18 <> 0 AND q10 <> 0").select(
        "l_suppkey",
        *[(100 * F.col(f"{f}{s}") / F.col(f"q{s}")).alias(f"{f}{s}") for s in years for f in "ANR"],
    )
    units = supplier_units(spark, sf_dir)
    rates = units.join(shares, F.col("supplier") == F.col("l_suppkey")).drop("l_suppkey")
    return rates.withColumns(
        {"rate18": F.col("R18"), "rate10": F.col("R10"), "dif": F.col("R18") - F.col("R10")}
    )


def classified(rates: DataFrame) -> DataFrame:
    """Class per period: returned before accepted before new."""
    return rates.withColumns(
        {
            f"class{s}": majority_class({f: f"{f}{s}" for f in "RAN"}, THRESHOLD)
            for s in ("10", "18")
        }
    )


def central(spark: SparkSession, sf_dir: str, means: bool = True) -> DataFrame:
    """Interpolated attributes, rates and classes of every supplier."""
    # Unallocated orders would only add a unit without a code, which no group takes in.
    attributes = interpolated(spark, sf_dir, means, unallocated=False)
    # Suppliers are unique on both sides, so plain equality can reuse the partitioning
    # that the interpolation's aggregate leaves behind.
    units = full_join(attributes, aligned_suppliers(spark, sf_dir), ["supplier"], null_safe=False)
    return classified(units)


def focus_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of the focus region."""
    regions = table(spark, sf_dir, "region").where(F.col("r_name") == FOCUS_REGION)
    nations = restrict_to(table(spark, sf_dir, "nation"), "n_regionkey", regions, "r_regionkey")
    units = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier"), "s_nationkey")
    return restrict_to(units, "s_nationkey", nations, "n_nationkey")


def group_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation code to group; a nation of the focus region leads to two groups."""
    nations = table(spark, sf_dir, "nation")
    regions = table(spark, sf_dir, "region").where(F.col("r_name") == FOCUS_REGION)
    code = normalize_code("n_nationkey", 2).alias("nation_code")
    own = nations.select(code, F.col("n_nationkey").alias("group_id"), F.col("n_name").alias("grp"))
    focus = restrict_to(nations, "n_regionkey", regions, "r_regionkey").select(
        code, F.col("n_nationkey").alias("group_id"), F.lit(FOCUS).alias("grp")
    )
    return own.unionByName(focus)


def peer_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest nations by number of customers."""
    sizes = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("customers")
    )
    return top_k(sizes, "customers", PEERS, "c_nationkey")


def in_groups(units: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with all their groups, found through the nation part of their code."""
    prefixed = units.withColumn("prefix", key_prefix("unit", 2))
    return assign_groups(prefixed, group_lookup(spark, sf_dir), "prefix", "nation_code")


def peer_units(units: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = in_groups(units, spark, sf_dir)
    return restrict_to(grouped, "group_id", peer_groups(spark, sf_dir), "c_nationkey")


def comparison(spark: SparkSession, sf_dir: str, dedupe_total: bool = False) -> DataFrame:
    units = peer_units(central(spark, sf_dir, means=False), spark, sf_dir)
    return compare_periods(
        units, "grp", PRIOR, CURRENT, dedupe_total=dedupe_total, unit=["supplier"]
    )


def part_rates(spark: SparkSession, sf_dir: str, year: int, rate: str) -> DataFrame:
    """A year's rate of the parts sold in it: some parts lack one year or both."""
    shares = flag_shares(spark, sf_dir, "l_partkey", year)
    parts = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat(F.lit("1400000US"), normalize_code("p_partkey", 11)).alias("full_id"),
        F.col("p_name").alias("name"),
    )
    rates = left_join(shares, parts, [("l_partkey", "p_partkey")])
    return rates.select("full_id", "name", F.col("R").alias(rate))


def part_vintages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Current rates, delivered as text, and prior rates as numbers."""
    current = part_rates(spark, sf_dir, CURRENT_YEAR, "rate18")
    prior = part_rates(spark, sf_dir, PRIOR_YEAR, "rate10")
    return current.withColumn("rate18", F.col("rate18").cast("string")), prior


def supplier_year(spark: SparkSession, sf_dir: str, year: int) -> DataFrame:
    """Rate, nation code and weight of every supplier active in a year."""
    lines = lines_of(spark, sf_dir, year)
    returned = F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))
    sums = lines.groupBy("l_suppkey").agg(
        F.sum("l_quantity").alias("quantity"), total(returned).alias("returned")
    )
    joined = left_join(sums, supplier_weights(spark, sf_dir), [("l_suppkey", "s_suppkey")])
    return joined.withColumn("rate", 100 * F.try_divide("returned", "quantity"))


def supplier_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        normalize_code("s_nationkey", 2).alias("code"),
        F.lit(1.0).alias("one"),
        F.greatest(F.col("s_acctbal"), F.lit(0.0)).alias("balance"),
    )


def nation_rates(spark: SparkSession, sf_dir: str, year: int, rate: str) -> DataFrame:
    sums = supplier_year(spark, sf_dir, year).groupBy("code").agg(
        (100 * F.try_divide(F.sum("returned"), F.sum("quantity"))).alias(rate)
    )
    return left_join(sums, nation_names(spark, sf_dir), ["code"])


def nation_rates_by_year(spark: SparkSession, sf_dir: str, years: dict[int, str]) -> DataFrame:
    """Rates of several years by nation code, from one scan; missing where a year has none."""
    lines = table(spark, sf_dir, "lineitem")
    quantity, returned = F.col("l_quantity"), F.col("l_returnflag") == "R"
    sums = lines.groupBy("l_suppkey").agg(
        *[F.sum(F.when(in_year(y), quantity)).alias(f"q_{n}") for y, n in years.items()],
        *[F.sum(F.when(in_year(y) & returned, quantity)).alias(f"r_{n}") for y, n in years.items()],
    )
    coded = left_join(sums, supplier_weights(spark, sf_dir), [("l_suppkey", "s_suppkey")])
    return coded.groupBy("code").agg(
        *[
            (100 * F.try_divide(total(f"r_{n}"), F.sum(f"q_{n}"))).alias(n)
            for n in years.values()
        ]
    )


def nation_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        normalize_code("n_nationkey", 2).alias("code"), F.col("n_name").alias("name")
    )


def nation_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with two own weights, two rates, two weights from suppliers and a snapshot."""
    customers = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(
        F.count(F.lit(1)).cast("double").alias("w10"),
        total(F.greatest(F.col("c_acctbal"), F.lit(0.0))).alias("w18"),
    )
    weights = left_join(
        customers.withColumn("code", normalize_code("c_nationkey", 2)).drop("c_nationkey"),
        nation_names(spark, sf_dir),
        ["code"],
    )
    all_rates = nation_rates_by_year(
        spark, sf_dir, {CURRENT_YEAR: "rate18", PRIOR_YEAR: "rate10", CURRENT_YEAR - 1: "rate_snapshot"}
    )
    rates = left_join(all_rates.drop("rate_snapshot"), nation_names(spark, sf_dir), ["code"])
    alternatives = [
        sums_by(
            supplier_weights(spark, sf_dir), "code", {"w18alt": "balance", "w10alt": "one"}
        ),
        all_rates.select("code", "rate_snapshot"),
    ]
    return regional_frame(
        weights, rates, ["code", "name"], ["rate18", "rate10"], alternatives, "code"
    )
