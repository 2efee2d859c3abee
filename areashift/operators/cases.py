"""Cases of changed boundaries: groups of units that hand their parts to each other.

A source and a target that overlap belong to one case, and so do all units linked through
others: a connected component of the overlaps. Nothing crosses the border of a case, so
what its sources have, its targets must get, whether units merged, split, or redrew their
borders. The cases are found from the overlaps, over all units.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areashift.functions import clean, strict_sum
from areashift.operators.interpolate import SourceSet
from areashift.operators.joins import keyed_join, left_join, named
from areashift.session import scratch_folder
from areashift.sources.writers import materialize

KINDS = ("unchanged", "merge", "split", "boundary")


def kept(rows: DataFrame, name: str) -> DataFrame:
    """Rows written to the shared folder and read back: the numbers in them must not change."""
    return materialize(rows, scratch_folder(rows.sparkSession, name))


def connected(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(node, root) for every node of the edges, root the smallest node it is linked to.

    Nodes are whole numbers. Every round each node takes over the least root seen by its
    neighbours, hands it to its own root as well, and skips to the root of its root, so paths
    of any length shrink by a factor, and rounds grow with the logarithm of the longest. A
    round is two joins and two aggregates combined on the map side; a node that many edges
    meet is on the many side of a join that can be split. Every round is written. An action.
    """
    pairs = edges.select(named(u).cast("long").alias("u"), named(v).cast("long").alias("v"))
    pairs = pairs.where("u IS NOT NULL AND v IS NOT NULL")
    both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = kept(both.distinct(), "edges")
    near = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("__least"))
    roots = kept(near.select("node", F.least("node", "__least").alias("root")), "roots")
    before = None
    while True:
        # roots only ever fall, so an equal sum means that none did
        now = roots.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return roots
        before = now
        above = roots.select(F.col("node").alias("__above"), F.col("root").alias("top"))
        topped = kept(left_join(roots, above, [("root", "__above")]), "topped")
        seen = left_join(both, topped.select("node", F.col("top").alias("near_top")), [("v", "node")])
        least = seen.groupBy(F.col("u").alias("__node")).agg(F.min("near_top").alias("near_top"))
        offers = left_join(topped, least, [("node", "__node")])
        best = F.least("top", "near_top")
        each = F.array(
            F.struct("node", best.alias("root")), F.struct(F.col("root").alias("node"), best.alias("root"))
        )
        offered = offers.select(F.inline(each)).groupBy("node").agg(F.min("root").alias("root"))
        roots = kept(offered, "roots")


def overlap_cases(
    crosswalk: DataFrame, source: str, target: str, shares: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources with their case, targets with theirs, cases). An action.

    Pairs without a source or target belong to no case, and where ``shares`` are named
    neither do pairs of which none is above zero. A case is numbered, with its first source
    and target in the order of keys, how many there are of each, and its kind: one source
    becomes one target (unchanged), several one (merge), one several (split), or several
    several (boundary).
    """
    pairs = crosswalk.where(named(source).isNotNull() & named(target).isNotNull())
    if shares:
        pairs = pairs.where(F.greatest(*[clean(named(s)) for s in shares], F.lit(0.0)) > 0)
    pairs = kept(pairs.select(named(source).alias("source"), named(target).alias("target")), "pairs")

    # even numbers for sources, odd ones for targets, so that equal keys do not meet
    number = F.shiftleft(F.monotonically_increasing_id(), 1)
    sources = kept(pairs.select("source").distinct().withColumn("s", number), "sources")
    targets = kept(pairs.select("target").distinct().withColumn("t", number + 1), "targets")
    edges = left_join(left_join(pairs, sources, ["source"]), targets, ["target"])
    roots = connected(edges, "s", "t").select(F.col("node").alias("__node"), F.col("root").alias("case"))

    own = left_join(sources, roots, [("s", "__node")]).select("source", "case")
    got = left_join(targets, roots, [("t", "__node")]).select("target", "case")
    own, got = kept(own, "source-cases"), kept(got, "target-cases")
    befores = own.groupBy("case").agg(F.count("*").alias("sources"), F.min("source").alias("first_source"))
    afters = got.groupBy("case").agg(F.count("*").alias("targets"), F.min("target").alias("first_target"))
    several = (F.col("sources") > 1).cast("int") + 2 * (F.col("targets") > 1).cast("int")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), several + 1)
    cases = left_join(befores, afters, ["case"]).withColumn("kind", kind)
    return own, got, cases


def case_verdicts(
    crosswalk: DataFrame,
    source: str,
    target: str,
    attributes: SourceSet,
    interpolated: DataFrame,
    output_names: Sequence[str] | None = None,
    tolerance: float = 1e-4,
) -> DataFrame:
    """One row per case and measure: what its sources have, what its targets got, and passed.

    A count must come out as it went in: ``before`` and ``after`` are its sums over the case
    (``test`` "total"), missing where a value is. A mean must lie between the least and the
    largest of its sources, and so equal that of a single one (``test`` "range"): there are
    ``before`` and ``after`` bounds, over the units that have a value. Without a value on
    either side there is no verdict. Sums and bounds of all measures come from one
    aggregate over both sides.
    """
    measures = attributes.measures
    output_names = output_names or measures
    means = len(attributes.means)
    own, got, cases = overlap_cases(crosswalk, source, target, attributes.weights)

    def side(units: DataFrame, rows: DataFrame, unit: str, key: str, names: Sequence[str], before: bool) -> DataFrame:
        values = rows.select(named(key).alias("__key"), *[clean(named(n)).alias(f"__x{i}") for i, n in enumerate(names)])
        return left_join(units, values, [(unit, "__key")]).select(
            "case", F.lit(before).alias("__before"), *[f"__x{i}" for i in range(len(names))]
        )

    both = side(own, attributes.rows, "source", attributes.key, measures, True).unionAll(
        side(got, interpolated, "target", target, output_names, False)
    )

    def figures(i: int, is_before: bool) -> list[Column]:
        of_side = F.col("__before") == is_before
        value = F.col(f"__x{i}")
        tag = "b" if is_before else "a"
        if i < means:
            return [f(F.when(of_side, value)).alias(f"__{tag}{i}_{n}") for n, f in (("low", F.min), ("high", F.max))]
        # rows of the other side add 0, so that only missing values of its own side count
        total = strict_sum(F.when(of_side, value).otherwise(F.lit(0.0)))
        return [total.alias(f"__{tag}{i}_low")]

    sums = both.groupBy("case").agg(
        *[c for i in range(len(measures)) for before in (True, False) for c in figures(i, before)]
    )

    def entry(i: int) -> Column:
        high = "high" if i < means else "low"
        return F.struct(
            F.lit(measures[i]).alias("measure"),
            F.lit("range" if i < means else "total").alias("test"),
            F.col(f"__b{i}_low").alias("before_low"),
            F.col(f"__b{i}_{high}").alias("before_high"),
            F.col(f"__a{i}_low").alias("after_low"),
            F.col(f"__a{i}_{high}").alias("after_high"),
        )

    rows = left_join(cases, sums, ["case"])
    rows = rows.select(
        "first_source", "first_target", "kind", "sources", "targets",
        F.inline(F.array(*[entry(i) for i in range(len(measures))])),
    )
    low = F.col("after_low") >= F.col("before_low") - tolerance
    high = F.col("after_high") <= F.col("before_high") + tolerance
    return rows.withColumn("passed", low & high)


def units_of_case(units: DataFrame, unit: str, cases: DataFrame) -> DataFrame:
    """The sources or targets (as ``overlap_cases`` gives them) of chosen cases only."""
    return keyed_join(units, cases.select("case"), ["case"], "left_semi").select(unit, "case")
