"""Data-quality checks. Each returns rows with the figures compared and a verdict."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areashift.functions import clean, strict_sum, to_number, total, weighted_mean
from areashift.operators.interpolate import SourceSet
from areashift.operators.joins import Chosen, among, chosen_keys, left_join, named
from areashift.sources.crosswalks import LandedCrosswalk


@dataclass(frozen=True)
class Conserved:
    """A figure that must survive: a total, or a mean when both weights are given."""

    name: str
    before: str
    after: str
    before_weight: str | None = None
    after_weight: str | None = None


def conservation_check(
    before: DataFrame, after: DataFrame, figures: Sequence[Conserved], tolerance: float = 1e-4
) -> DataFrame:
    """One row per figure: its value before and after, the relative error, passed.

    Both tables go through one aggregate into one row of totals.
    """

    def side(rows: DataFrame, is_before: bool) -> DataFrame:
        columns = [F.lit(is_before).alias("__before")]
        for i, f in enumerate(figures):
            value, weight = (
                (f.before, f.before_weight) if is_before else (f.after, f.after_weight)
            )
            columns.append(clean(named(value)).alias(f"__x{i}"))
            if weight is not None:
                columns.append(clean(named(weight)).alias(f"__w{i}"))
        return rows.select(*columns)

    def figure(i: int, where: Column) -> Column:
        if figures[i].before_weight is None:
            return total(F.when(where, F.col(f"__x{i}")))
        return weighted_mean(F.col(f"__x{i}"), F.col(f"__w{i}"), where=where)

    both = side(before, True).unionByName(side(after, False))
    is_before = F.col("__before")
    sums = both.agg(
        *[figure(i, is_before).alias(f"__b{i}") for i in range(len(figures))],
        *[figure(i, ~is_before).alias(f"__a{i}") for i in range(len(figures))],
    )
    entries = [
        F.struct(
            F.lit(f.name).alias("figure"),
            F.col(f"__b{i}").alias("before"),
            F.col(f"__a{i}").alias("after"),
        )
        for i, f in enumerate(figures)
    ]
    relative = F.abs(1 - F.try_divide(F.col("after"), F.col("before")))
    return (
        sums.select(F.inline(F.array(*entries)))
        .withColumn("relative_error", relative)
        .withColumn("passed", F.col("relative_error") < tolerance)
    )


def _verdicts(
    rows: DataFrame, unit: str, cases: Sequence[tuple[str, str]], tolerance: float
) -> DataFrame:
    """Long form of columns ``__got<i>`` and ``__want<i>``: one row per unit and (case, measure)."""
    entries = [
        F.struct(
            F.lit(case).alias("case"),
            F.lit(measure).alias("measure"),
            F.col(f"__got{i}").alias("interpolated"),
            F.col(f"__want{i}").alias("recomputed"),
        )
        for i, (case, measure) in enumerate(cases)
    ]
    return rows.select(
        named(unit).cast("string").alias("unit"), F.inline(F.array(*entries))
    ).withColumn("passed", F.abs(F.col("interpolated") - F.col("recomputed")) <= tolerance)


def target_check(
    interpolated: DataFrame,
    crosswalk: DataFrame | LandedCrosswalk,
    source: str,
    target: str,
    attributes: SourceSet,
    output_names: Sequence[str] | None = None,
    targets: Chosen = None,
    tolerance: float = 1e-4,
) -> DataFrame:
    """Every target's measures against the plain sum of value x share / 100 of its sources.

    Counts use the share of the source (case "allocated"), means the share of the
    target (case "averaged"). The plain sum is strict: it is NULL, and so is the
    verdict, when a value is missing. For a mean it is only equal when the shares of
    the target add up to 100.
    The pairs of a landed crosswalk are not shuffled for the join.
    """
    measures = attributes.measures
    output_names = output_names or measures
    landed = crosswalk.by(source) if isinstance(crosswalk, LandedCrosswalk) else None
    targets = chosen_keys(landed.pairs if landed else crosswalk, target, targets)
    key = named(attributes.key)
    own = attributes.rows.select(
        (key.cast(landed.pairs.schema[source].dataType) if landed else key).alias(source),
        *[clean(named(m)).alias(f"__x{i}") for i, m in enumerate(measures)],
    )
    weights = [attributes.mean_weight] * len(attributes.means)
    weights += [attributes.count_weight] * len(attributes.counts)
    if landed:
        attached = landed.attach(own.repartition(landed.buckets, named(source)), unallocated=False)
        attached = among(attached, target, targets)
    else:
        shares = among(crosswalk, target, targets).select(
            named(source), named(target), *[named(w) for w in dict.fromkeys(weights)]
        )
        attached = left_join(shares, own, [source])
    again = attached.groupBy(target).agg(
        *[
            strict_sum(F.col(f"__x{i}") * clean(named(w)) / 100).alias(f"__want{i}")
            for i, w in enumerate(weights)
        ]
    )
    got = among(interpolated, target, targets).select(
        named(target),
        *[clean(named(n)).alias(f"__got{i}") for i, n in enumerate(output_names)],
    )
    both = left_join(got, again, [target])
    cases = [("averaged", m) for m in attributes.means]
    cases += [("allocated", m) for m in attributes.counts]
    return _verdicts(both, target, cases, tolerance)


def source_check(
    crosswalk: DataFrame,
    source: str,
    attributes: SourceSet,
    sources: Chosen = None,
    tolerance: float = 1e-4,
) -> DataFrame:
    """What each source hands out over all its targets against what it has (case "split").

    A source whose shares add up to 100 loses nothing, whether its targets are pieces
    of it or merge it with others.
    """
    counts = list(attributes.counts)
    sources = chosen_keys(crosswalk, source, sources)
    handed_out = (
        among(crosswalk, source, sources)
        .groupBy(source)
        .agg(strict_sum(clean(named(attributes.count_weight))).alias("__share"))
    )
    own = among(attributes.rows, attributes.key, sources).select(
        named(attributes.key).alias(source),
        *[clean(named(c)).alias(f"__want{i}") for i, c in enumerate(counts)],
    )
    both = left_join(handed_out, own, [source]).withColumns(
        {f"__got{i}": F.col(f"__want{i}") * F.col("__share") / 100 for i in range(len(counts))}
    )
    return _verdicts(both, source, [("split", c) for c in counts], tolerance)


def inherited_check(
    interpolated: DataFrame,
    crosswalk: DataFrame,
    source: str,
    target: str,
    attributes: SourceSet,
    output_names: Sequence[str] | None = None,
    targets: Chosen = None,
    tolerance: float = 1e-9,
) -> DataFrame:
    """Means of targets cut out of a single source against the source's own ("inherited")."""
    means = list(attributes.means)
    output_names = output_names or means
    targets = chosen_keys(crosswalk, target, targets)
    single = (
        among(crosswalk, target, targets)
        .groupBy(target)
        .agg(F.min(named(source)).alias("__first"), F.max(named(source)).alias("__last"))
        .where(F.col("__first") == F.col("__last"))
        .drop("__last")
    )
    own = attributes.rows.select(
        named(attributes.key),
        *[clean(named(m)).alias(f"__want{i}") for i, m in enumerate(means)],
    )
    got = among(interpolated, target, targets).select(
        named(target),
        *[clean(named(n)).alias(f"__got{i}") for i, n in enumerate(output_names)],
    )
    parent = left_join(single, own, [("__first", attributes.key)]).drop("__first")
    both = left_join(parent, got, [target])
    return _verdicts(both, target, [("inherited", m) for m in means], tolerance)


def closed_case_check(
    case: str,
    interpolated: DataFrame,
    target: str,
    targets: Chosen,
    output_name: str,
    attributes: DataFrame,
    key: str,
    sources: Chosen,
    measure: str,
    tolerance: float = 1e-4,
) -> DataFrame:
    """One row: a total over chosen targets against that over the sources they come from.

    Units are chosen by a list, by the first column of a table, or not at all (None).
    ``targets_found`` and ``sources_found`` count the units; where one is 0 there is no
    total of that side and no verdict.
    """
    got = among(interpolated, target, targets).select(
        F.lit(True).alias("__got"), clean(named(output_name)).alias("__x")
    )
    want = among(attributes, key, sources).select(
        F.lit(False).alias("__got"), clean(named(measure)).alias("__x")
    )
    # A row of the other side adds 0, so that only missing values of its own side count.
    def side(is_got: bool) -> Column:
        own = F.col("__got") == is_got
        sum_ = strict_sum(F.when(own, F.col("__x")).otherwise(F.lit(0.0)))
        return F.when(F.count_if(own) > 0, sum_)

    sums = got.unionByName(want).agg(
        side(True).alias("interpolated"),
        side(False).alias("recomputed"),
        F.count_if(F.col("__got")).alias("targets_found"),
        F.count_if(~F.col("__got")).alias("sources_found"),
    )
    return sums.select(
        F.lit(case).alias("case"),
        F.lit(measure).alias("measure"),
        "interpolated",
        "recomputed",
        "targets_found",
        "sources_found",
        (F.abs(F.col("interpolated") - F.col("recomputed")) <= tolerance).alias("passed"),
    )


def summarize_checks(verdicts: DataFrame) -> DataFrame:
    """Per case and measure: units checked, passed, failed, and not decidable."""
    return verdicts.groupBy("case", "measure").agg(
        F.count(F.lit(1)).alias("units"),
        F.count_if(F.col("passed")).alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.count_if(F.col("passed").isNull()).alias("unknown"),
    )


def missing_report(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: how many units, and how many lack each measure, any, or all of them."""
    gaps = [to_number(named(c)).isNull() for c in columns]
    return rows.agg(
        F.count(F.lit(1)).alias("units"),
        *[F.count_if(g).alias(f"missing_{c}") for g, c in zip(gaps, columns)],
        F.count_if(reduce(lambda a, b: a | b, gaps)).alias("missing_any"),
        F.count_if(reduce(lambda a, b: a & b, gaps)).alias("missing_all"),
    )
