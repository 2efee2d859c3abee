"""Move attributes from source units to target units through a crosswalk."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areashift.functions import allocate_sum, exact_sum, weighted_mean
from areashift.operators.joins import keyed_join, left_join, named
from areashift.sources.crosswalks import Bucketed, LandedCrosswalk


@dataclass(frozen=True)
class SourceSet:
    """Attributes of the source units at one time, one row per unit.

    ``means`` are averaged with the crosswalk's share of the target (``mean_weight``);
    ``counts`` are allocated with its share of the source (``count_weight``).
    ``suffix`` marks output columns whose bare name another set also has.
    """

    rows: DataFrame
    key: str
    suffix: str = ""
    means: Sequence[str] = field(default=())
    mean_weight: str | None = None
    counts: Sequence[str] = field(default=())
    count_weight: str | None = None

    @property
    def measures(self) -> list[str]:
        return [*self.means, *self.counts]

    @property
    def weights(self) -> list[str]:
        used = []
        if self.means:
            used.append(self.mean_weight)
        if self.counts:
            used.append(self.count_weight)
        if None in used:
            raise ValueError("means need mean_weight and counts need count_weight")
        return used


def attach_attributes(
    crosswalk: DataFrame,
    attributes: DataFrame,
    source: str,
    key: str,
    unallocated: bool = True,
) -> DataFrame:
    """Crosswalk rows with their source unit's attributes, as a full join would give.

    Attribute rows no crosswalk row refers to come last with a NULL crosswalk side
    (``unallocated=False`` leaves them out). Written as a left join and an anti join
    because a full join cannot be split when one source holds much of the crosswalk.
    """
    attached = left_join(crosswalk, attributes, [(source, key)])
    if not unallocated:
        return attached
    known = crosswalk.select(named(source)).distinct()
    missing = keyed_join(attributes, known, [(key, source)], "left_anti")
    missing = missing.withColumnRenamed(key, source)
    return attached.unionByName(missing, allowMissingColumns=True)


def _one_row_per_source(
    sets: Sequence[SourceSet], source: str, landed: Bucketed | None = None
) -> DataFrame:
    """All sets side by side, columns ``__v<set>_<measure>``, from one grouping; dealt like
    ``landed`` pairs where given, for which keys must have their type as well.

    Fails when a set repeats a unit: the sets would multiply each other's rows.
    """
    def key(s: SourceSet) -> Column:
        own = named(s.key)
        return own.cast(landed.pairs.schema[source].dataType) if landed else own

    parts = [
        s.rows.select(
            key(s).alias(source),
            F.lit(i).alias("__set"),
            *[named(m).alias(f"__v{i}_{j}") for j, m in enumerate(s.measures)],
        )
        for i, s in enumerate(sets)
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if landed:
        stacked = stacked.repartition(landed.buckets, named(source))
    values = [f"__v{i}_{j}" for i, s in enumerate(sets) for j in range(len(s.measures))]
    repeated = reduce(
        lambda a, b: a | b, [F.count_if(F.col("__set") == i) > 1 for i in range(len(sets))]
    )
    grouped = stacked.groupBy(source).agg(
        repeated.alias("__repeated"), *[F.max(v).alias(v) for v in values]
    )
    message = F.concat(
        F.lit("source unit occurs twice in one set: "),
        F.coalesce(named(source).cast("string"), F.lit("NULL")),
    )
    # a condition, not a new source column, which would hide how rows are dealt
    single = F.when(F.col("__repeated"), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return grouped.where(single).select(named(source), *values)


def areal_interpolate(
    crosswalk: DataFrame | LandedCrosswalk,
    source: str,
    target: str,
    sets: Sequence[SourceSet],
    unallocated: bool = True,
    exact: bool = False,
) -> DataFrame:
    """One row per target unit with the attributes of all sets.

    All sets ride through one join with the crosswalk and one aggregate over it.
    Source units outside the crosswalk gather under a NULL target (counts 0, means
    NULL); ``unallocated=False`` saves that second look at the crosswalk where the
    row is not wanted. The pairs of a landed crosswalk, which goes either way, are not
    shuffled for the join. With ``exact`` sums do not depend on how rows are dealt, to the
    last bit, which costs about four times as much adding.
    """
    add = exact_sum if exact else F.sum
    weights = list(dict.fromkeys(w for s in sets for w in s.weights))
    weight = {w: F.col(f"__w{i}") for i, w in enumerate(weights)}

    landed = crosswalk.by(source) if isinstance(crosswalk, LandedCrosswalk) else None
    attributes = _one_row_per_source(sets, source, landed)

    shared = Counter(m for s in sets for m in s.measures)
    columns = []
    for i, s in enumerate(sets):
        for j, measure in enumerate(s.measures):
            value = F.col(f"__v{i}_{j}")
            if j < len(s.means):
                column = weighted_mean(value, weight[s.mean_weight], na_rm=True, add=add)
            else:
                column = allocate_sum(value, weight[s.count_weight], add)
            name = measure + s.suffix if shared[measure] > 1 else measure
            columns.append(column.alias(name))

    if landed:
        attached = landed.attach(attributes, unallocated)
        attached = attached.withColumnsRenamed({w: f"__w{i}" for i, w in enumerate(weights)})
    else:
        slim = crosswalk.select(
            named(source),
            named(target),
            *[named(w).alias(f"__w{i}") for i, w in enumerate(weights)],
        )
        attached = attach_attributes(slim, attributes, source, source, unallocated)
    return attached.groupBy(target).agg(*columns)


def interpolate_means(
    crosswalk: DataFrame,
    attributes: DataFrame,
    source: str,
    key: str,
    target: str,
    means: Sequence[str],
    weight: str,
) -> DataFrame:
    """Averages only: mean per target, weighted by the share of the target."""
    one = SourceSet(attributes, key, means=means, mean_weight=weight)
    return areal_interpolate(crosswalk, source, target, [one])


def interpolate_counts(
    crosswalk: DataFrame,
    attributes: DataFrame,
    source: str,
    key: str,
    target: str,
    counts: Sequence[str],
    weight: str,
) -> DataFrame:
    """Counts only: sum per target, allocated by the share of the source."""
    one = SourceSet(attributes, key, counts=counts, count_weight=weight)
    return areal_interpolate(crosswalk, source, target, [one])
