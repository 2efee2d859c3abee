"""Whether two tables hold the same rows, without joining what is equal.

Every row is hashed with its keys and dealt into a bucket by them; a bucket is told by how
many rows it has and by sums of their hashes, which do not depend on order or partitions
and combine on the map side. Only rows of buckets that differ are looked at one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areashift.operators.joins import named
from areashift.session import scratch_folder
from areashift.sources.writers import materialize

#: Buckets of keys: so many rows of fingerprints at most, and a differing row takes the
#: rows of one of them along.
BUCKETS = 1 << 14


def _cell(value: Column, kind: str, tolerance: float) -> list[Column]:
    """What stands for a value in the hash: two doubles of one cell differ by less than the
    tolerance of their size (of 1 below that). Close values on both sides of an edge hash
    differently, and are then compared themselves."""
    if kind not in ("double", "float"):
        return [value]
    if tolerance <= 0:
        return [value + F.lit(0.0)]  # no minus zero
    size = F.pow(F.lit(2.0), F.rint(F.log2(F.greatest(F.abs(value), F.lit(1.0))) - 0.5))
    width = tolerance * size
    return [F.rint(value / width) + F.lit(0.0), width, F.signum(value) + F.lit(0.0)]


def _cells(columns: Sequence[str], kinds: dict[str, str], tolerance: float) -> list[Column]:
    return [cell for c in columns for cell in _cell(named(c), kinds[c], tolerance)]


def _tagged(
    left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float, buckets: int
) -> DataFrame:
    """Rows of both sides under one another, with their bucket, side and two hashes."""
    wanted = [named(c) for c in dict.fromkeys((*keys, *columns))]
    both = left.select(*wanted, F.lit(True).alias("__left")).unionByName(
        right.select(*wanted, F.lit(False).alias("__left"))
    )
    kinds = dict(both.dtypes)
    own = [*[named(k) for k in keys], *_cells(columns, kinds, tolerance)]
    return both.withColumns(
        {
            "__bucket": F.pmod(F.xxhash64(*[named(k) for k in keys]), F.lit(buckets)),
            "__h1": F.xxhash64(*own),
            "__h2": F.xxhash64(F.lit(1), *own),
        }
    )


def fingerprints(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    tolerance: float = 0.0,
    buckets: int = BUCKETS,
) -> DataFrame:
    """(bucket, n_left, n_right, same) of every bucket that has rows, from one aggregate.

    Two 64-bit hashes are summed in halves, which cannot overflow, on either side.
    """
    rows = _tagged(left, right, keys, columns, tolerance, buckets)
    half = F.lit((1 << 32) - 1)
    parts = [p for h in ("__h1", "__h2") for p in (F.col(h).bitwiseAND(half), F.shiftrightunsigned(h, 32))]
    sides = {"l": F.col("__left"), "r": ~F.col("__left")}
    sums = [F.sum(F.when(on, p).otherwise(F.lit(0))).alias(f"__{s}{i}") for s, on in sides.items() for i, p in enumerate(parts)]
    grouped = rows.groupBy(F.col("__bucket").alias("bucket")).agg(
        F.count_if(sides["l"]).alias("n_left"), F.count_if(sides["r"]).alias("n_right"), *sums
    )
    same = F.col("n_left") == F.col("n_right")
    for i in range(len(parts)):
        same &= F.col(f"__l{i}") == F.col(f"__r{i}")
    return grouped.select("bucket", "n_left", "n_right", same.alias("same"))


def _settled(
    left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float, marks: DataFrame, buckets: int
) -> DataFrame:
    """Per key of the differing buckets: rows equal on both sides, rows left over on each,
    and per column whether the one row left over on either side matches."""
    differing = marks.where("NOT same").select(F.col("bucket").alias("__bucket"))
    rows = _tagged(left, right, keys, columns, tolerance, buckets)
    # at most BUCKETS numbers, whatever the tables hold
    rows = rows.join(F.broadcast(differing), "__bucket", "left_semi")
    doubles = {c for c, kind in rows.dtypes if kind == "double"}

    on_left, on_right = F.col("__left"), ~F.col("__left")
    value = lambda side, c: F.max(F.when(side, named(c)))
    alike = rows.groupBy(*[named(k) for k in keys], "__h1", "__h2").agg(
        F.count_if(on_left).alias("__nl"),
        F.count_if(on_right).alias("__nr"),
        *[value(side, c).alias(f"__{s}{i}") for i, c in enumerate(columns) for s, side in (("l", on_left), ("r", on_right))],
    )
    more = F.col("__nl") > F.col("__nr")
    less = F.col("__nr") > F.col("__nl")
    by_key = alike.groupBy(*[named(k) for k in keys]).agg(
        F.sum(F.least("__nl", "__nr")).alias("__equal"),
        F.sum(F.greatest(F.col("__nl") - F.col("__nr"), F.lit(0))).alias("__over_l"),
        F.sum(F.greatest(F.col("__nr") - F.col("__nl"), F.lit(0))).alias("__over_r"),
        *[F.max(F.when(over, F.col(f"__{s}{i}"))).alias(f"__{s}{i}") for i in range(len(columns)) for s, over in (("l", more), ("r", less))],
    )

    def matches(i: int, column: str) -> Column:
        a, b = F.col(f"__l{i}"), F.col(f"__r{i}")
        equal = a.eqNullSafe(b)
        if column in doubles and tolerance > 0:
            allowed = tolerance * F.greatest(F.abs(a), F.lit(1.0))
            finite = F.greatest(F.abs(a), F.abs(b)) < float("inf")
            equal |= F.coalesce(finite & (F.abs(a - b) <= allowed), F.lit(False))
        return (F.col("__over_l") == 1) & (F.col("__over_r") == 1) & equal

    return by_key.withColumns({f"__match{i}": matches(i, c) for i, c in enumerate(columns)})


def frame_equality(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    tolerance: float = 0.0,
    buckets: int = BUCKETS,
) -> DataFrame:
    """One row: rows seen, matches of every column, their least, and whether all match.

    Rows are matched by key, not position, and a row that stands several times on both sides
    as often as it does on both. Two missing cells match; a row present on one side only
    matches nowhere, and neither does one of several that differ under one key: a key counts
    as many rows as the side with more of them has. Doubles may differ by ``tolerance`` of
    their size (of 1 below that): sums over differently split data differ in their last bits.

    An action: it writes the fingerprints. Where all are equal the tables are not read again.
    """
    spark = left.sparkSession
    marks = fingerprints(left, right, keys, columns, tolerance, buckets)
    marks = materialize(marks, scratch_folder(spark, "fingerprints"))
    agreed = marks.where("same").agg(F.coalesce(F.sum("n_left"), F.lit(0)).alias("__n"))
    named_matches = [f"match_{c}" for c in columns]
    parts = [agreed.select(F.col("__n").alias("n_rows"), *[F.col("__n").alias(m) for m in named_matches])]
    if not marks.where("NOT same").isEmpty():
        rows = _settled(left, right, keys, columns, tolerance, marks, buckets)
        seen = F.col("__equal") + F.greatest("__over_l", "__over_r")
        matched = [F.col("__equal") + F.col(f"__match{i}").cast("long") for i in range(len(columns))]
        sums = [F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in zip((seen, *matched), ("n_rows", *named_matches))]
        parts.append(rows.agg(*sums))
    whole = parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])
    counts = whole.agg(*[F.sum(named(c)).alias(c) for c in whole.columns])
    matches = [named(m) for m in named_matches]
    least = matches[0] if len(matches) == 1 else F.least(*matches)
    return counts.withColumn("min_matches", least).withColumn("equal", F.col("min_matches") == F.col("n_rows"))


def frame_differences(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    tolerance: float = 0.0,
    buckets: int = BUCKETS,
) -> DataFrame:
    """The keys under which both tables differ: the keys, ``only_left`` and ``only_right``
    (rows without an equal one on the other side), and ``columns`` that differ, where a
    single row on each side is left to compare. An action: it writes the fingerprints.
    """
    spark = left.sparkSession
    marks = fingerprints(left, right, keys, columns, tolerance, buckets)
    marks = materialize(marks, scratch_folder(spark, "fingerprints"))
    rows = _settled(left, right, keys, columns, tolerance, marks, buckets)
    one_each = (F.col("__over_l") == 1) & (F.col("__over_r") == 1)
    names = [F.when(~F.col(f"__match{i}"), F.lit(c)) for i, c in enumerate(columns)]
    differing = F.when(one_each, F.array_compact(F.array(*names)))
    found = rows.select(
        *[named(k) for k in keys],
        F.col("__over_l").alias("only_left"),
        F.col("__over_r").alias("only_right"),
        differing.alias("columns"),
    )
    # a pair within the tolerance on two sides of an edge is no difference
    return found.where("(only_left > 0 OR only_right > 0) AND (columns IS NULL OR size(columns) > 0)")
