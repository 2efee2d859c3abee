"""Keyed joins with missing-key and name-collision rules.

Keys match NULL to NULL by default (``<=>``). Spark runs that as an equi-join, and
gives each side its own exchange instead of reusing one a previous aggregate left
behind; that is the shape in which adaptive execution can split a hot key of the left
side. No join carries a broadcast hint: Spark broadcasts a side when its measured size
is under ``spark.sql.autoBroadcastJoinThreshold`` and sorts and merges otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areashift.session import scratch_folder

Keys = Sequence[str | tuple[str, str]]
#: Chosen keys: a list, or the first column of a table; None for all.
Chosen = Sequence | DataFrame | None
#: A list up to this length is compared as literals, which the scan checks by row group.
LITERALS = 50


def named(name: str) -> Column:
    """Column by its literal name, which may hold blanks or dots."""
    return F.col(f"`{name}`")


def key_pairs(keys: Keys) -> list[tuple[str, str]]:
    return [(k, k) if isinstance(k, str) else k for k in keys]


def suffix_collisions(
    left: DataFrame, right: DataFrame, keys: Keys, suffixes: tuple[str, str]
) -> tuple[DataFrame, DataFrame]:
    """Give non-key columns present on both sides the two suffixes; others keep bare names."""
    pairs = key_pairs(keys)
    left_rest = [c for c in left.columns if c not in {a for a, _ in pairs}]
    right_rest = [c for c in right.columns if c not in {b for _, b in pairs}]
    shared = [c for c in left_rest if c in set(right_rest)]
    return (
        left.withColumnsRenamed({c: c + suffixes[0] for c in shared}),
        right.withColumnsRenamed({c: c + suffixes[1] for c in shared}),
    )


def keyed_join(
    left: DataFrame, right: DataFrame, keys: Keys, how: str, null_safe: bool = True
) -> DataFrame:
    """Join on keys that may be named differently, keeping one copy under the left name."""
    pairs = key_pairs(keys)
    aside = {right_key: f"__key_{i}" for i, (_, right_key) in enumerate(pairs)}
    right = right.withColumnsRenamed(aside)
    equals = "<=>" if null_safe else "="
    condition = F.expr(" AND ".join(f"`{a}` {equals} `{aside[b]}`" for a, b in pairs))
    if how in ("left_semi", "left_anti"):
        return left.join(right, condition, how)

    left_columns = left.columns
    right_columns = [c for c in right.columns if c not in aside.values()]
    seen = {c.lower() for c in left_columns}
    clashes = [c for c in right_columns if c.lower() in seen]
    if clashes:
        raise ValueError(f"both sides have {clashes}; rename or use suffix_collisions first")

    joined = left.join(right, condition, how)
    if how in ("full", "right"):
        either = {a: F.expr(f"coalesce(`{a}`, `{aside[b]}`)") for a, b in pairs}
        joined = joined.withColumns(either)
    return joined.drop(*aside.values())


def full_join(left: DataFrame, right: DataFrame, keys: Keys, null_safe: bool = True) -> DataFrame:
    """Every unit of either side.

    A full join cannot be split on a hot key, so keys should be unique on both sides;
    ``operators.interpolate.attach_attributes`` is the form for a many side.
    """
    return keyed_join(left, right, keys, "full", null_safe)


def left_join(left: DataFrame, right: DataFrame, keys: Keys, null_safe: bool = True) -> DataFrame:
    """Every row of the left side with the matches of the right."""
    return keyed_join(left, right, keys, "left", null_safe)


def restrict_to(rows: DataFrame, column: str, members: DataFrame, member: str) -> DataFrame:
    """Rows whose value is among the members. A missing value is never a member."""
    return keyed_join(rows, members.select(member), [(column, member)], "left_semi", False)


def chosen_keys(rows: DataFrame, column: str, chosen: Chosen) -> Chosen:
    """A long list as a table of keys, written to the shared folder; others as they are.

    The list goes to the JVM as Arrow data, and plans hold a path, so neither building nor
    planning grows with it. Reading the table asks for its own range of keys: Spark hands
    that range on to the large side and its scan, and as the range makes the table selective,
    adds a Bloom filter of its keys there where neither side is small enough to broadcast.
    """
    if chosen is None or isinstance(chosen, DataFrame) or len(chosen) <= LITERALS:
        return chosen
    spark = rows.sparkSession
    keys = pa.table({"member": pc.drop_null(pc.unique(pa.array(chosen, from_pandas=True)))})
    kind = rows.select(named(column)).schema[0].dataType
    listed = spark.createDataFrame(keys).select(F.col("member").cast(kind).alias("member"))
    path = scratch_folder(spark, "members")
    listed.coalesce(1).write.mode("overwrite").parquet(path)
    bounds = pc.min_max(keys["member"]).as_py()
    member = F.col("member")
    in_range = (member >= F.lit(bounds["min"]).cast(kind)) & (member <= F.lit(bounds["max"]).cast(kind))
    stored = spark.read.schema(listed.schema).parquet(path)
    # of text cast to another type the bounds would be those of the text
    same = listed.schema[0].dataType == spark.createDataFrame(keys.slice(0, 1)).schema[0].dataType
    return stored.where(in_range) if same else stored


def among(rows: DataFrame, column: str, chosen: Chosen) -> DataFrame:
    """Rows whose key is chosen; all of them where ``chosen`` is None. A missing key never is."""
    if chosen is None:
        return rows
    if not isinstance(chosen, DataFrame):
        if len(chosen) <= LITERALS:
            return rows.where(named(column).isin(list(chosen)))
        chosen = chosen_keys(rows, column, chosen)
    return restrict_to(rows, column, chosen, chosen.columns[0])
