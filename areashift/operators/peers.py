"""Attach units to groups and keep the groups to compare."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areashift.operators.joins import left_join, named


def top_k(rows: DataFrame, measure: str, k: int, tiebreak: str) -> DataFrame:
    """The ``k`` rows with the largest measure, missing last, ties by ``tiebreak``."""
    return rows.orderBy(F.desc_nulls_last(f"`{measure}`"), F.asc(f"`{tiebreak}`")).limit(k)


def assign_groups(
    units: DataFrame, lookup: DataFrame, unit_key: str, lookup_key: str
) -> DataFrame:
    """Every unit with each of its groups.

    The lookup may name several groups for a key; such a unit comes once per group.
    A unit without a group stays, its group columns NULL.
    """
    return left_join(units, lookup, [(unit_key, lookup_key)])


def focus(rows: DataFrame, group: str, label: str) -> DataFrame:
    """The rows of one group."""
    return rows.where(named(group) == label)


def first_codes(rows: DataFrame, code: str, n: int) -> DataFrame:
    """The first ``n`` distinct codes in code order."""
    return rows.select(named(code)).distinct().orderBy(F.asc_nulls_last(f"`{code}`")).limit(n)


def partition_union(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of all parts, columns matched by name, absent ones NULL."""
    whole, *rest = parts
    for part in rest:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole
