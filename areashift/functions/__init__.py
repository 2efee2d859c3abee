"""Column-to-column building blocks: built-in expressions only, no Python UDFs."""

from areashift.functions.aggregates import (
    allocate_sum,
    clean,
    exact_sum,
    strict_sum,
    total,
    weighted_mean,
)
from areashift.functions.classify import majority_class, recode
from areashift.functions.codes import (
    has_level,
    key_prefix,
    normalize_code,
    split_code,
    strip_parenthetical,
    strip_prefix,
    to_number,
)
from areashift.functions.shares import complement_share, residual_share

__all__ = [
    "allocate_sum",
    "exact_sum",
    "clean",
    "complement_share",
    "has_level",
    "key_prefix",
    "majority_class",
    "normalize_code",
    "recode",
    "residual_share",
    "split_code",
    "strict_sum",
    "strip_parenthetical",
    "strip_prefix",
    "to_number",
    "total",
    "weighted_mean",
]
