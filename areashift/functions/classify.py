"""Labels derived from values."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from areashift.functions.aggregates import as_column, clean


def majority_class(
    shares: Mapping[str, Column | str], threshold: float = 50.0, default: str = "none"
) -> Column:
    """Label of the first share strictly above the threshold, in mapping order.

    An unknown share never wins.
    """
    branches = F
    for label, share in shares.items():
        branches = branches.when(clean(share) > threshold, F.lit(label))
    return branches.otherwise(F.lit(default))


def recode(c: Column | str, labels: Mapping[str, str]) -> Column:
    """Display label of a code; a code without one becomes NULL."""
    branches = F
    for code, label in labels.items():
        branches = branches.when(as_column(c) == code, F.lit(label))
    return branches.otherwise(F.lit(None).cast("string"))
