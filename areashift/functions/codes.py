"""Fixed-width identifier codes and the labels around them. Codes are always strings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from areashift.functions.aggregates import as_column, clean


def normalize_code(c: Column | str, width: int, on_long: str = "error") -> Column:
    """Zero-pad a code to ``width``; NULL and blank stay NULL.

    A code longer than ``width`` cannot be padded: it raises, or becomes NULL with
    ``on_long="null"``.
    """
    code = F.nullif(F.trim(as_column(c).cast("string")), F.lit(""))
    if on_long == "error":
        refused = F.raise_error(F.concat(F.lit(f"code longer than {width} characters: "), code))
    elif on_long == "null":
        refused = F.lit(None)
    else:
        raise ValueError(f"on_long must be 'error' or 'null', not {on_long!r}")
    return F.when(F.length(code) > width, refused.cast("string")).otherwise(
        F.lpad(code, width, "0")
    )


def split_code(c: Column | str, cuts: Sequence[int], names: Sequence[str]) -> list[Column]:
    """Pieces of a code cut after the given character positions, the last to the end."""
    if len(names) != len(cuts) + 1:
        raise ValueError("split_code needs one more name than cuts")
    starts = [0, *cuts]
    code = as_column(c)
    pieces = [F.substring(code, s + 1, e - s) for s, e in zip(starts, cuts)]
    pieces.append(F.substr(code, F.lit(starts[-1] + 1)))
    return [piece.alias(name) for piece, name in zip(pieces, names)]


def key_prefix(c: Column | str, length: int) -> Column:
    """First ``length`` characters: the parent's code inside a nested code."""
    return F.substring(as_column(c), 1, length)


def strip_prefix(c: Column | str, prefix: str) -> Column:
    """Drop a leading literal, leaving values without it alone."""
    code = as_column(c)
    return F.when(code.startswith(prefix), F.substr(code, F.lit(len(prefix) + 1))).otherwise(code)


def strip_parenthetical(c: Column | str) -> Column:
    """Remove every ``(...)`` with the blanks before it."""
    return F.regexp_replace(as_column(c), r"\s*\([^\)]+\)", "")


def has_level(c: Column | str, marker: str) -> Column:
    """Whether a full identifier carries the marker of a summary level."""
    return as_column(c).contains(marker)


def to_number(c: Column | str) -> Column:
    """Text as a double; text that is not a number becomes NULL.

    The JVM parser also takes a type suffix ("1d", "2.5f"); those are not numbers here.
    """
    text = as_column(c).cast("string")
    return F.when(~text.rlike(r"[0-9.][dDfF]\s*$"), clean(text.try_cast("double")))
