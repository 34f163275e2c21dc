"""Missing-value rules that differ from plain SQL, each as a small column helper."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_in(c: str | Column, values: Iterable) -> Column:
    """Membership that is FALSE, never NULL, for a missing value."""
    return F.coalesce(col_of(c).isin(list(values)), F.lit(False))


def not_in(c: str | Column, values: Iterable) -> Column:
    """Non-membership that keeps missing values."""
    return F.coalesce(~col_of(c).isin(list(values)), F.lit(True))


def if_else(condition: Column, yes, no) -> Column:
    """Two-way choice that is NULL when the condition is NULL."""
    return F.when(condition, yes).when(~condition, no)


def paste(*cols: str | Column, sep: str = "_") -> Column:
    """Concatenate, writing missing parts as the text NA."""
    return F.concat_ws(sep, *[F.coalesce(col_of(c).cast("string"), F.lit("NA")) for c in cols])


def ratio(a: str | Column, b: str | Column) -> Column:
    """Quotient that is NULL for a zero denominator, also in ANSI mode."""
    return F.try_divide(col_of(a).cast("double"), col_of(b).cast("double"))


def log_of(c: str | Column) -> Column:
    """Natural log; NULL outside the positive range."""
    return F.ln(col_of(c))


def summary(fn, c: str | Column, na: str = "propagate") -> Column:
    """Apply an aggregate under a missing-value rule.

    ``propagate`` gives NULL as soon as one input is missing, ``skip`` ignores missing input.
    """
    c = col_of(c)
    if na == "skip":
        return fn(c)
    if na != "propagate":
        raise ValueError("na must be 'propagate' or 'skip'")
    return F.when(F.count(F.lit(1)) == F.count(c), fn(c))


def shared_keys(left: DataFrame, right: DataFrame, expected: Sequence[str]) -> list[str]:
    """Columns both sides share; an error if they are not exactly the expected key."""
    found = [c for c in left.columns if c in set(right.columns)]
    if set(found) != set(expected):
        raise ValueError(f"shared columns {sorted(found)} differ from the expected key {sorted(expected)}")
    return list(expected)


def tidy(c: str | Column, digits: int = 6) -> Column:
    """Round a computed double for stable comparison (no negative zero)."""
    return F.round(col_of(c).cast("double"), digits) + F.lit(0.0)
