"""Wide and long forms, column sets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def starting_with(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def containing(df: DataFrame, text: str) -> list[str]:
    return [c for c in df.columns if text in c]


def between(df: DataFrame, first: str, last: str) -> list[str]:
    """Columns from ``first`` to ``last`` in schema order."""
    cols = df.columns
    return cols[cols.index(first): cols.index(last) + 1]


def front_then_rest(df: DataFrame, *front: str) -> list[str]:
    return [*front, *[c for c in df.columns if c not in front]]


def from_position(df: DataFrame, start: int) -> list[str]:
    """Columns from a zero-based position on."""
    return df.columns[start:]


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "variable",
            value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def to_wide(df: DataFrame, ids: Sequence[str], name: str, value: str, levels: Sequence[str],
            fill: float | None = None, agg: Callable[[str], Column] = F.first) -> DataFrame:
    """One column per level. Absent levels are NULL, or ``fill``."""
    wide = df.groupBy(*ids).pivot(name, list(levels)).agg(agg(value))
    return wide if fill is None else wide.fillna(fill, subset=list(levels))


def map_columns(df: DataFrame, fn: Callable[[str], Column], *, columns: Sequence[str] | None = None,
                dtype: str | None = None) -> DataFrame:
    """Apply one expression to many columns, chosen by name or by type."""
    chosen = set(columns if columns is not None else df.columns)
    if dtype is not None:
        chosen &= {name for name, t in df.dtypes if t == dtype}
    return df.select([fn(c).alias(c) if c in chosen else F.col(c) for c in df.columns])


def rename(df: DataFrame, **new_to_old: str) -> DataFrame:
    return df.withColumnsRenamed({old: new for new, old in new_to_old.items()})
