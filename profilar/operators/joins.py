"""Joins and unions.

No side is ever broadcast by hint: the runtime picks a broadcast only when the
measured size is under its threshold, and splits skewed partitions otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilar.functions.nulls import shared_keys


def match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left",
          null_safe: bool = True) -> DataFrame:
    """Equi-join on shared names, keeping one copy of each key.

    With ``null_safe`` a missing key matches a missing key. Keys that cannot be
    NULL use plain equality so that the join keeps its partitioning by the key.
    """
    keys = list(keys)
    if how in ("left_semi", "left_anti"):
        aliased = right.select([F.col(k).alias(f"__r_{k}") for k in keys])
    else:
        aliased = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    nullable = null_safe and any(left.schema[k].nullable and right.schema[k].nullable for k in keys)
    if not nullable:
        return left.join(right.select(keys) if how in ("left_semi", "left_anti") else right, keys, how)
    condition: Column = reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(aliased[f"__r_{k}"]) for k in keys]
    )
    return left.join(aliased, condition, how).drop(*[f"__r_{k}" for k in keys])


def natural_left(left: DataFrame, right: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Left join on every shared column name, which must be exactly ``expected``."""
    return match(left, right, shared_keys(left, right, expected), "left")


def annotate(fact: DataFrame, dimension: DataFrame, keys: Sequence[str] = ("site", "window")) -> DataFrame:
    """Attach annotation columns; rows without annotation stay with NULLs."""
    return match(fact, dimension, keys, "left")


def control_baseline(cells: DataFrame, *, by: Sequence[str], treatment: str, control: str,
                     values: Mapping[str, str], keep_control: bool = False) -> DataFrame:
    """Attach the control row's values to every treated row of the same site.

    ``cells`` holds one row per site and treatment, so the control side has at
    most one row per ``by`` key. ``values`` maps a column to its baseline name.
    """
    baseline = cells.where(F.col(treatment) == control).select(
        *by, *[F.col(c).alias(out) for c, out in values.items()]
    )
    kept = cells if keep_control else cells.where(F.col(treatment) != control)
    return match(kept, baseline, by, "left")


def replicate_control(df: DataFrame, *, site: str, treatment: str, control: str, label: str,
                      out: str) -> DataFrame:
    """Repeat a site's control rows once per treated level, then add the treated rows.

    ``label`` names the treated level. The join multiplies control rows only by
    the number of treated levels in their own site.
    """
    treated = df.where(F.col(treatment) != control).withColumn(out, F.concat_ws("_", site, label))
    levels = treated.select(site, out).distinct()
    copies = df.where(F.col(treatment) == control).join(levels, site)
    return copies.unionByName(treated)


def outer_by_source(frames: Mapping[str, DataFrame], keys: Sequence[str], value: str) -> DataFrame:
    """Full outer merge of many lists on a key unique within each list.

    A union and one pivot: a single shuffle in place of a chain of joins.
    """
    stacked = union_tagged(frames, "source")
    return stacked.groupBy(*keys).pivot("source", list(frames)).agg(F.first(value, ignorenulls=True))


def outer_chain(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The literal chain of full outer joins, for lists that must multiply on repeated keys."""
    return reduce(lambda a, b: a.join(b, list(keys), "full"), frames)


def keep_listed(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on), list(on), "left_semi")


def drop_listed(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on), list(on), "left_anti")


def union_padded(*frames: DataFrame) -> DataFrame:
    """Stack by name; columns absent on one side become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_strict(*frames: DataFrame) -> DataFrame:
    """Stack by name; the column sets must be equal."""
    want = set(frames[0].columns)
    for f in frames[1:]:
        if set(f.columns) != want:
            raise ValueError(f"column sets differ: {sorted(want ^ set(f.columns))}")
    return reduce(lambda a, b: a.unionByName(b), frames)


def union_tagged(frames: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """Stack named frames with the name in a column."""
    return union_padded(*[f.withColumn(tag, F.lit(name)) for name, f in frames.items()])
