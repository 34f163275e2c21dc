"""Grouped statistics."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilar.functions.nulls import col_of, summary
from profilar.operators.joins import match, union_padded
from profilar.operators.ordered import quantiles


def standard_error(c: str | Column) -> Column:
    """Sample SD over the root of the non-missing count."""
    return F.stddev_samp(c) / F.sqrt(F.count(c))


def least_nonzero(c: str | Column) -> Column:
    c = col_of(c)
    return F.min(F.when(c != 0, c))


STATISTICS: dict[str, Callable[[str], Column]] = {
    "M": F.avg,
    "N": F.count,
    "SD": F.stddev_samp,
    "SE": standard_error,
    "SUM": F.sum,
    "MIN": F.min,
    "MAX": F.max,
    "MIN0": least_nonzero,
}


def summarise(df: DataFrame, keys: Sequence[str], columns: Sequence[str], stats: Sequence[str],
              na: str = "propagate") -> DataFrame:
    """Named statistics of several columns: ``M`` for one column, ``x_M`` for several.

    ``N`` counts non-missing values whatever the rule.
    """
    out = []
    for c in columns:
        for s in stats:
            name = s if len(columns) == 1 else f"{c}_{s}"
            fn = STATISTICS[s]
            out.append((fn(c) if s == "N" else summary(fn, c, na)).alias(name))
    return df.groupBy(*keys).agg(*out)


def count_rows(df: DataFrame, keys: Sequence[str], out: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def contingency(df: DataFrame, row: str, column: str, levels: Sequence[str]) -> DataFrame:
    return df.groupBy(row).pivot(column, list(levels)).agg(F.count(F.lit(1))).fillna(0, subset=list(levels))


def uniqueness(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, distinct keys, and whether no key repeats."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return per_key.agg(
        F.sum("__n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_keys"),
        (F.max("__n") <= 1).alias("is_unique"),
    )


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    if not uniqueness(df, keys).first()["is_unique"]:
        raise ValueError(f"key {list(keys)} repeats")
    return df


def nonempty_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.count(F.when(F.col(c) != "", 1)).alias(c) for c in columns])


def box_statistics(df: DataFrame, keys: Sequence[str], value: str, *, exact: bool = True) -> DataFrame:
    """Quartiles, whisker ends within 1.5 interquartile ranges, and outlier count per key."""
    box = quantiles(df, keys, value, [0.25, 0.5, 0.75], ["q1", "median", "q3"], exact=exact)
    limits = box.withColumns({
        "__lo": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")),
        "__hi": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")),
    })
    present = df.where(F.col(value).isNotNull())
    inside = F.col(value).between(F.col("__lo"), F.col("__hi"))
    ends = (
        match(present.select(*keys, value), limits, keys, "inner")
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.when(inside, F.col(value))).alias("lower_whisker"),
            F.max(F.when(inside, F.col(value))).alias("upper_whisker"),
            F.count(F.when(~inside, 1)).alias("n_outliers"),
        )
    )
    return match(box, ends, keys, "inner")


def box_outliers(df: DataFrame, keys: Sequence[str], value: str, *, exact: bool = True) -> DataFrame:
    """The rows beyond the whiskers."""
    box = quantiles(df, keys, value, [0.25, 0.75], ["__q1", "__q3"], exact=exact)
    reach = 1.5 * (F.col("__q3") - F.col("__q1"))
    joined = match(df.where(F.col(value).isNotNull()), box, keys, "inner")
    beyond = (F.col(value) < F.col("__q1") - reach) | (F.col(value) > F.col("__q3") + reach)
    return joined.where(beyond).drop("__q1", "__q3")


def row_of_extreme(df: DataFrame, by: str, keys: Sequence[str] = (), which: str = "max") -> DataFrame:
    """The whole row with the greatest or least value; ties go to the least row key order."""
    whole = F.struct(*df.columns)
    fn = F.max_by if which == "max" else F.min_by
    return df.where(F.col(by).isNotNull()).groupBy(*keys).agg(fn(whole, F.col(by)).alias("r")).select("r.*")


def peek(df: DataFrame, key: str, n: int = 10, seed: int = 0) -> DataFrame:
    """A seeded handful of rows for inspection."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key))), F.col(key)).limit(n)


def dictionary(frames: Mapping[str, DataFrame], label: str, group: str) -> DataFrame:
    """Distinct (label, group) pairs over all lists, sorted by group then label."""
    pairs = [f.select(label, group) for f in frames.values()]
    return union_padded(*pairs).distinct().orderBy(group, label)
