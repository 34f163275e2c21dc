"""Shares, weights and scalings. Totals are aggregated and joined back, never windowed,
so that a key owning much of the table is summed map-side first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilar.functions.nulls import ratio, summary
from profilar.operators.joins import match


def share_of_total(df: DataFrame, keys: Sequence[str], value: str, out: str = "prop",
                   na: str = "propagate", scale: float = 1.0) -> DataFrame:
    """value / total over ``keys``; NULL where the total is zero."""
    totals = df.groupBy(*keys).agg(summary(F.sum, value, na).alias("__total"))
    share = ratio(value, "__total")
    return (
        match(df, totals, keys, "left")
        .withColumn(out, share if scale == 1.0 else share * F.lit(scale))
        .drop("__total")
    )


def share_report(df: DataFrame, *, within: Sequence[str], by: Sequence[str], value: str,
                 labels: Sequence[str] | None = None, label: str = "grp") -> DataFrame:
    """Share within a sample, then its mean by ``by``; optionally only for some labels."""
    shares = share_of_total(df, within, value)
    report = shares.groupBy(*by).agg(summary(F.avg, "prop").alias("prop"))
    return report if labels is None else report.where(F.col(label).isin(list(labels)))


def area_share(df: DataFrame, *, file_key: str, window: str, excluded: str, value: str,
               carry: Sequence[str] = (), out: str = "ave_area_prop") -> DataFrame:
    """Percent of a file's total over samples, with one excluded window forced to 0."""
    per_window = df.groupBy(file_key, window, *carry).agg(F.sum(value).alias("__tot"))
    totals = (
        per_window.where(F.col(window) != excluded)
        .groupBy(file_key)
        .agg(F.sum("__tot").alias("__all"))
    )
    joined = match(per_window, totals, [file_key], "left")
    share = F.when(F.col(window) == excluded, F.lit(0.0)).otherwise(ratio(F.col("__tot") * 100, "__all"))
    return joined.select(file_key, window, *carry, share.alias(out))


def row_total(columns: Sequence[str]) -> Column:
    """Sum over columns of one row; NULL if any part is."""
    total = F.col(columns[0])
    for c in columns[1:]:
        total = total + F.col(c)
    return total


def row_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Divide listed columns by their row total."""
    total = row_total(columns)
    return df.withColumns({c: ratio(F.col(c), total) for c in columns})


def hellinger(df: DataFrame, columns: Sequence[str], prefix: str = "") -> DataFrame:
    """Square root of the row share of each listed column."""
    total = row_total(columns)
    return df.withColumns({prefix + c: F.sqrt(ratio(F.col(c), total)) for c in columns})


def equal_weight(df: DataFrame, keys: Sequence[str], out: str = "wi2") -> DataFrame:
    """One over the row count of the key."""
    sizes = df.groupBy(*keys).agg((F.lit(1.0) / F.count(F.lit(1))).alias(out))
    return match(df, sizes, keys, "left")


def min_max(df: DataFrame, value: str, out: str, base: float = 0.5, span: float = 3.0) -> DataFrame:
    """base + span·(x−min)/(max−min) over the whole table, by a scalar subquery."""
    limits = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("s")).scalar()
    return df.withColumn(
        out, F.lit(base) + F.lit(span) * ratio(F.col(value) - limits["lo"], limits["hi"] - limits["lo"])
    )


def difference_from_control(df: DataFrame, *, by: Sequence[str], treatment: str, control: str,
                            value: str, out: str, na: str = "propagate") -> DataFrame:
    """Treated rows with value minus the mean control value of their key."""
    base = (
        df.where(F.col(treatment) == control)
        .groupBy(*by)
        .agg(summary(F.avg, value, na).alias("__base"))
    )
    treated = df.where(F.col(treatment) != control)
    return (
        match(treated, base, by, "left")
        .withColumn(out, F.col(value) - F.col("__base"))
        .drop("__base")
    )
