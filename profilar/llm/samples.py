"""Bounded samples by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def least_hashed(df: DataFrame, hashed: Column, rows: int) -> DataFrame:
    """At most ``rows`` rows, those of least hash.

    Rows whose hash is beyond what a quarter more than ``rows`` rows lie below are left out first, so that the tasks together, not each of
    them, send about ``rows`` rows to the final choice. Hashes should be of different values.
    """
    share = min(1.0, 1.25 * rows / max(1, df.count()))
    place = F.shiftrightunsigned(hashed, 11).cast("double") * 2.0 ** -53
    return df.withColumn("__place", place).where(F.col("__place") < share).orderBy("__place").limit(rows).drop("__place")
