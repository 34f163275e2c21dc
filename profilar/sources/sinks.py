"""Writers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from profilar.operators.ordered import sequence_in_group


def write_csv(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_csv_per_key(df: DataFrame, path: str, key: str, *, row_names: Sequence[str] | None = None,
                      mode: str = "errorifexists") -> None:
    """One folder per key. ``row_names`` gives the order for a leading row-number column."""
    if row_names is not None:
        rest = [c for c in df.columns if c != key]
        numbered = sequence_in_group(df, [key], list(row_names), out="row")
        df = numbered.select(key, "row", *rest)
    df.write.mode(mode).partitionBy(key).option("header", True).csv(path)


def write_results(frames: Mapping[str, DataFrame], folder: str, *, mode: str = "errorifexists") -> None:
    """Each result frame as a parquet table of its own."""
    for name, df in frames.items():
        df.write.mode(mode).parquet(f"{folder.rstrip('/')}/{name}")
