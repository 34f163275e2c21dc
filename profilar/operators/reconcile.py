"""Comparing compound lists between sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilar.functions.nulls import not_in
from profilar.functions.scalar import blank_if_missing, round_half_even
from profilar.operators.ordered import sequence_in_group
from profilar.operators.reshape import map_columns


def label_matrix(lists: DataFrame, sources: Sequence[str], *, source: str = "source", key: str = "comp",
                 label: str = "grp", skip: Sequence[str] = ("unk",)) -> DataFrame:
    """One row per compound, one column of labels per source.

    Labels are made distinct per compound and source first, so the gathered
    lists are as short as the label vocabulary however often a compound occurs.
    """
    distinct = lists.where(not_in(label, skip)).select(source, key, label).distinct()
    return (
        distinct.groupBy(key)
        .pivot(source, list(sources))
        .agg(F.array_join(F.array_sort(F.collect_set(label)), "|"))
    )


def disagreeing(lists: DataFrame, *, key: str = "comp", label: str = "grp",
                skip: Sequence[str] = ("unk",)) -> DataFrame:
    """Compounds that carry more than one label over all sources.

    All pairs of labels agree exactly when there is one distinct label, so no
    pairs are formed.
    """
    distinct = lists.where(not_in(label, skip)).select(key, label).distinct()
    return distinct.groupBy(key).agg(F.count(F.lit(1)).alias("n_labels")).where("n_labels > 1")


def disagreement_report(lists: DataFrame, sources: Sequence[str], **names) -> DataFrame:
    key = names.get("key", "comp")
    return label_matrix(lists, sources, **names).join(
        disagreeing(lists, **{k: v for k, v in names.items() if k != "source"}), key)


def align_by_time(lists: DataFrame, sources: Sequence[str], *, source: str, time: str, order: str,
                  values: Sequence[str]) -> DataFrame:
    """Full outer alignment of lists on rounded retention time and repeat number.

    (time, repeat) is unique within a source, so a union and pivot equals the
    chain of outer joins. Missing cells become blank text.
    """
    rounded = lists.withColumn("rt", round_half_even(time))
    numbered = sequence_in_group(rounded, [source, "rt"], [order], out="rep")
    wide = numbered.groupBy("rt", "rep").pivot(source, list(sources)).agg(
        *[F.first(v, ignorenulls=True).alias(v) for v in values]
    )
    if len(values) == 1:
        wide = wide.withColumnsRenamed({s: f"{s}_{values[0]}" for s in sources})
    cells = [c for c in wide.columns if c not in ("rt", "rep")]
    return map_columns(wide, blank_if_missing, columns=cells)
