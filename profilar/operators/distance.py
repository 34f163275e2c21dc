"""Dissimilarity to a bounded set of anchor profiles, principal coordinates, stress.

All pairs of rows are never formed. Distances run from every row to anchors: a
set whose size is checked, such as all rows of a small table or the centroids
of groups. Work and output are linear in the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilar.functions.linalg import descending_eigen
from profilar.functions.nulls import ratio
from profilar.operators.monotone import rising_fit

MAX_ANCHORS = 2_000


def _metric(name: str):
    def bray(x, a):
        with np.errstate(invalid="ignore", divide="ignore"):  # two empty profiles have no distance
            return np.stack([np.abs(x - r).sum(1) / (x + r).sum(1) for r in a], axis=1)

    def euclid(x, a):
        return np.stack([np.sqrt(((x - r) ** 2).sum(1)) for r in a], axis=1)

    return {"bray": bray, "euclidean": euclid}[name]


def collect_anchors(anchors: DataFrame, key: str, columns: Sequence[str],
                    most: int = MAX_ANCHORS) -> tuple[list, np.ndarray]:
    """Complete anchor keys and profiles, held by every task; an error beyond ``most``, their allowed number."""
    rows = anchors.select(key, *columns).dropna().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} anchors; use group centroids")
    rows = sorted(rows, key=lambda r: r[0])
    return [r[0] for r in rows], np.array([[float(r[c]) for c in columns] for r in rows])


def to_anchors(df: DataFrame, key: str, columns: Sequence[str], anchors: DataFrame, anchor_key: str,
               metric: str = "bray") -> DataFrame:
    """(key, anchor, d) for every complete row and every anchor.

    Anchors travel with the tasks, so nothing is shuffled.
    """
    return several_to_anchors(df, key, anchors, anchor_key, {"d": (columns, metric)})


def several_to_anchors(df: DataFrame, key: str, anchors: DataFrame, anchor_key: str,
                       measures: Mapping[str, tuple[Sequence[str], str]]) -> DataFrame:
    """Several distances between the same rows and anchors in one pass.

    ``measures`` maps an output to (columns, metric); rows and anchors carry all columns.
    """
    needed = list(dict.fromkeys(c for columns, _ in measures.values() for c in columns))
    names, matrix = collect_anchors(anchors, anchor_key, needed)
    kinds = df.select(key).schema[0].dataType.simpleString(), anchors.select(anchor_key).schema[0].dataType.simpleString()
    parts = {out: ([needed.index(c) for c in columns], _metric(metric)) for out, (columns, metric) in measures.items()}

    @F.pandas_udf(", ".join(f"{n} array<double>" for n in measures))
    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[needed].to_numpy(dtype=float)
            found = {name: [] for name in parts}
            for start in range(0, len(x), 2000):
                for name, (at, measure) in parts.items():
                    found[name].extend(measure(x[start:start + 2000][:, at], matrix[:, at]))
            yield pd.DataFrame(found)

    # keys stay with Spark: beside a NULL they would be rounded in pandas
    rows = df.select(key, *needed).dropna()
    each = rows.select(F.col(key).alias("__key"), measured(F.struct(*needed)).alias("__m"))
    held = F.array(*[F.lit(n).cast(kinds[1]) for n in names]) if names else F.array().cast(f"array<{kinds[1]}>")
    zipped = F.arrays_zip(held.alias("anchor"), *[F.col(f"__m.{n}").alias(n) for n in measures])
    out = each.select("__key", F.explode(zipped).alias("__at"))
    distances = [F.when(~F.isnan(f"__at.{n}"), F.col(f"__at.{n}")).alias(n) for n in measures]
    return out.select(F.col("__key").alias(key), F.col("__at.anchor").alias("anchor"), *distances)


def group_profiles(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Mean profile of every group: anchors that use all rows."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(*[F.avg(c).alias(c) for c in columns])


def principal_coordinates(df: DataFrame, key: str, columns: Sequence[str], anchors: DataFrame, anchor_key: str,
                          metric: str = "bray", k: int = 3, keep: Sequence[str] = ()) -> tuple[DataFrame, np.ndarray]:
    """Classical scaling of the anchors, with every row placed by its distances to them.

    With all rows as anchors this is the full classical scaling. Returns row
    coordinates Axis1 … Axisk (beside the ``keep`` columns) and the anchor eigenvalues.
    """
    names, matrix = collect_anchors(anchors, anchor_key, columns)
    columns = list(columns)
    measure = _metric(metric)
    squared = measure(matrix, matrix) ** 2
    centre = np.eye(len(names)) - 1.0 / len(names)
    values, vectors = descending_eigen(-0.5 * centre @ squared @ centre)
    k = min(k, len(values))
    top, mean_squared = vectors[:, :k] / np.sqrt(values[:k]), squared.mean(axis=0)
    axes = [f"Axis{i + 1}" for i in range(k)]

    @F.pandas_udf(", ".join(f"{a} double" for a in axes))
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[columns].to_numpy(dtype=float)
            coords = [np.zeros((0, k))]
            for start in range(0, len(x), 2000):
                d2 = measure(x[start:start + 2000], matrix) ** 2
                centred = -0.5 * (d2 - mean_squared)
                coords.append((centred - centred.mean(axis=1, keepdims=True)) @ top)
            yield pd.DataFrame(np.concatenate(coords), columns=axes)

    kept = [key, *keep]  # stay with Spark: beside a NULL, large keys would be rounded in pandas
    rows = df.select(*dict.fromkeys([*kept, *columns])).dropna(subset=columns)
    placed = rows.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(kept)], place(F.struct(*columns)).alias("__at"))
    return placed.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(kept)], "__at.*"), values


def stress(pairs: DataFrame, dissimilarity: str, distance: str, digits: int | None = None) -> DataFrame:
    """Stress of the best rising fit of ordination distance on dissimilarity.

    ``digits`` rounds dissimilarities beforehand. Pairs without both values are left out.
    """
    level = F.col(dissimilarity) if digits is None else F.round(dissimilarity, digits)
    pools = rising_fit(pairs, level, distance)
    lost = F.sum(F.col("square") - F.col("s") * F.col("fitted"))
    return pools.agg(F.sum("w").cast("bigint").alias("n_pairs"),
                     F.sqrt(F.greatest(lost, F.lit(0.0)) / F.sum("square")).alias("stress"))


def eigenvalue_table(df: DataFrame, values: np.ndarray) -> DataFrame:
    """Scaling eigenvalues with each axis's share of the positive ones."""
    positive = float(values[values > 0].sum())
    rows = [(i + 1, float(x), float(x) / positive if positive else None) for i, x in enumerate(values)]
    return df.sparkSession.createDataFrame(rows, "axis int, eigenvalue double, share double")


def column_scores(points: DataFrame, columns: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """Weighted average of the rows' coordinates for each column (its values are the weights): one aggregation."""
    sums = [F.sum(F.col(c) * F.col(a)).alias(f"{i}_{j}") for i, c in enumerate(columns) for j, a in enumerate(axes)]
    row = points.agg(*sums, *[F.sum(c).alias(f"w{i}") for i, c in enumerate(columns)])
    cells = [F.struct(F.lit(c).alias("component"), *[ratio(f"{i}_{j}", f"w{i}").alias(a) for j, a in enumerate(axes)])
             for i, c in enumerate(columns)]
    return row.select(F.inline(F.array(*cells)))
