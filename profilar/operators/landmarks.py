"""Landmarks that cover a table, and non-metric scaling on them.

Landmarks are chosen farthest first: each is the row with the greatest distance to those before it, so that the covering
radius is at most twice the least possible. A pass returns the ``POOL`` farthest rows. While the farthest of them, measured
against landmarks chosen since, still comes before the last one returned, no other row can be farther (distances only fall),
so one pass settles many choices exactly.

Scaling runs on the landmarks, a set of checked size, with restarts dealt out as rows. All other rows are placed by their
dissimilarities to the landmarks, where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilar.functions.linalg import descending_eigen
from profilar.operators.distance import _metric, collect_anchors
from profilar.operators.monotone import pool_blocks

POOL = 1_000
MAX_SCALED = 500


def _measured(metric: str):
    measure = _metric(metric)
    return lambda x, marks: np.nan_to_num(measure(x, marks), nan=0.0)  # two empty profiles are alike


def _with_nearest(df: DataFrame, columns: Sequence[str], marks: np.ndarray, metric: str) -> DataFrame:
    """Rows with ``__d``, the distance to the nearest landmark, and ``__at``, its place (of several, the first)."""
    measure = _measured(metric)

    @F.pandas_udf("d double, at int")
    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf.to_numpy(dtype=float)
            parts = [measure(x[k:k + 2000], marks) for k in range(0, len(x), 2000)] or [np.zeros((0, len(marks)))]
            d = np.concatenate(parts)
            yield pd.DataFrame({"d": d.min(axis=1), "at": d.argmin(axis=1).astype("int32")})

    found = df.withColumn("__n", nearest(F.struct(*columns)))
    return found.select(*df.columns, F.col("__n.d").alias("__d"), F.col("__n.at").alias("__at"))


def farthest_first(df: DataFrame, key: str, columns: Sequence[str], k: int, metric: str = "euclidean",
                   pool: int = POOL) -> DataFrame:
    """Up to ``k`` landmarks: ``step`` from 1, key, ``distance`` to the nearest earlier one (NULL at first), ``columns``.

    The first is the row of least key; of rows equally far the least key is next. Keys should be unique. Rows without a key
    or with a NULL or NaN column take no part. It ends early when every row equals a landmark.
    """
    rows = df.where(F.col(key).isNotNull()).select(key, *[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    measure = _measured(metric)
    chosen = [(r[key], None, [r[c] for c in columns]) for r in rows.orderBy(key).limit(1).collect()]
    while chosen and len(chosen) < k:
        marks = np.array([c[2] for c in chosen])
        far = _with_nearest(rows, columns, marks, metric).where("__d > 0").orderBy(F.desc("__d"), key).limit(pool).collect()
        if not far:
            break
        keys, d = [r[key] for r in far], np.array([r["__d"] for r in far])
        x, last, whole = np.array([[r[c] for c in columns] for r in far]), d[-1], len(far) < pool
        while len(chosen) < k:
            top = min(np.flatnonzero(d == d.max()), key=lambda i: keys[i])
            settled = whole or d[top] > last or (d[top] == last and keys[top] <= keys[-1])
            if not settled or d[top] <= 0:
                break
            chosen.append((keys[top], float(d[top]), list(map(float, x[top]))))
            d = np.minimum(d, measure(x, x[top:top + 1])[:, 0])
    kind = df.select(key).schema[0].dataType.simpleString()
    fields = ", ".join([f"`{key}` {kind}", "distance double", *[f"`{c}` double" for c in columns]])
    table = [(i + 1, name, d, *x) for i, (name, d, x) in enumerate(chosen)]
    return df.sparkSession.createDataFrame(table, "step int, " + fields)


def coverage(df: DataFrame, columns: Sequence[str], landmarks: DataFrame, metric: str = "euclidean") -> DataFrame:
    """``step``, ``n_rows`` and ``radius`` of every landmark: rows nearest to it and the farthest of them."""
    marks = landmarks.orderBy("step").select("step", *columns).limit(MAX_SCALED + 1).collect()
    if len(marks) > MAX_SCALED:
        raise ValueError(f"more than {MAX_SCALED} landmarks")
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    steps = F.array(*[F.lit(r["step"]) for r in marks])
    near = _with_nearest(rows, columns, np.array([[r[c] for c in columns] for r in marks]), metric)
    return near.groupBy(steps[F.col("__at")].alias("step")).agg(F.count(F.lit(1)).alias("n_rows"), F.max("__d").alias("radius"))


# Non-metric scaling ----------------------------------------------------------


@dataclass
class NonMetric:
    """``rows``: key, axes and the row's own ``stress``; ``trials``: restart, steps, stress and its course; ``landmarks``: coordinates."""
    rows: DataFrame
    trials: DataFrame
    names: list
    landmarks: np.ndarray
    stress: float


def _between(points: np.ndarray) -> np.ndarray:
    return np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))


def _disparities(delta: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Best rising fit of distances on dissimilarities; equal dissimilarities may part."""
    order = np.lexsort((d, delta))
    pools = pool_blocks([(0.0, 0.0, 1.0, v, v * v) for v in d[order]])
    out = np.empty_like(d)
    out[order] = np.repeat([s / w for _, _, w, s, _ in pools], [int(w) for _, _, w, _, _ in pools])
    return out


def majorise(delta: np.ndarray, start: np.ndarray, rounds: int = 300, gain: float = 1e-7) -> tuple[np.ndarray, list[float]]:
    """Coordinates and the course of the stress, which never rises.

    Disparities are scaled to one mean square; then each point moves to the minimum of a quadratic above the stress.
    """
    n = len(delta)
    upper = np.triu_indices(n, 1)
    points, course = start - start.mean(axis=0), []
    for _ in range(rounds):
        d = _between(points)
        fitted = _disparities(delta[upper], d[upper])
        fitted *= np.sqrt(len(fitted) / max(float((fitted ** 2).sum()), 1e-300))
        if not course:  # the start has no scale of its own
            scale = float(fitted @ d[upper]) / max(float((d[upper] ** 2).sum()), 1e-300)
            points, d = points * scale, d * scale
        course.append(float(np.sqrt(((fitted - d[upper]) ** 2).mean())))
        if len(course) > 1 and course[-2] - course[-1] < gain:
            break
        pull = np.zeros((n, n))
        pull[upper] = np.divide(fitted, d[upper], out=np.zeros_like(fitted), where=d[upper] > 0)
        pull += pull.T
        points = (np.diag(pull.sum(axis=1)) - pull) @ points / n
    return points, course


def nonmetric_scaling(df: DataFrame, key: str, columns: Sequence[str], landmarks: DataFrame, landmark_key: str,
                      metric: str = "bray", k: int = 2, restarts: int = 20, rounds: int = 300, seed: int = 1) -> NonMetric:
    """Non-metric scaling of at most 500 landmarks, best of several restarts, and of every row by local stress.

    Restart 0 begins at classical scaling, the others at random. Axes are turned to fall in variance. A row moves by the same
    majorisation with the landmarks held, towards distances read from the landmarks' own rising fit, from two starts
    (the mean of its three nearest landmarks, and the centre); the better end counts. Rows with a NULL or NaN column take no part.
    """
    columns = list(columns)
    names, profiles = collect_anchors(landmarks, landmark_key, columns, MAX_SCALED)
    m = len(names)
    if m < k + 2:
        raise ValueError(f"{k} axes need at least {k + 2} landmarks")
    measure = _measured(metric)
    delta = measure(profiles, profiles)
    delta = (delta + delta.T) / 2

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf["id"]:
                start = np.random.default_rng([seed, r]).normal(size=(m, k))
                if r == 0:
                    centre = np.eye(m) - 1.0 / m
                    values, vectors = descending_eigen(-0.5 * centre @ delta ** 2 @ centre, k)
                    start[:, :len(values)] = vectors * np.sqrt(values)
                points, course = majorise(delta, start, rounds)
                yield pd.DataFrame({"restart": [r], "steps": [len(course)], "stress": [course[-1]], "course": [course],
                                    "points": [points.ravel().tolist()]})

    spark = df.sparkSession
    fits = spark.range(0, restarts, 1, restarts).mapInPandas(
        runs, "restart long, steps long, stress double, course array<double>, points array<double>").collect()
    best = min(fits, key=lambda r: (r["stress"], r["restart"]))
    points = np.array(best["points"]).reshape(m, k)
    points = points - points.mean(axis=0)
    points = points @ descending_eigen(points.T @ points + 1e-12 * np.eye(k))[1]
    upper = np.triu_indices(m, 1)
    fitted = _disparities(delta[upper], _between(points)[upper])
    fitted *= np.sqrt(len(fitted) / max(float((fitted ** 2).sum()), 1e-300))
    steps, level = np.unique(delta[upper], return_inverse=True)
    heights = np.bincount(level, fitted) / np.bincount(level)
    if steps[0] > 0:  # a row equal to a landmark lies on it
        steps, heights = np.r_[0.0, steps], np.r_[0.0, heights]

    def settle(goal: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(100):
            apart = at[:, None] - points[None]
            d = np.sqrt((apart ** 2).sum(axis=2))
            share = np.divide(goal, d, out=np.zeros_like(d), where=d > 0)
            at = (points[None] + share[:, :, None] * apart).mean(axis=1)
        d = np.sqrt(((at[:, None] - points[None]) ** 2).sum(axis=2))
        return at, np.sqrt(((goal - d) ** 2).sum(axis=1) / (goal ** 2).sum(axis=1))

    axes = [f"Axis{i + 1}" for i in range(k)]

    @F.pandas_udf(", ".join(f"{a} double" for a in [*axes, "stress"]))
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, parts = pdf.to_numpy(dtype=float), [np.zeros((0, k + 1))]
            for start in range(0, len(x), 500):
                near = measure(x[start:start + 500], profiles)
                goal = np.interp(near, steps, heights)
                one, lost = settle(goal, points[np.argsort(near, axis=1, kind="stable")[:, :3]].mean(axis=1))
                two, other = settle(goal, np.zeros_like(one) + 1e-6)
                better = (other < lost)[:, None]
                parts.append(np.hstack([np.where(better, two, one), np.minimum(lost, other)[:, None]]))
            yield pd.DataFrame(np.concatenate(parts), columns=[*axes, "stress"])

    rows = df.select(F.col(key).alias("__key"), *[F.col(c).cast("double").alias(c) for c in columns]).dropna(subset=columns)
    placed = rows.select(F.col("__key").alias(key), place(F.struct(*columns)).alias("__at")).select(key, "__at.*")
    trials = spark.createDataFrame([(r["restart"], r["steps"], r["stress"], r["course"]) for r in sorted(fits, key=lambda r: r["restart"])],
                                   "restart long, steps long, stress double, course array<double>")
    return NonMetric(placed, trials, names, points, float(best["stress"]))
