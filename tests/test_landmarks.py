"""Landmarks and non-metric scaling against brute force and dense versions."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from profilar.operators import landmarks

COLUMNS = ["a", "b", "c"]


def frame_of(spark, x, keys=None):
    keys = range(len(x)) if keys is None else keys
    return spark.createDataFrame([(k if k is None else int(k), *map(float, r)) for k, r in zip(keys, x)],
                                 "key long, a double, b double, c double")


def greedy(x, k):
    """Dense farthest-first order."""
    order, reach = [0], [None]
    d = np.sqrt(((x - x[0]) ** 2).sum(1))
    while len(order) < k and d.max() > 0:
        order.append(int(d.argmax()))
        reach.append(float(d.max()))
        d = np.minimum(d, np.sqrt(((x - x[order[-1]]) ** 2).sum(1)))
    return order, reach, d.max()


@pytest.mark.parametrize("pool", [3, 40, 1000])  # short pools need many passes and choose the same
def test_farthest_first_is_the_dense_order(spark, pool):
    x = np.random.default_rng(2).normal(size=(300, 3)).round(1)
    x[50:60] = x[7]  # copies, and ties from rounding
    df = frame_of(spark, x, np.arange(300) + 2 ** 60).unionByName(frame_of(spark, [[9, 9, 9]], [None]))
    got = landmarks.farthest_first(df.repartition(7), "key", COLUMNS, 12, pool=pool).orderBy("step").collect()
    order, reach, radius = greedy(x, 12)
    assert [r["key"] - 2 ** 60 for r in got] == order
    assert [r["distance"] for r in got] == pytest.approx(reach)
    table = landmarks.farthest_first(df, "key", COLUMNS, 12)
    cover = landmarks.coverage(df.where("key IS NOT NULL"), COLUMNS, table).agg(F.sum("n_rows"), F.max("radius")).first()
    assert cover[0] == 300 and cover[1] == pytest.approx(radius)


def test_radius_is_within_twice_the_least(spark):
    x = np.random.default_rng(5).normal(size=(14, 3))
    table = landmarks.farthest_first(frame_of(spark, x), "key", COLUMNS, 4)
    radius = landmarks.coverage(frame_of(spark, x), COLUMNS, table).agg(F.max("radius")).first()[0]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert radius <= 2 * min(d[:, list(c)].min(axis=1).max() for c in combinations(range(14), 4)) + 1e-12


def test_few_different_rows_and_none(spark):
    df = frame_of(spark, [[1, 0, 0]] * 5 + [[0, 1, 0]] * 3)
    assert [r["key"] for r in landmarks.farthest_first(df, "key", COLUMNS, 6).orderBy("step").collect()] == [0, 5]
    assert landmarks.farthest_first(df.limit(0), "key", COLUMNS, 6).count() == 0


def test_stress_never_rises_and_ranks_are_recovered(spark):
    flat = np.random.default_rng(8).normal(size=(30, 2))
    d = np.sqrt(((flat[:, None] - flat[None]) ** 2).sum(2))
    points, course = landmarks.majorise(d ** 3, np.random.default_rng(1).normal(size=(30, 2)), 500)
    assert all(b <= a + 1e-12 for a, b in zip(course, course[1:]))
    x = np.hstack([flat, np.zeros((30, 1))])
    more = np.random.default_rng(9).normal(size=(60, 2)) * 0.8
    every = frame_of(spark, np.vstack([x, np.hstack([more, np.zeros((60, 1))])]), [*range(2 ** 60, 2 ** 60 + 89), None])
    fit = landmarks.nonmetric_scaling(every, "key", COLUMNS, frame_of(spark, x), "key", "euclidean", restarts=6)
    trials = fit.trials.orderBy("restart").collect()
    assert len(trials) == 6 and fit.stress == min(r["stress"] for r in trials) < 0.02
    assert all(b <= a + 1e-12 for r in trials for a, b in zip(r["course"], r["course"][1:]))
    rows = fit.rows.collect()
    assert {r["key"] for r in rows} == {*range(2 ** 60, 2 ** 60 + 89), None}
    truth = {2 ** 60 + i: v for i, v in enumerate(np.vstack([flat, more])[:89])}
    kept = [r for r in rows if r["key"] is not None]
    got, want = np.array([[r["Axis1"], r["Axis2"]] for r in kept]), np.array([truth[r["key"]] for r in kept])
    got, want = got - got.mean(0), want - want.mean(0)
    u, s, v = np.linalg.svd(got.T @ want)  # best turn and scale of one onto the other
    scale = s.sum() / (got ** 2).sum()
    assert ((scale * got @ u @ v - want) ** 2).sum() / (want ** 2).sum() < 0.02


def test_disparities_match_a_dense_rising_fit():
    rng = np.random.default_rng(3)
    delta, d = rng.integers(0, 6, 25).astype(float), rng.uniform(0, 1, 25)
    got = landmarks._disparities(delta, d)
    order = np.lexsort((d, delta))
    y = d[order]
    dense = [max(min(y[a:b + 1].mean() for b in range(i, 25)) for a in range(i + 1)) for i in range(25)]
    assert got[order] == pytest.approx(dense)
