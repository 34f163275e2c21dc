"""Whitening: the qd solver against dense algebra, and the query against a plain version."""

import math

import numpy as np
import pytest

from profilar.llm import queries, whitening as w

BIG = 1 << 60


def dense(x):
    """n, sums, falling eigenvalues and directions of the different rows of whole-number vectors."""
    points = np.unique(x, axis=0)
    centred = points - points.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(points))
    return len(points), points.sum(axis=0), values[::-1], vectors.T[::-1], points.mean(axis=0)


def solved(a, most=None):
    r = w._stacked([np.asarray(a, dtype=float)])
    values, directions, trace = w.principal_directions(r, most or r.shape[1])
    assert trace == pytest.approx((np.asarray(a, dtype=float) ** 2).sum())
    return r, values, directions


MATRICES = {
    "plain": lambda g: g.normal(size=(300, 40)), "graded": lambda g: g.normal(size=(90, 20)) * np.logspace(0, -7, 20),
    "graded upwards": lambda g: g.normal(size=(90, 20)) * np.logspace(-5, 0, 20), "equal values": lambda g: np.eye(9) * 3,
    "pairs": lambda g: np.diag([3, 3, 2, 2, 1, 0, 0]), "repeated columns": lambda g: np.tile(g.normal(size=(50, 6)), 2),
    "blocks": lambda g: np.kron(np.eye(3), g.normal(size=(20, 5))), "few rows": lambda g: g.normal(size=(3, 10)),
    "one column": lambda g: g.normal(size=(7, 1)), "one value": lambda g: np.ones((4, 3)),
    "close pairs": lambda g: np.linalg.cholesky(np.diag(np.abs(np.arange(21) - 10.0) + 3) + np.eye(21, k=1) + np.eye(21, k=-1)).T,
}


@pytest.mark.parametrize("name", list(MATRICES))
def test_solver(name):
    r, values, directions = solved(MATRICES[name](np.random.default_rng(4)))
    exact = np.linalg.svd(r)[1]
    assert len(values) == (exact > 1e-13 * exact[0]).sum()
    assert np.allclose(np.sqrt(values), exact[:len(values)], rtol=1e-7, atol=1e-14 * exact[0])
    assert np.abs(directions @ directions.T - np.eye(len(values))).max() < 1e-11
    assert np.linalg.norm(r.T @ (r @ directions.T) - directions.T * values, axis=0).max() < 1e-12 * values[0]


def test_solver_on_small_whole_numbers():
    g = np.random.default_rng(5)
    for _ in range(200):
        a = g.integers(-2, 3, size=(g.integers(1, 30), g.integers(1, 12))).astype(float)
        r, values, directions = solved(a - a.mean(axis=0))
        if len(values):
            assert np.abs(np.sqrt(values) - np.linalg.svd(r)[1][:len(values)]).max() < 1e-12 * np.sqrt(values[0])
            assert np.abs(directions @ directions.T - np.eye(len(values))).max() < 1e-10


def test_values_of_a_graded_bidiagonal_are_relatively_exact():
    diagonal, upper = np.logspace(0, -150, 12), np.logspace(-1, -151, 12)[:-1]
    got = np.sqrt(w.dqds(diagonal, upper))
    assert got.min() > 0
    assert np.log(got).sum() == pytest.approx(np.log(diagonal).sum(), abs=1e-9)  # the determinant keeps its relative accuracy


def test_tasks_and_joined_triangles(spark, monkeypatch):
    monkeypatch.setattr(w, "FAN_IN", 2)
    x = np.random.default_rng(6).integers(-300, 300, size=(500, 5))
    df = spark.createDataFrame([([int(v) for v in r],) for r in x], "x array<long>").repartition(8)
    model = w.fit(df, "x", 5)
    n, sums, values, vectors, _ = dense(x)
    assert (model.n, model.sums) == (n, sums.tolist()) and np.allclose(model.values, values, rtol=1e-12)
    assert np.allclose(np.abs((model.directions * vectors).sum(axis=1)), 1.0)


def plain_rows(rows):
    kept = [(k, v) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(256 * c) for c in v] for _, v in kept])
    n, sums, values, vectors, mean = dense(x)
    vectors = vectors * np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])[:, None]
    out = []
    for (key, _), row in zip(kept, x):
        deviation = sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums))
        out += [(key, k + 1, n, deviation, float((row - mean) @ vectors[k] / math.sqrt(values[k])), values[k] / values.sum())
                for k in range(min(4, int((values > 1e-12 * values[0]).sum())))]
    return out


def test_query_equals_plain_version(spark, docs):
    folder = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = {(r["vec_id"], r["component"]): r for r in queries.whitening_query(spark, folder).collect()}
    want = plain_rows(rows)
    assert len(got) == len(want)
    for key, component, n, deviation, whitened, explained in want:
        r = got[key, component]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert r["whitened"] == pytest.approx(whitened, abs=1e-9) and r["explained"] == pytest.approx(explained, rel=1e-9)
        assert r["identity_error"] < 1e-9


def whitened(spark, rows, kind="array<float>"):
    df = spark.createDataFrame([(k, v, "clash", 1) for k, v in rows], f"vec_id long, v {kind}, x string, part int")
    kept = w.usable(df, "v").select("vec_id", w.quantised("v", 256).alias("x"))
    model = w.fit(kept, "x")
    return model, None if model is None else [(r["vec_id"], r["whitening"]) for r in w.whiten(kept, model, "x").collect()]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(BIG + 1, [0.5, 1.0]), (BIG + 2, [0.25, -1.0]), (None, [-0.75, 0.5]), (4, [0.5, 1.0]), (4, [0.5, 1.0])]
    bad = [(5, None), (6, []), (7, [None, 1.0]), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [-inf, 1.0]), (11, [1.0, 2.0, 3.0])]
    model, rows = whitened(spark, good + bad)
    assert model.n == 3 and sorted(r[0] or 0 for r in rows) == [0, 4, 4, BIG + 1, BIG + 2] and model.identity_error < 1e-12
    assert model.explained.sum() == pytest.approx(1.0) and len(model.values) == 2
    assert whitened(spark, [])[0] is None and whitened(spark, bad[:5])[0] is None
    model, rows = whitened(spark, [(1, [2.0, 3.0]), (2, [2.0, 3.0])])  # one different vector: no component
    assert model.n == 1 and [r[1]["deviation"] for r in rows] == [0, 0] and not rows[0][1]["whitened"]


def test_large_entries(spark):
    """A mean far from zero does not blur the rows; a deviation beyond a long is NULL."""
    g = np.random.default_rng(7)
    x = g.integers(-3, 4, size=(200, 3)) + np.array([1 << 40, -(1 << 41), 5])
    model, rows = whitened(spark, [(k, [v / 256 for v in r]) for k, r in enumerate(x.tolist())], "array<double>")
    n, _, values, *_ = dense(x - np.array([1 << 40, -(1 << 41), 5]))
    assert model.n == n and np.allclose(model.values, values[:3], rtol=1e-11)
    sums = np.unique(x, axis=0).astype(object).sum(axis=0)
    for k, r in rows:
        assert r["deviation"] == sum((n * int(v) - int(s)) ** 2 for v, s in zip(x[k], sums))
    model, rows = whitened(spark, [(1, [1e15, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 2.0])], "array<double>")
    assert all(r["deviation"] is None for _, r in rows) and model.identity_error < 1e-6
