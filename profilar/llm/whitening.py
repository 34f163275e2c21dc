"""Whitening of integer vectors by a bidiagonal qd solver.

The fit list is each different vector once. One pass takes its exact sums, a second reduces the centred rows by blockwise QR: a task keeps one
triangle, triangles are joined ``FAN_IN`` at a time until few are left, and the last is joined on the driver. Householder
reflections turn it into an upper bidiagonal B; dqds finds the squares of B's singular values to high relative accuracy (all
quotients stay positive), and each wanted right singular vector comes from the twisted factorisation of B'B less its value,
twisted where the residual is least. Vectors of values that lie close are taken at further twists and made orthogonal. The
reflections carry the vectors back to directions of the rows.

Rows are centred exactly where entries allow: the whole part of the mean is taken off as an integer. Components are numbered by
falling eigenvalue; of either sign, the one whose largest entry is positive. Directions in which the rows do not vary have no
whitened value and are left out; a table of one different vector has no components.

Rows whose vector is NULL, empty or holds NULL or non-finite entries are dropped (``usable``), as are vectors of another length than
the most frequent one (of equals, the longest). Repeated rows are whitened each and count once in the fit. An empty table gives none.
``deviation`` is NULL where it is beyond a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from profilar.session import save_and_reload

COMPONENTS = 4
#: Triangles joined by one task, and at most sent to the driver.
FAN_IN = 32
EPS = float(np.finfo(float).eps)
#: Values closer than this share of the greatest one have their vectors made orthogonal.
CLOSE = 1e-3
EXACT = 1 << 61


# -- small dense solver --------------------------------------------------------------------------------------------------


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, upper diagonal and right reflections W of a square matrix: r = U B W'."""
    r, d = np.array(r, dtype=float), len(r)
    right = np.eye(d)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.abs(x).max(initial=0.0)
        if size == 0.0 or len(x) < 2:
            return None
        v = x / size
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        return v / np.linalg.norm(v)

    for k in range(d):
        if (v := reflector(r[k:, k])) is not None:
            r[k:, k:] -= 2.0 * np.outer(v, v @ r[k:, k:])
        if k + 1 < d and (v := reflector(r[k, k + 1:])) is not None:
            r[k:, k + 1:] -= 2.0 * np.outer(r[k:, k + 1:] @ v, v)
            right[:, k + 1:] -= 2.0 * np.outer(right[:, k + 1:] @ v, v)
    return np.diagonal(r).copy(), np.diagonal(r, 1).copy(), right


def _transform(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, int, float]:
    """One dqds step: new quotients, the place where they turn negative (-1: nowhere) and the last remainder."""
    n = len(q)
    nq, ne = np.empty(n), np.empty(n - 1)
    d = q[0] - shift
    for i in range(n - 1):
        if d < 0.0:
            return nq, ne, i, d
        nq[i] = d + e[i]
        if nq[i] == 0.0:
            ne[i], d = 0.0, q[i + 1] - shift
            continue
        t = q[i + 1] / nq[i]
        ne[i] = e[i] * t
        d = d * t - shift
    nq[-1] = d
    return nq, ne, (n - 1 if d < 0.0 else -1), d


def _shift(q: np.ndarray, e: np.ndarray) -> float:
    """The smaller value of the last two rows: near the least value of all once the end has settled."""
    a, b, c = q[-2], e[-1], q[-1]
    mean, apart = (a + b + c) / 2.0, a * c
    root = np.sqrt(max(mean * mean - apart, 0.0))
    return apart / (mean + root) if mean + root > 0.0 else 0.0


def dqds(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, falling."""
    found: list[float] = []
    stack = [(np.asarray(diagonal, dtype=float) ** 2, np.asarray(upper, dtype=float) ** 2, 0.0)]
    while stack:
        q, e, base = stack.pop()
        steps = 0
        while len(q) > 1:
            if steps % 16 == 0 and 1.5 * q[0] < q[-1]:
                q, e = q[::-1].copy(), e[::-1].copy()
            small = EPS * EPS * (base + np.minimum(q[:-1], q[1:]))
            cut = np.flatnonzero(e <= small)
            if len(cut):
                k = int(cut[-1]) + 1
                stack.append((q[:k], e[:k - 1], base))
                q, e = q[k:], e[k:]
                continue
            steps += 1
            if steps > 100 * (len(q) + 10):
                raise ArithmeticError("dqds does not settle")
            shift = _shift(q, e) * (1.0 - 4.0 * EPS) if steps > 1 else 0.0
            for attempt in range(4):
                nq, ne, fails, rest = _transform(q, e, shift)
                if fails < 0:
                    break
                # a remainder that is negative only at the end bounds the least value from below
                shift = max(shift + rest, 0.0) if fails == len(q) - 1 and attempt == 0 else 0.25 * shift if attempt < 2 else 0.0
            q, e, base = nq, ne, base + shift
        found.extend(base + x for x in q)
    return np.sort(np.array(found))[::-1]


def twisted(diagonal: np.ndarray, upper: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Residuals of every twist of B'B - value, with the factors above and below it."""
    n, q, e, cross = len(diagonal), diagonal ** 2, upper ** 2, diagonal[:-1] * upper
    tiny = EPS * EPS * max(q.max(), value, 1e-300)
    s, p = np.empty(n), np.empty(n)
    above, below = np.zeros(n - 1), np.zeros(n - 1)
    s[0] = -value
    for i in range(n - 1):
        pivot = s[i] + q[i]
        pivot = pivot if abs(pivot) > tiny else tiny
        above[i] = cross[i] / pivot
        s[i + 1] = e[i] * s[i] / pivot - value
    p[-1] = q[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = e[i] + p[i + 1]
        pivot = pivot if abs(pivot) > tiny else tiny
        below[i] = cross[i] / pivot
        p[i] = (p[i + 1] * q[i] / pivot if e[i] else q[i]) - value
    return s + p + value, above, below


def _vector(at: int, above: np.ndarray, below: np.ndarray) -> np.ndarray:
    z = np.zeros(len(above) + 1)
    z[at] = 1.0
    for i in range(at - 1, -1, -1):
        z[i] = -above[i] * z[i + 1]
    for i in range(at, len(above)):
        z[i + 1] = -below[i] * z[i]
    return z / np.linalg.norm(z)


def right_vectors(diagonal: np.ndarray, upper: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Right singular vectors (rows) of the first of all falling squared singular values."""
    out: list[np.ndarray] = []
    for k, value in enumerate(values):
        near = [out[j] for j in range(k) if values[j] - value <= CLOSE * values[0]]
        residual, above, below = twisted(diagonal, upper, value)
        best = None
        for at in np.argsort(np.abs(residual), kind="stable"):
            z = _vector(int(at), above, below)
            for _ in range(2):
                for other in near:
                    z = z - (z @ other) * other
            left = np.linalg.norm(z)
            if best is None or left > best[0]:
                best = left, z / left if left > 0 else z
            if left > 0.5:
                break
        out.append(best[1])
    return np.array(out).reshape(len(values), len(diagonal))


def principal_directions(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Squared singular values of r above rounding, at most ``most``, their directions as rows, and the sum of all squares."""
    scale = np.abs(r).max(initial=0.0)
    if scale == 0.0 or not most:
        return np.zeros(0), np.zeros((0, r.shape[1])), 0.0
    diagonal, upper, right = bidiagonal(r / scale)
    squares = dqds(diagonal, upper)
    wanted = int((squares[:most] > (8 * EPS * len(r)) ** 2 * squares[0]).sum())
    directions = right_vectors(diagonal, upper, squares[:wanted]) @ right.T
    largest = np.abs(directions).argmax(axis=1)
    directions *= np.sign(directions[np.arange(wanted), largest])[:, None]
    return squares[:wanted] * scale ** 2, directions, float((r * r).sum())


# -- fit -----------------------------------------------------------------------------------------------------------------


@dataclass
class Whitening:
    """Exact sums over the fit list of ``n`` vectors, and the components' eigenvalues, directions and shares."""
    n: int
    sums: list[int]
    values: np.ndarray
    directions: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None
    means: tuple[np.ndarray, np.ndarray] = field(init=False)

    def __post_init__(self):
        whole = [s // self.n for s in self.sums]
        self.means = np.array(whole, dtype=np.int64), np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole)])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Rows less the mean."""
        whole, part = self.means
        if max(np.abs(x.astype(float)).max(initial=0.0), np.abs(whole.astype(float)).max(initial=0.0)) < EXACT:
            return (x - whole).astype(float) - part
        return (x.astype(np.longdouble) - whole.astype(np.longdouble) - part).astype(float)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.directions / np.sqrt(self.values)[:, None]).T

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of squares of n times a row less the sums: exact modulo 2^64, so exact wherever it is below 2^63."""
        size = 1 << 64
        with np.errstate(over="ignore"):
            y = x.astype(np.uint64) * np.uint64(self.n % size) - np.array([s % size for s in self.sums], dtype=np.uint64)
            exact = (y * y).sum(axis=1, dtype=np.uint64)
        about = ((self.centred(x) * float(self.n)) ** 2).sum(axis=1)
        limit = float(1 << 63)
        out: list[int | None] = []
        for row, value, near in zip(x, exact.tolist(), about.tolist()):
            if abs(near / limit - 1.0) < 1e-6:  # too near to the limit for the estimate to tell
                value = sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums))
                near = float(value)
            out.append(value if near < limit and value < 1 << 63 else None)
        return out


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has entries, all of them finite, and has the most frequent length."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    whole = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)))
    lengths = whole.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return whole.where(F.size(vector) == (lengths[0]["d"] if lengths else 0))


def quantised(vector: str, scale: int):
    """Column of whole numbers: ``scale`` times each entry, rounded down."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))


def _rows(batch: pd.Series) -> np.ndarray:
    return np.stack(batch.to_numpy()).astype(np.int64)


def exact_sums(x: np.ndarray) -> list[int]:
    if len(x) * float(np.abs(x.astype(float)).max(initial=0.0)) < float(1 << 62):
        return [int(s) for s in x.sum(axis=0)]
    return [sum(map(int, column)) for column in x.T]


def _sums(points: DataFrame) -> tuple[int, list[int]]:
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums = 0, None
        for batch in batches:
            if len(batch):
                x = _rows(batch["x"])
                n, found = n + len(x), exact_sums(x)
                sums = found if sums is None else [a + b for a, b in zip(sums, found)]
        if sums is not None:
            yield pd.DataFrame({"place": range(-1, len(sums)), "total": [Decimal(s) for s in (n, *sums)]})

    found = points.mapInPandas(each, "place int, total decimal(38,0)").groupBy("place").agg(F.sum("total").alias("total"))
    total = {r["place"]: int(r["total"]) for r in found.collect()}  # a number for each dimension
    return total.get(-1, 0), [total[k] for k in range(len(total) - 1)]


def _stacked(blocks: list[np.ndarray]) -> np.ndarray:
    """The triangle of blocks on top of each other, square."""
    r = np.linalg.qr(np.concatenate(blocks), mode="r")
    return r if len(r) == r.shape[1] else np.concatenate([r, np.zeros((r.shape[1] - len(r), r.shape[1]))])


def _triangle(points: DataFrame, model: Whitening) -> np.ndarray:
    """R of the centred fit list."""
    d = len(model.sums)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r, part = None, 0
        for batch in batches:
            if len(batch):
                r = _stacked(([] if r is None else [r]) + [model.centred(_rows(batch["x"]))])
                part = int(batch["part"].iloc[0])
        if r is not None:
            yield pd.DataFrame({"part": [part], "r": [r.ravel()]})

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        r = _stacked([np.asarray(x).reshape(d, d) for x in group["r"]])
        return pd.DataFrame({"part": [int(group["part"].iloc[0]) // FAN_IN], "r": [r.ravel()]})

    schema = "part long, r array<double>"
    numbered = points.withColumn("part", F.spark_partition_id().cast("long"))
    made = save_and_reload(numbered.mapInPandas(each, schema), "triangles")
    while made.count() > FAN_IN:
        made = save_and_reload(made.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(joined, schema), "triangles")
    last = [np.array(r["r"]).reshape(d, d) for r in made.orderBy("part").collect()]  # FAN_IN at most
    return _stacked(last)


def identity_error(points: DataFrame, model: Whitening) -> float | None:
    """Largest entry of the covariance of the fit list's whitened values less the identity."""
    k = len(model.values)
    if not k:
        return None

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if len(batch):
                w = model.whitened(_rows(batch["x"]))
                total += w.sum(axis=0)
                products += w.T @ w
        yield pd.DataFrame({"v": [np.concatenate([total, products.ravel()])]})

    parts = points.mapInPandas(each, "v array<double>").select(F.posexplode("v").alias("place", "v"))
    found = parts.groupBy("place").agg(F.sum("v").alias("v")).orderBy("place").collect()  # components squared
    v = np.array([r["v"] for r in found]) / model.n
    return float(np.abs(v[k:].reshape(k, k) - np.outer(v[:k], v[:k]) - np.eye(k)).max())


def fit(df: DataFrame, vector: str, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of a column of whole-number vectors of one length; None without rows."""
    points = save_and_reload(df.select(F.col(vector).alias("x")).distinct(), "points")
    n, sums = _sums(points)
    if not n:
        return None
    model = Whitening(n, sums, np.zeros(0), np.zeros((0, len(sums))), np.zeros(0))
    squares, directions, trace = principal_directions(_triangle(points, model), components)
    model.values, model.directions, model.explained = squares / n, directions, squares / trace if trace else squares
    model.identity_error = identity_error(points, model)
    return model


def whiten(df: DataFrame, model: Whitening, vector: str, result: str = "whitening") -> DataFrame:
    """``df`` with a struct: ``deviation`` and the array ``whitened``, a value for each component."""
    @F.pandas_udf("deviation long, whitened array<double>")
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _rows(batch) if len(batch) else np.zeros((0, len(model.sums)), dtype=np.int64)
            yield pd.DataFrame({"deviation": pd.array(model.deviations(x), dtype="Int64"), "whitened": list(model.whitened(x))})

    return df.withColumn(result, each(F.col(vector)))
