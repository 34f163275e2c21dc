"""Cross products: one pass over the rows, summed map-side, grouped by factor cell.

What leaves the executors is a matrix per cell, sized by the number of columns
and cells and never by the number of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilar.functions.linalg import unpack_symmetric
from profilar.operators.design import Design, DesignColumn, double_text, level_text

#: Numbers that the cells of one design may bring to the driver: cells times squared columns.
MAX_NUMBERS = 20_000_000
#: Wider rows are summed as one matrix per task; the result is the same.
EXPRESSION_LIMIT = 24


def complete_rows(df: DataFrame, factors: Sequence[str], numerics: Mapping[str, str],
                  levels: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Rows without a missing factor or number, numbers as named double columns ``v0, v1 …``.

    Factors become text. A value outside the given ``levels`` of its factor is missing.
    """
    out = df.select(
        "*", *[F.expr(e).cast("double").alias(f"v{i}") for i, e in enumerate(numerics.values())]
    ).withColumns({f: F.col(f).cast("string") for f in factors})
    test = F.lit(True)
    for f in factors:
        if levels and f in levels:
            test = test & F.col(f).isin([level_text(v) for v in levels[f]])
    for c in [*factors, *[f"v{i}" for i in range(len(numerics))]]:
        test = test & F.col(c).isNotNull()
    return out.where(test)


def shifts(df: DataFrame, numerics: Mapping[str, str]) -> dict[str, float]:
    """Column means, to centre by before cross products are summed."""
    if not numerics:
        return {}
    row = df.agg(*[F.avg(F.expr(e).cast("double")).alias(f"m{i}") for i, e in enumerate(numerics.values())]).first()
    return {n: float(row[f"m{i}"] or 0.0) for i, n in enumerate(numerics)}


def moment_rows(df: DataFrame, by: Sequence[str], numerics: Mapping[str, str],
                shift: Mapping[str, float] | None = None, factors: Sequence[str] = (),
                levels: Mapping[str, Sequence] | None = None) -> DataFrame:
    """One row per ``by`` and factor cell: ``upper``, the upper triangle of Σ[1,v][1,v]'."""
    keys = [*by, *[f for f in factors if f not in by]]
    plain = [k for k in by if k not in factors]
    rows = complete_rows(df, factors, numerics, levels)
    for k in plain:
        rows = rows.where(F.col(k).isNotNull())
    shift = shift or {}
    values = ["1D"] + [f"(v{i} - {double_text(shift.get(n, 0.0))})" for i, n in enumerate(numerics)]
    size = len(values)
    if size - 1 <= EXPRESSION_LIMIT:
        sums = [f"sum({values[i]} * {values[j]})" for i in range(size) for j in range(i, size)]
        return rows.groupBy(*keys).agg(F.expr(f"array({', '.join(sums)})").alias("upper"))
    prepared = rows.select(*keys, F.expr(f"array({', '.join(values)})").alias("v"))
    return gram_of_arrays(prepared, keys, size)


def gram_of_arrays(df: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """As :func:`moment_rows` for wide rows held in an array column ``v``.

    Each task sums its own rows into one matrix per cell, so only
    tasks × cells × size² numbers are shuffled.
    """
    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = (types + ", " if types else "") + "place int, part double"
    upper = np.triu_indices(size)

    def partial(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            groups = batch.groupby(list(keys), sort=False) if keys else [((), batch)]
            for key, part in groups:
                key = key if isinstance(key, tuple) else (key,)
                x = np.stack(part["v"].to_numpy())
                held[key] = held.get(key, 0.0) + x.T @ x
        for key, gram in held.items():
            out = pd.DataFrame({"place": np.arange(len(upper[0]), dtype=np.int32), "part": gram[upper]})
            for i, k in enumerate(keys):
                out.insert(i, k, key[i])
            yield out

    parts = df.mapInPandas(partial, schema).groupBy(*keys, "place").agg(F.sum("part").alias("part"))
    return parts.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("place", "part"))), lambda s: s["part"]
        ).alias("upper")
    )


@dataclass
class Moments:
    """Collected cell moments."""

    factors: list[str]
    names: list[str]  # numeric products
    shift: dict[str, float]
    cells: list[tuple]
    grams: np.ndarray  # cell × (1+m) × (1+m)

    @property
    def n(self) -> float:
        return float(self.grams[:, 0, 0].sum())

    def place(self, name: str | None) -> int:
        return 0 if name is None else self.names.index(name) + 1

    def indicator(self, col: DesignColumn) -> np.ndarray:
        out = np.ones(len(self.cells))
        for f, level in col.levels:
            i = self.factors.index(f)
            wanted = level_text(level)
            out *= np.array([1.0 if c[i] == wanted else 0.0 for c in self.cells])
        return out

    def cross(self, left: Sequence[DesignColumn], right: Sequence[DesignColumn]) -> np.ndarray:
        """Cross products of design columns (numeric parts shifted)."""
        a = np.array([self.indicator(c) for c in left]).reshape(len(left), len(self.cells))
        b = np.array([self.indicator(c) for c in right]).reshape(len(right), len(self.cells))
        pa, pb = [self.place(c.numeric) for c in left], [self.place(c.numeric) for c in right]
        picked = self.grams[:, pa][:, :, pb]
        return np.einsum("ic,cij,jc->ij", a, picked, b, optimize=True)


def cell_keys(pdf: pd.DataFrame, factors: Sequence[str]) -> list[tuple]:
    """Factor values of every row; empty tuples where there is no factor."""
    return list(zip(*[pdf[f] for f in factors])) if factors else [()] * len(pdf)


def as_columns(names: Sequence[str]) -> list[DesignColumn]:
    return [DesignColumn(n, (), n, n) for n in names]


def collect_moments(df: DataFrame, design: Design, responses: Sequence[str],
                    shift: Mapping[str, float] | None = None) -> Moments:
    """Moments of a design and its responses over the whole table.

    Numeric columns are centred by their mean unless ``shift`` says otherwise.
    """
    numerics = {**design.numerics(), **{r: f"`{r}`" for r in responses}}
    factors = design.factors
    if shift is None:
        shift = shifts(df, numerics)
    size = len(numerics) + 1
    most = max(1, MAX_NUMBERS // size ** 2)
    rows = moment_rows(df, [], numerics, shift, factors, design.levels).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} factor cells of {size} columns")
    rows = [r for r in rows if r["upper"] is not None and r["upper"][0] is not None]
    grams = np.array([unpack_symmetric(r["upper"], size) for r in rows]).reshape(-1, size, size)
    return Moments(factors, list(numerics), dict(shift), [tuple(r[f] for f in factors) for r in rows], grams)
