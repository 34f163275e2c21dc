"""Rising least-squares fit of y on x, in ranges of x.

Rows are dealt out by ranges of x and sorted there, so that each moves once; equal x are summed, in every batch before they move and in
order after. Blocks (weight, sum, sum of squares) in the order of x are pooled where adjacent means fall. Pooling is associative, so ranges of
consecutive blocks are pooled on their own, and what is left is dealt into new ranges, shifted by half, until no means fall from one range to the next. A pool that spans many ranges is one block for each of them after the
first round, so rounds are few. No task holds more than ``RANGE_BLOCKS`` blocks, and none passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profilar.operators.ordered import sequence_in_group
from profilar.session import save_and_reload

RANGE_BLOCKS = 100_000
_SCHEMA = "part long, low double, high double, w double, s double, square double"


def pool_blocks(rows: list[tuple[float, float, float, float, float]]) -> list[tuple[float, float, float, float, float]]:
    """Blocks (low, high, weight, sum, squares) in order, pooled until their means rise."""
    out: list[tuple[float, float, float, float, float]] = []
    for block in rows:
        while out and out[-1][3] * block[2] > block[3] * out[-1][2]:  # the mean before is greater
            low, _, w, s, square = out.pop()
            block = (low, block[1], w + block[2], s + block[3], square + block[4])
        out.append(block)
    return out


def _levels(x: np.ndarray, *sums: np.ndarray) -> list[np.ndarray]:
    """Different values of a sorted x, and the sums over each."""
    new = (x[1:] != x[:-1]) & ~(np.isnan(x[1:]) & np.isnan(x[:-1]))
    starts = np.flatnonzero(np.concatenate([[True], new]))
    return [x[starts], *[np.add.reduceat(v, starts) for v in sums]]


def _combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Equal x of a batch as one row; ``square`` only where it does not follow from the others."""
    for batch in batches:
        if len(batch):
            batch = batch.sort_values("x")
            y, w = batch["y"].to_numpy(), batch["w"].to_numpy()
            x, w, s, square, n = _levels(batch["x"].to_numpy(), w, w * y, w * y * y, np.ones(len(y)))
            yield pd.DataFrame({"x": x, "w": w, "s": s, "square": np.where(n > 1, square, np.nan)})


def _pools_in_order(size: int):
    """Pools of every ``size`` different x of sorted rows, each such range a ``part``."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held, filled = TaskContext.get().partitionId() << 32, [], 0

        def pooled(levels: list[np.ndarray]) -> pd.DataFrame:
            x, w, s, square = (v.tolist() for v in levels)
            out = pd.DataFrame(pool_blocks(list(zip(x, x, w, s, square))), columns=["low", "high", "w", "s", "square"])
            out.insert(0, "part", part)
            return out

        for batch in batches:
            if not len(batch):
                continue
            x, w, s, square = (batch[c].to_numpy(dtype=float) for c in ("x", "w", "s", "square"))
            held.append([x, w, s, np.where(np.isnan(square), s * s / w, square)])
            filled += len(x)
            if filled > 2 * size:
                levels = _levels(*[np.concatenate(v) for v in zip(*held)])
                while len(levels[0]) > size:  # the last one may go on in the next batch
                    yield pooled([v[:size] for v in levels])
                    part, levels = part + 1, [v[size:] for v in levels]
                held, filled = [levels], len(levels[0])
        if held:
            levels = _levels(*[np.concatenate(v) for v in zip(*held)])
            for k in range(0, len(levels[0]), size):
                yield pooled([v[k:k + size] for v in levels])
                part += 1

    return each


def rising_fit(df: DataFrame, x: str | Column, y: str | Column, weight: str | Column | None = None, *,
               range_blocks: int | None = None) -> DataFrame:
    """Pools of the best rising fit: ``low`` and ``high`` x, ``w``, ``s``, ``square`` (sums of weight, wy and wyy), ``fitted``.

    Rows without x or y, or of no positive weight, are left out. An empty table has no pools.
    """
    size = range_blocks or RANGE_BLOCKS
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    w = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight)
    rows = df.select(x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w"))
    rows = rows.where(F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("w") > 0))
    moved = rows.mapInPandas(_combined, "x double, w double, s double, square double")
    ordered = moved.repartitionByRange("x").sortWithinPartitions("x")
    blocks = save_and_reload(ordered.mapInPandas(_pools_in_order(size), _SCHEMA), "pools")

    def pooled(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("low")
        found = pool_blocks(list(part[["low", "high", "w", "s", "square"]].itertuples(index=False, name=None)))
        out = pd.DataFrame(found, columns=["low", "high", "w", "s", "square"])
        out.insert(0, "part", part["part"].iloc[0])
        return out

    shift = 0
    while True:
        mean = F.col("s") / F.col("w")
        ends = blocks.groupBy("part").agg(F.min("low").alias("low"), F.min_by(mean, "low").alias("first"), F.max_by(mean, "low").alias("last"))
        after = ends.select("last", F.lead("first").over(Window.orderBy("low")).alias("after"))  # a row for each range
        falls = after.where(F.col("after") < F.col("last")).isEmpty()
        blocks = blocks.drop("part")
        if falls:
            return blocks.withColumn("fitted", F.col("s") / F.col("w"))
        numbered = sequence_in_group(blocks, [], ["low"], out="__seq")
        dealt = numbered.select(F.floor((F.col("__seq") - 1 + shift) / size).cast("long").alias("part"), "low", "high", "w", "s", "square")
        blocks = save_and_reload(dealt.groupBy("part").applyInPandas(pooled, _SCHEMA), "pools")
        shift = size // 2 - shift
