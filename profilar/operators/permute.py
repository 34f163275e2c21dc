"""Permutation tests as a table: one shuffled copy of the response per permutation.

No copy is sorted. A row's place in its stratum (numbered once) goes to its partner's place by a keyed bijection of 0 … n - 1:
Feistel rounds on the pair (place // a, place % a), a the least whole number with a² >= n, repeated while the result is n
or more. Keys come from the seed and the permutation's number, so copies depend neither on partitioning nor on
attempts. Nothing is moved per permutation: a task takes some of the permutations and a block of the design rows, and the responses stream
through it in packed chunks, so what is shuffled is a fixed number of copies of the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilar.functions.linalg import scaled_pinv, unpack_symmetric
from profilar.operators.design import Design, combination_text, double_text, factor, num
from profilar.operators.joins import match
from profilar.operators.moments import (Moments, as_columns, cell_keys, collect_moments, complete_rows, moment_rows,
                                        shifts)
from profilar.operators.ordered import running_total, sequence_in_group
from profilar.operators.ordination import Ordination, condition_places, full_design
from profilar.session import save_and_reload

ROUNDS = 6
#: Rows, times permutations, of one job, about.
CHUNK_ROWS = 1 << 40
#: Rows of a table that every task holds, so that permutations are dealt to tasks; larger tables stream through the tasks.
HELD_ROWS = 100_000
#: Design rows that a task holds of a larger table.
HELD_BYTES = 1 << 27
#: Rows packed into one.
PACK_ROWS = 4096
#: Sums that a task holds, about.
SUMMED_NUMBERS = 1 << 23
#: Numbers worked on at once in a task.
BLOCK = 1 << 18
# fixed values of the mixing function: increments and multipliers
STEP, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
CLOSE = float(np.sqrt(np.finfo(float).eps))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(FIRST)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(SECOND)
    return x ^ (x >> np.uint64(31))


def round_keys(seed: int, permutations: np.ndarray) -> np.ndarray:
    """A key for each permutation (rows) and round."""
    number = permutations.astype(np.uint64)[:, None] * np.uint64(ROUNDS) + np.arange(ROUNDS, dtype=np.uint64)
    return mixed(mixed(number * np.uint64(STEP) + np.uint64(seed % (1 << 64))))


def partner_places(places: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where the places (from 0) of strata of the given sizes go, for each permutation's keys: places × permutations."""
    side = np.ceil(np.sqrt(sizes.astype(float))).astype(np.uint64)
    side += (side * side < sizes.astype(np.uint64)).astype(np.uint64)
    size = sizes.astype(np.uint64)
    alike = len(size) > 0 and bool((size == size[0]).all())  # division by one number is faster
    if alike:
        side, size = side[:1], size[:1]
    side, size = side[:, None], size[:, None]

    def walked(at: np.ndarray, a: np.ndarray, key: Callable[[int], np.ndarray]) -> np.ndarray:
        high = at // a
        low = at - high * a
        for k in range(keys.shape[1]):
            turned = high + _remainder(mixed(key(k) + low * np.uint64(STEP)), a)
            high, low = low, _remainder(turned, a)
        return high * a + low

    at = walked(np.repeat(places.astype(np.uint64)[:, None], len(keys), axis=1), side, lambda k: keys[:, k][None, :])
    row, permutation = np.nonzero(at >= size)
    while len(row):
        own = np.zeros_like(row) if alike else row
        found = walked(at[row, permutation], side[0, 0] if alike else side[own, 0], lambda k: keys[permutation, k])
        at[row, permutation] = found
        left = found >= size[own, 0]
        row, permutation = row[left], permutation[left]
    return at.astype(np.int64)


def _remainder(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    return x - x // a * a


def _sized(base: DataFrame, strata: Sequence[str]) -> DataFrame:
    """``base`` with ``__n``, the rows of its stratum. A missing stratum is a stratum."""
    counts = base.groupBy(*strata).agg(F.count(F.lit(1)).alias("__n"))
    return match(base, counts, list(strata), "inner") if strata else base.withColumn("__n", F.lit(base.count()))


def permuted_moments(base: DataFrame, strata: Sequence[str], factors: Sequence[str], n_x: int, n_y: int,
                     first: int, last: int, seed: int) -> DataFrame:
    """Σ[1,x]·y' per permutation and factor cell.

    ``base`` has ``__place`` (its number in the stratum, from 1), strata,
    factors, x0… and y0…, and ``__n`` (the stratum's rows; counted if absent).
    The responses of a row meet the design of the row whose place they go to.
    """
    base = base if "__n" in base.columns else _sized(base, strata)
    ys = [f"y{j}" for j in range(n_y)]
    if base.count() <= HELD_ROWS:
        return _held_moments(base, strata, factors, n_x, n_y, first, last, seed)
    return _streamed_moments(base, strata, factors, n_x, n_y, first, last, seed)


def _codes(rows: pd.DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, list[tuple]]:
    """A number for each row's combination of values (missing ones equal each other), and the combinations."""
    numbers: dict[tuple, int] = {}
    values = zip(*[rows[c].astype(object).where(rows[c].notna(), None) for c in columns]) if columns else [()] * len(rows)
    codes = np.array([numbers.setdefault(v, len(numbers)) for v in values], dtype=np.int64)
    return codes, list(numbers)


def _held_moments(base: DataFrame, strata: Sequence[str], factors: Sequence[str], n_x: int, n_y: int,
                  first: int, last: int, seed: int) -> DataFrame:
    """:func:`permuted_moments` of at most ``HELD_ROWS`` rows: each task holds them all and takes some of the permutations."""
    spark = base.sparkSession
    held_columns = [*factors, "__place", "__n", *[f"x{i}" for i in range(n_x)], *[f"y{j}" for j in range(n_y)]]
    # strata as text: a long beside a NULL would be rounded
    rows = base.select(*held_columns, *[F.col(c).cast("string").alias(f"__s{i}") for i, c in enumerate(strata)]).toPandas()
    stratum, kinds = _codes(rows, [f"__s{i}" for i in range(len(strata))])
    place, size = rows["__place"].to_numpy(dtype=np.int64) - 1, rows["__n"].to_numpy(dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(np.bincount(stratum, minlength=len(kinds)))])
    order = np.lexsort((place, stratum))  # row at each stratum's place
    cell, cells = _codes(rows, factors)
    x = np.column_stack([np.ones(len(rows)), *[rows[f"x{i}"].to_numpy(dtype=float) for i in range(n_x)]])
    y = np.column_stack([rows[f"y{j}"].to_numpy(dtype=float) for j in range(n_y)])
    held = spark.sparkContext.broadcast((place, size, starts[stratum], order, cell, x, y))  # ``HELD_ROWS`` at most

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, size, start, order, cell, x, y = held.value
        for batch in batches:
            for b in batch["b"]:
                onto = order[start + partner_places(place, size, round_keys(seed, np.array([b])))[:, 0]]
                at, design = cell[onto], x[onto]
                cross = np.column_stack([np.bincount(at, design[:, i] * y[:, j], minlength=len(cells))
                                         for i in range(n_x + 1) for j in range(n_y)])
                out = pd.DataFrame({"__b": np.full(len(cells), b), "cross": list(cross)})
                for k, f in enumerate(factors):
                    out.insert(k + 1, f, pd.Series([c[k] for c in cells], dtype=object))
                yield out

    kind = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    schema = ", ".join(["__b int", *[f"`{f}` {kind[f]}" for f in factors], "cross array<double>"])
    tasks = spark.sparkContext.defaultParallelism
    return spark.range(first, last + 1, numPartitions=tasks).select(F.col("id").alias("b")).mapInPandas(each, schema)


def _started(base: DataFrame, strata: Sequence[str]) -> DataFrame:
    """``base`` with ``__start``, the rows of the strata before its own."""
    if not strata:
        return base.withColumn("__start", F.lit(0).cast("bigint"))
    counts = base.groupBy(*strata).agg(F.count(F.lit(1)).alias("__rows"))
    upto = running_total(counts, [], strata, {"__upto": "__rows"})
    return match(base, upto.select(*strata, (F.col("__upto") - F.col("__rows")).alias("__start")), list(strata), "inner")


def _packed(base: DataFrame, strata: Sequence[str], n_x: int, n_y: int) -> DataFrame:
    """Rows in the order of (stratum, place), ``PACK_ROWS`` to a row of numbers as bytes; ``low`` to ``high``: where their strata lie."""
    at = F.col("__start") + F.col("__place") - 1
    xs, ys = [f"x{i}" for i in range(n_x)], [f"y{j}" for j in range(n_y)]
    rows = _started(base, strata).select(F.floor(at / PACK_ROWS).cast("long").alias("chunk"), at.alias("at"), "__start", "__n", "__code", *xs, *ys)

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        start, size = part["__start"].to_numpy(np.int64), part["__n"].to_numpy(np.int64)
        return pd.DataFrame({
            "chunk": part["chunk"].iloc[:1], "low": start.min(), "high": (start + size).max(), "code": part["__code"].to_numpy(np.int32).tobytes(),
            "x": part[xs].to_numpy(float).T.tobytes(), "start": start.tobytes() if (start != start[0]).any() else start[:1].tobytes(),
            "size": size.tobytes() if (size != size[0]).any() else size[:1].tobytes(), "y": part[ys].to_numpy(float).T.tobytes()})

    schema = "chunk long, low long, high long, code binary, x binary, start binary, size binary, y binary"
    return save_and_reload(rows.groupBy("chunk").applyInPandas(pack, schema), "packed")


def _streamed_moments(base: DataFrame, strata: Sequence[str], factors: Sequence[str], n_x: int, n_y: int,
                      first: int, last: int, seed: int) -> DataFrame:
    """:func:`permuted_moments` of any number of rows.

    A task holds at most ``HELD_BYTES`` of design rows and takes some of the permutations; the responses whose strata
    meet its design rows stream through it.
    """
    spark, held = base.sparkSession, (n_x + 1) * n_y
    if factors:
        cells = save_and_reload(sequence_in_group(base.select(*factors).distinct(), [], factors, out="__code"), "codes")
        n_cells = cells.count()
        coded = match(base, cells.withColumn("__code", F.col("__code") - 1), list(factors), "inner")
    else:
        n_cells, coded = 1, base.withColumn("__code", F.lit(0))
    packed = _packed(coded, strata, n_x, n_y)
    block_chunks = max(1, HELD_BYTES // (4 + 8 * n_x) // PACK_ROWS)  # of a task's design rows
    block_rows, n_chunks = block_chunks * PACK_ROWS, packed.agg(F.max("chunk")).first()[0]
    if n_chunks is None:
        return coded.select(F.lit(0).alias("__b"), *factors, F.array(F.lit(0.0)).alias("cross")).limit(0)
    blocks = n_chunks // block_chunks + 1
    n_perm = last - first + 1
    deals = max(1, 2 * spark.sparkContext.defaultParallelism // blocks, -(-n_perm * n_cells * held // SUMMED_NUMBERS))
    per_deal = -(-n_perm // deals)
    deals = -(-n_perm // per_deal)

    # A task's number: deal of permutations × blocks + block. Design rows come first.
    deal = F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal")
    none = F.lit(None).cast("binary")
    designs = packed.select(deal, F.floor(F.col("chunk") / block_chunks).cast("int").alias("block"), F.lit(0).alias("kind"), "chunk", "code", "x",
                            none.alias("start"), none.alias("size"), none.alias("y"))
    met = F.sequence(F.floor(F.col("low") / block_rows).cast("int"), F.floor((F.col("high") - 1) / block_rows).cast("int"))
    answers = packed.withColumn("block", F.explode(met)).select(
        deal, "block", F.lit(1).alias("kind"), "chunk", none.alias("code"), none.alias("x"), "start", "size", "y")
    dealt = designs.unionByName(answers).withColumn("task", F.col("deal") * blocks + F.col("block"))
    dealt = dealt.repartitionById(deals * blocks, F.col("task")).sortWithinPartitions("task", "kind", "chunk")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, code = -1, np.zeros(0, np.int32)
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.task != task:
                    if task >= 0:
                        yield summed(numbers, code[:filled], sums)
                    task, filled, begin = r.task, 0, r.block * block_rows
                    code, x = np.zeros(0, np.int32), np.zeros((n_x, 0))
                    numbers = np.arange(first + r.deal * per_deal, min(first + (r.deal + 1) * per_deal, last + 1))
                    keys, sums = round_keys(seed, numbers), np.zeros((held, len(numbers) * n_cells))
                if r.kind == 0:
                    some = np.frombuffer(r.code, np.int32)
                    if filled + len(some) > len(code):
                        room = min(block_rows, max(2 * len(code), len(some)))
                        code, x = np.resize(code, room), np.concatenate([x, np.zeros((n_x, room - x.shape[1]))], axis=1)
                    code[filled:filled + len(some)] = some
                    x[:, filled:filled + len(some)] = np.frombuffer(r.x).reshape(n_x, len(some))
                    filled += len(some)
                else:
                    y = np.frombuffer(r.y).reshape(n_y, -1)
                    start, size = (np.broadcast_to(np.frombuffer(v, np.int64), y.shape[1]) for v in (r.start, r.size))
                    place = r.chunk * PACK_ROWS + np.arange(y.shape[1]) - start
                    rows = max(1, BLOCK // len(keys))
                    for k in range(0, len(place), rows):
                        cut = slice(k, k + rows)
                        onto = partner_places(place[cut], size[cut], keys) + (start[cut] - begin)[:, None]
                        add(sums, onto, y[:, cut], code, x, filled)
        if task >= 0:
            yield summed(numbers, code[:filled], sums)

    def add(sums: np.ndarray, onto: np.ndarray, y: np.ndarray, code: np.ndarray, x: np.ndarray, filled: int) -> None:
        inside = None if 0 <= onto.min() and onto.max() < filled else (onto >= 0) & (onto < filled)
        wide = [np.broadcast_to(v[:, None], onto.shape) for v in y]
        slot = np.broadcast_to(np.arange(onto.shape[1]) * n_cells, onto.shape)
        onto, slot, *wide = (v.ravel() if inside is None else v[inside] for v in (onto, slot, *wide))
        if n_cells > 1:
            slot = slot + code[onto]
        for i in range(n_x + 1):
            design = x[i - 1][onto] if i else None
            for j in range(n_y):
                sums[i * n_y + j] += np.bincount(slot, wide[j] if design is None else design * wide[j], minlength=sums.shape[1])

    def summed(numbers: np.ndarray, code: np.ndarray, sums: np.ndarray) -> pd.DataFrame:
        seen = np.unique(code)
        cross = sums.reshape(held, len(numbers), n_cells)[:, :, seen].reshape(held, -1).T
        return pd.DataFrame({"__b": np.repeat(numbers, len(seen)), "__code": np.tile(seen, len(numbers)) + 1, "cross": list(cross)})

    parts = dealt.select("task", "deal", "block", "kind", "chunk", "code", "x", "start", "size", "y").mapInPandas(
        each, "__b int, __code long, cross array<double>")
    total = parts.groupBy("__b", "__code").agg(F.array(*[F.sum(F.col("cross")[i]) for i in range(held)]).alias("cross"))
    return (match(total, cells, ["__code"], "inner") if factors else total).select("__b", *factors, "cross")


def _chunks(n_perm: int, rows: int, chunk: int | None) -> list[tuple[int, int]]:
    """First and last permutation of each job."""
    size = chunk or max(1, min(n_perm, CHUNK_ROWS // max(1, rows)))
    return [(first, min(first + size - 1, n_perm)) for first in range(1, n_perm + 1, size)]


def run_permutations(df: DataFrame, *, key: str, strata: Sequence[str], design: Design, responses: Sequence[str],
                     residual_of: Design, moments: Moments, statistics: Callable[[np.ndarray], dict[str, float]],
                     observed: dict[str, float], n_perm: int, seed: int = 1, chunk: int | None = None) -> dict[str, float]:
    """P value per statistic: (1 + #{permuted ≥ observed}) / (n_perm + 1).

    ``statistics`` maps D'Y (design columns × responses) to named values; Y is
    the response after removal of ``residual_of``. Only exceedance counts reach
    the driver. Without permutations P is missing.
    """
    if n_perm == 0:
        return dict.fromkeys(observed)
    numerics = design.numerics()
    names = list(numerics)
    cols = design.columns()
    z_cols = Design(residual_of.terms, True, residual_of.levels).columns()
    z_inverse, _ = scaled_pinv(moments.cross(z_cols, z_cols))
    coef = z_inverse @ moments.cross(z_cols, as_columns(responses))
    factors = list(design.factors)

    shifted = {n: f"({e}) - {double_text(moments.shift[n])}" for n, e in numerics.items()}
    complete = complete_rows(df, factors, {**numerics, **{r: f"`{r}`" for r in responses}}, design.levels)
    ys = [
        F.expr(f"`{r}` - {double_text(moments.shift[r])} - {combination_text(z_cols, coef[:, j], shifted)}").alias(f"y{j}")
        for j, r in enumerate(responses)
    ]
    base = complete.select(
        F.col(key).alias("__key"), *dict.fromkeys([*strata, *factors]),
        *[F.expr(shifted[n]).cast("double").alias(f"x{i}") for i, n in enumerate(names)], *ys)
    base = save_and_reload(sequence_in_group(base, strata, ["__key"], out="__place"), "places")
    rows, different = base.agg(F.count(F.lit(1)), F.count_distinct("__key")).first()
    if rows != different:
        raise ValueError(f"values of {key} are not unique")
    base = save_and_reload(_sized(base, strata).drop("__key"), "permute")

    n_x, n_y = len(names), len(responses)
    tests = list(observed)

    def evaluate(pdf: pd.DataFrame) -> pd.DataFrame:
        cross = np.stack(pdf["cross"].to_numpy()).reshape(len(pdf), n_x + 1, n_y)
        cells = cell_keys(pdf, factors)
        holder = Moments(factors, names, {}, cells, np.zeros((len(cells), 1, 1)))
        dty = np.zeros((len(cols), n_y))
        for i, col in enumerate(cols):
            dty[i] = holder.indicator(col) @ cross[:, holder.place(col.numeric), :]
        values = statistics(dty)
        return pd.DataFrame({"test": tests, "value": [values[t] for t in tests]})

    counts = dict.fromkeys(tests, 0)
    spark = df.sparkSession
    limits = spark.createDataFrame([(t, float(v)) for t, v in observed.items()], "test string, observed double")
    for first, last in _chunks(n_perm, rows, chunk):
        table = permuted_moments(base, strata, factors, n_x, n_y, first, last, seed)
        values = table.groupBy("__b").applyInPandas(evaluate, "test string, value double")
        hits = values.join(limits, "test").where(F.col("value") >= F.col("observed") - F.lit(CLOSE))
        for row in hits.groupBy("test").agg(F.count(F.lit(1)).alias("n")).collect():
            counts[row["test"]] += row["n"]
    return {t: (1 + counts[t]) / (n_perm + 1) for t in tests}


def permutation_test(df: DataFrame, fit: Ordination, *, key: str, strata: Sequence[str] = (), by: str | None = None,
                     n_perm: int = 999, seed: int = 1) -> DataFrame:
    """Pseudo-F test of an ordination: overall, by ``margin`` or by ``axis``.

    Rows are permuted within strata after removal of the conditioning part, and
    the conditioning part is removed again from each permuted copy. Axis tests
    hold earlier axes as conditions.
    """
    design = full_design(fit.constraint, fit.condition)
    cols, ys = design.columns(), as_columns(fit.species)
    m = fit.moments
    gram_dd, gram_dy, gram_yy = m.cross(cols, cols), m.cross(cols, ys), m.cross(ys, ys)
    z = condition_places(design, fit.condition)
    z_inverse, z_rank = scaled_pinv(gram_dd[np.ix_(z, z)])
    d_inverse, d_rank = scaled_pinv(gram_dd)
    # Observed response after the conditioning part is removed.
    observed_dy = gram_dy - gram_dd[:, z] @ z_inverse @ gram_dy[z]
    total = float(np.trace(gram_yy - gram_dy[z].T @ z_inverse @ gram_dy[z]))
    df_model, df_resid = d_rank - z_rank, fit.n - d_rank

    tests: dict[str, tuple[int, Callable]] = {}

    def fitted(dty, places=None, inverse=None):
        return float(np.sum(dty[places] * (inverse @ dty[places]))) if places is not None \
            else float(np.sum(dty * (d_inverse @ dty)))

    if by is None:
        tests["Model"] = (df_model, lambda dty: fitted(dty) - fitted(dty, z, z_inverse))
    elif by == "margin":
        terms = [t for t in design.droppable() if t in {c.label for c in fit.constraint.terms}
                 and t not in {c.label for c in fit.condition.terms}]
        for t in terms:
            rest = [i for i, c in enumerate(cols) if c.term != t]
            inverse, rank = scaled_pinv(gram_dd[np.ix_(rest, rest)])
            tests[t] = (d_rank - rank,
                        lambda dty, rest=rest, inverse=inverse: fitted(dty) - fitted(dty, rest, inverse))
    elif by == "axis":
        a = d_inverse @ gram_dy @ fit.vectors[:, : fit.n_constrained]
        for k in range(fit.n_constrained):
            basis = np.concatenate([np.eye(len(cols))[:, z], a[:, :k]], axis=1)
            inverse, _ = scaled_pinv(basis.T @ gram_dd @ basis)
            hat = basis @ inverse @ basis.T
            tests[fit.axes[k]] = (1, lambda dty, hat=hat: _first_root(dty, d_inverse - hat))
    else:
        raise ValueError("by must be None, 'margin' or 'axis'")

    def statistics(dty: np.ndarray) -> dict[str, float]:
        residual = total - fitted(dty)
        return {t: (ss(dty) / max(d, 1)) / (residual / df_resid) for t, (d, ss) in tests.items()}

    observed = statistics(observed_dy)
    p = run_permutations(
        df, key=key, strata=strata, design=design, responses=fit.species, residual_of=fit.condition, moments=m,
        statistics=statistics, observed=observed, n_perm=n_perm, seed=seed)
    rows = [(t, int(d), ss(observed_dy) / (fit.n - 1), observed[t], p[t]) for t, (d, ss) in tests.items()]
    rows.append(("Residual", int(df_resid), (total - fitted(observed_dy)) / (fit.n - 1), None, None))
    return df.sparkSession.createDataFrame(
        rows, "term string, df int, variance double, f double, p double")


def permutation_test_by(df: DataFrame, group: str, species: Sequence[str], constraint: Design, *, key: str,
                        n_perm: int = 999, seed: int = 1, chunk: int | None = None) -> DataFrame:
    """Overall pseudo-F of every group's own ordination with its permutation P, all groups in the same jobs.

    Rows are permuted within their group. A group reaches a task as one row per permutation and factor cell, and never as
    its rows; the permutations are those of :func:`permutation_test` on that group alone.
    """
    design, species = full_design(constraint, Design([])), list(species)
    numerics, factors, cols, ys = design.numerics(), list(design.factors), design.columns(), as_columns(species)
    names = list(numerics)
    every = {**numerics, **{s: f"`{s}`" for s in species}}
    shift = shifts(df, every)
    cells = save_and_reload(moment_rows(df, [group], every, shift, factors, design.levels), "cells")

    shifted = {n: f"({e}) - {double_text(shift[n])}" for n, e in every.items()}
    complete = complete_rows(df, factors, every, design.levels).where(F.col(group).isNotNull())
    base = complete.select(
        F.col(key).alias("__key"), *dict.fromkeys([group, *factors]),
        *[F.expr(shifted[n]).cast("double").alias(f"x{i}") for i, n in enumerate(names)],
        *[F.expr(shifted[s]).cast("double").alias(f"y{j}") for j, s in enumerate(species)])
    base = save_and_reload(_sized(sequence_in_group(base, [group], ["__key"], out="__place"), [group]).drop("__key"), "permute")
    rows = base.count()
    size, n_x, n_y = len(every) + 1, len(names), len(species)

    def judge(kept: pd.DataFrame, permuted: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame(columns=[group, "df_model", "df_residual", "f", "hits"])
        if not len(kept):
            return empty
        grams = np.array([unpack_symmetric(u, size) for u in kept["upper"]])
        m = Moments(factors, list(every), {}, cell_keys(kept, factors), grams)
        gram, cross, yy = m.cross(cols, cols), m.cross(cols, ys), m.cross(ys, ys)
        inverse, rank = scaled_pinv(gram)
        total = float(np.trace(yy) - np.sum(cross[0] ** 2) / gram[0, 0])
        df_model, df_residual = rank - 1, m.n - rank
        if df_model < 1 or df_residual < 1:
            return empty

        def pseudo_f(dty: np.ndarray) -> float:
            fitted = float(np.sum(dty * (inverse @ dty)) - np.sum(dty[0] ** 2) / gram[0, 0])
            return (fitted / df_model) / ((total - fitted) / df_residual) if total > fitted else float("inf")

        observed, hits = pseudo_f(cross), 0
        for _, part in permuted.groupby("__b", sort=False):
            sums = np.stack(part["cross"].to_numpy()).reshape(len(part), n_x + 1, n_y)
            held = Moments(factors, names, {}, cell_keys(part, factors), np.zeros((len(part), 1, 1)))
            dty = np.array([held.indicator(c) @ sums[:, held.place(c.numeric), :] for c in cols])
            hits += pseudo_f(dty) >= observed - CLOSE
        return pd.DataFrame([(kept[group].iloc[0], int(df_model), int(df_residual), observed, hits)], columns=empty.columns)

    kind = df.schema[group].dataType.simpleString()
    schema = f"`{group}` {kind}, df_model int, df_residual int, f double, hits bigint"
    judged = []
    for first, last in _chunks(n_perm, rows, chunk):
        moved = permuted_moments(base, [group], [group, *[f for f in factors if f != group]], n_x, n_y, first, last, seed)
        judged.append(cells.groupBy(group).cogroup(moved.groupBy(group)).applyInPandas(judge, schema))
    whole = judged[0]
    for part in judged[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy(group).agg(
        F.first("df_model").alias("df_model"), F.first("df_residual").alias("df_residual"), F.first("f").alias("f"),
        ((1 + F.sum("hits")) / F.lit(n_perm + 1)).alias("p"))


def _first_root(dty: np.ndarray, middle: np.ndarray) -> float:
    values = np.linalg.eigvalsh(dty.T @ middle @ dty)
    return float(values[-1])


def fit_vectors(df: DataFrame, axes: Sequence[str], variables: Sequence[str], *, key: str,
                strata: Sequence[str] = (), n_perm: int = 999, seed: int = 1) -> DataFrame:
    """Direction of greatest change, r² and permutation P of continuous variables on ordination axes.

    All variables share one set of complete rows and one set of permutations.
    """
    design = Design([num(a) for a in axes])
    m = collect_moments(df, design, variables)
    cols, ys = design.columns(), as_columns(variables)
    gram, cross, yy = m.cross(cols, cols), m.cross(cols, ys), m.cross(ys, ys)
    inverse, _ = scaled_pinv(gram)
    slopes = (inverse @ cross)[1:]
    norms = np.sqrt((slopes ** 2).sum(axis=0))
    totals = np.diag(yy) - cross[0] ** 2 / gram[0, 0]
    variables = list(variables)

    def r2(dty: np.ndarray) -> dict[str, float]:
        share = ((dty * (inverse @ dty)).sum(axis=0) - dty[0] ** 2 / gram[0, 0]) / totals
        return dict(zip(variables, map(float, share)))

    observed = r2(cross - gram[:, :1] @ (cross[:1] / gram[0, 0]))
    p = run_permutations(df, key=key, strata=strata, design=design, responses=variables, residual_of=Design([]),
                         moments=m, statistics=r2, observed=observed, n_perm=n_perm, seed=seed)
    rows = [(v, *map(float, slopes[:, j] / norms[j]), observed[v], p[v]) for j, v in enumerate(variables)]
    schema = "variable string, " + ", ".join(f"`{a}` double" for a in axes) + ", r2 double, p double"
    return df.sparkSession.createDataFrame(rows, schema)


def fit_factor(df: DataFrame, axes: Sequence[str], factor_name: str, levels: Sequence[str], *, key: str,
               strata: Sequence[str] = (), n_perm: int = 999, seed: int = 1) -> DataFrame:
    """r² (one minus within over total) and permutation P of a factor on ordination axes."""

    design = Design([factor(factor_name)], levels={factor_name: list(levels)})
    m = collect_moments(df, design, axes)
    cols, ys = design.columns(), as_columns(axes)
    gram, cross, yy = m.cross(cols, cols), m.cross(cols, ys), m.cross(ys, ys)
    inverse, _ = scaled_pinv(gram)
    total = float(np.trace(yy) - np.sum(cross[0] ** 2) / gram[0, 0])

    def r2(dty):
        fit = float(np.sum(dty * (inverse @ dty)))
        return {"r2": float((fit - np.sum(dty[0] ** 2) / gram[0, 0]) / total)}

    observed = r2(cross - gram[:, :1] @ (cross[:1] / gram[0, 0]))
    p = run_permutations(df, key=key, strata=strata, design=design, responses=list(axes), residual_of=Design([]),
                         moments=m, statistics=r2, observed=observed, n_perm=n_perm, seed=seed)
    return df.sparkSession.createDataFrame([(factor_name, observed["r2"], p["r2"])],
                                           "variable string, r2 double, p double")
