"""Ordination: principal components and (partial) redundancy analysis.

Executors sum cross products; the driver solves one matrix of column size; the
loadings return to the executors as plain row expressions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from profilar.functions.linalg import descending_eigen, explained, scaled_pinv, unpack_symmetric
from profilar.operators.design import Design, column_expression, combination_text, double_text, level_text
from profilar.operators.joins import match
from profilar.operators.moments import Moments, as_columns, cell_keys, collect_moments, moment_rows, shifts
from profilar.operators.shares import hellinger

EMPTY = Design([], intercept=True)


@dataclass
class Ordination:
    """Fitted ordination; every matrix is sized by columns, not rows."""

    species: list[str]
    constraint: Design
    condition: Design
    moments: Moments
    n: float
    total: float
    conditioned: float
    constrained: float
    residual: float
    rank_condition: int
    rank_constraint: int
    eigenvalues: np.ndarray  # constrained axes, then residual axes
    vectors: np.ndarray  # species × axes
    axes: list[str]
    n_constrained: int

    @property
    def residual_df(self) -> float:
        return self.n - 1 - self.rank_condition - self.rank_constraint

    @property
    def centre(self) -> np.ndarray:
        """Shift applied to the species columns."""
        return np.array([self.moments.shift[s] for s in self.species])


def full_design(constraint: Design, condition: Design) -> Design:
    return Design(list(dict.fromkeys([*condition.terms, *constraint.terms])), True,
                  {**condition.levels, **constraint.levels})


def partition(gram_yy, gram_yd, gram_dd, z_places) -> dict:
    """Split Σyy into conditioned, constrained and residual parts.

    Design column 0 is the intercept; ``z_places`` are the conditioning columns, intercept included.
    """
    mean_part, _ = explained(gram_dd[:1, :1], gram_yd[:, :1].T)
    z_part, z_rank = explained(gram_dd[np.ix_(z_places, z_places)], gram_yd[:, z_places].T)
    d_part, d_rank = explained(gram_dd, gram_yd.T)
    return {
        "total": gram_yy - mean_part, "conditioned": z_part - mean_part, "constrained": d_part - z_part,
        "residual": gram_yy - d_part, "rank_z": z_rank - 1, "rank_x": d_rank - z_rank,
    }


def condition_places(design: Design, condition: Design) -> list[int]:
    labels = {t.label for t in condition.terms} | {"1"}
    return [i for i, c in enumerate(design.columns()) if c.term in labels]


def redundancy(df: DataFrame, species: Sequence[str], constraint: Design | None = None,
               condition: Design | None = None) -> Ordination:
    """Redundancy analysis of the given columns; without constraints, principal components."""
    constraint, condition = constraint or EMPTY, condition or EMPTY
    design = full_design(constraint, condition)
    moments = collect_moments(df, design, species)
    cols, ys = design.columns(), as_columns(species)
    gram_dd, gram_yd, gram_yy = moments.cross(cols, cols), moments.cross(ys, cols), moments.cross(ys, ys)
    parts = partition(gram_yy, gram_yd, gram_dd, condition_places(design, condition))
    n = moments.n
    con_val, con_vec = descending_eigen(parts["constrained"] / (n - 1), parts["rank_x"])
    if not constraint.terms:
        con_val, con_vec = con_val[:0], con_vec[:, :0]
    res_val, res_vec = descending_eigen(parts["residual"] / (n - 1))
    axes = [f"RDA{i + 1}" for i in range(len(con_val))] + [f"PC{i + 1}" for i in range(len(res_val))]
    inertia = {k: float(np.trace(parts[k]) / (n - 1)) for k in ("total", "conditioned", "constrained", "residual")}
    return Ordination(
        list(species), constraint, condition, moments, n, rank_condition=parts["rank_z"],
        rank_constraint=parts["rank_x"], eigenvalues=np.concatenate([con_val, res_val]),
        vectors=np.concatenate([con_vec, res_vec], axis=1), axes=axes, n_constrained=len(con_val), **inertia,
    )


def principal_components(df: DataFrame, species: Sequence[str]) -> Ordination:
    return redundancy(df, species)


def inertia_table(spark: SparkSession, fit: Ordination) -> DataFrame:
    """Inertia by component with proportion and rank."""
    rows = [
        ("total", fit.total, 1.0, None),
        ("conditioned", fit.conditioned, fit.conditioned / fit.total, fit.rank_condition),
        ("constrained", fit.constrained, fit.constrained / fit.total, fit.rank_constraint),
        ("residual", fit.residual, fit.residual / fit.total, len(fit.eigenvalues) - fit.n_constrained),
    ]
    return spark.createDataFrame(
        [(a, float(v), float(s), None if r is None else int(r)) for a, v, s, r in rows],
        "component string, inertia double, proportion double, rank int")


def axis_table(spark: SparkSession, fit: Ordination) -> DataFrame:
    """Eigenvalue, share of total inertia, running share and label of each axis."""
    share = fit.eigenvalues / fit.total
    rows = [(i + 1, a, float(v), float(p), float(c)) for i, (a, v, p, c) in
            enumerate(zip(fit.axes, fit.eigenvalues, share, np.cumsum(share)))]
    table = spark.createDataFrame(rows, "rank int, axis string, eigenvalue double, proportion double, running double")
    return table.withColumn("label", _axis_label())


def _axis_label() -> Column:
    """Axis name and percentage of the total inertia."""
    percent = F.bround(F.col("proportion") * 100, 1)
    text = F.when(percent == F.floor(percent), percent.cast("bigint").cast("string")).otherwise(percent.cast("string"))
    return F.concat("axis", F.lit(" ("), text, F.lit("%)"))


def _axis_scale(fit: Ordination, places: Sequence[int], scaling: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers of unit row scores and unit column scores."""
    share = fit.eigenvalues[list(places)] / fit.total
    constant = ((fit.n - 1) * fit.total) ** 0.25
    ones = np.ones(len(places))
    rows, cols = {
        0: (ones, ones),
        1: (np.sqrt(share) * constant, ones * constant),
        2: (ones * constant, np.sqrt(share) * constant),
        3: (share ** 0.25 * constant, share ** 0.25 * constant),
    }[scaling]
    return rows, cols


def _places(fit: Ordination, choices: Sequence[int] | None, axes: Sequence[str] | None) -> list[int]:
    if axes is not None:
        return [fit.axes.index(a) for a in axes]
    return [c - 1 for c in (choices or range(1, min(2, len(fit.axes)) + 1))]


def row_score_columns(fit: Ordination, *, choices: Sequence[int] | None = None, axes: Sequence[str] | None = None,
                      scaling: int = 2) -> dict[str, Column]:
    """Row scores as expressions: (row − conditioning fit) · loading · scale."""
    places = _places(fit, choices, axes)
    scale, _ = _axis_scale(fit, places, scaling)
    weights = fit.vectors[:, places] / np.sqrt(fit.eigenvalues[places] * (fit.n - 1)) * scale
    z_cols = Design(fit.condition.terms, True, fit.condition.levels).columns()
    moments, ys = fit.moments, as_columns(fit.species)
    inverse, _ = scaled_pinv(moments.cross(z_cols, z_cols))
    coef = inverse @ moments.cross(z_cols, ys) @ weights  # conditioning column × axis
    numerics = fit.condition.numerics()
    shifted = {n: f"({e}) - {double_text(moments.shift[n])}" for n, e in numerics.items()}
    out = {}
    for k, place in enumerate(places):
        terms = [f"(`{s}` - {double_text(fit.centre[j])}) * {double_text(weights[j, k])}" for j, s in enumerate(fit.species)]
        out[fit.axes[place]] = F.expr(" + ".join(terms) + " - " + combination_text(z_cols, coef[:, k], shifted))
    return out


def row_scores(df: DataFrame, fit: Ordination, **choice) -> DataFrame:
    """Add row scores to the rows they belong to (no positional binding)."""
    return df.withColumns(row_score_columns(fit, **choice))


def species_scores(spark: SparkSession, fit: Ordination, *, choices: Sequence[int] | None = None,
                   axes: Sequence[str] | None = None, scaling: int = 2,
                   labels: Mapping[str, str] | None = None) -> DataFrame:
    """Column scores sorted by the first chosen axis, with a display label."""
    places = _places(fit, choices, axes)
    _, scale = _axis_scale(fit, places, scaling)
    values = fit.vectors[:, places] * scale
    rows = [(s, (labels or {}).get(s, s), *map(float, values[j])) for j, s in enumerate(fit.species)]
    schema = "species string, label string, " + ", ".join(f"`{fit.axes[p]}` double" for p in places)
    return spark.createDataFrame(rows, schema).orderBy(fit.axes[places[0]])


def constraint_correlations(spark: SparkSession, fit: Ordination) -> DataFrame:
    """Correlation of each constraint column with each constrained axis (the biplot arrows)."""
    design = full_design(fit.constraint, fit.condition)
    cols = design.columns()
    z = condition_places(design, fit.condition)
    x = [i for i in range(len(cols)) if i not in z]
    moments, ys = fit.moments, as_columns(fit.species)
    gram, cross = moments.cross(cols, cols), moments.cross(cols, ys)
    v = fit.vectors[:, : fit.n_constrained]
    inverse, _ = scaled_pinv(gram)
    z_inverse, _ = scaled_pinv(gram[np.ix_(z, z)])
    # Fitted row scores are D·a; both sides are taken after removal of the conditioning part.
    a = inverse @ cross @ v
    resid = gram - gram[:, z] @ z_inverse @ gram[z, :]
    centred = gram - np.outer(gram[:, 0], gram[0]) / gram[0, 0]
    score_norm = np.sqrt(np.clip(np.diag(a.T @ resid @ a), 1e-300, None))
    rows = []
    for i in x:
        spread = np.sqrt(max(centred[i, i], 1e-300))
        for k in range(fit.n_constrained):
            rows.append((cols[i].name, fit.axes[k], float((resid[i] @ a)[k] / (spread * score_norm[k]))))
    return spark.createDataFrame(rows, "constraint string, axis string, correlation double")


# One ordination per group --------------------------------------------------


def redundancy_by(df: DataFrame, group: str, species: Sequence[str], constraint: Design,
                  condition: Design | None = None) -> DataFrame:
    """An ordination of its own for every group, in one job.

    Rows are reduced to moments per group and factor cell first; a group
    reaches its task as one small matrix per cell. Result: one row per group
    and constrained axis with inertia parts, degrees of freedom, F, axis label,
    column loadings and what the axis takes from the ``condition`` columns
    (``removed``). ``shift`` repeats the means that numbers were centred by.
    Groups of one row, or without a constraint that varies, give no row.
    """
    condition = condition or EMPTY
    design = full_design(constraint, condition)
    numerics = {**design.numerics(), **{s: f"`{s}`" for s in species}}
    factors = design.factors
    shift = shifts(df, numerics)
    rows = moment_rows(df, [group], numerics, shift, factors, design.levels)
    cols, ys = design.columns(), as_columns(species)
    z = condition_places(design, condition)
    z_cols = _condition_columns(condition)
    names, species = list(numerics), list(species)
    size = len(names) + 1
    held = [shift[n] for n in names]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        grams = np.array([unpack_symmetric(u, size) for u in pdf["upper"]])
        m = Moments(factors, names, {}, cell_keys(pdf, factors), grams)
        parts = partition(m.cross(ys, ys), m.cross(ys, cols), m.cross(cols, cols), z)
        n = m.n
        if n < 2:
            return pd.DataFrame(columns=[group, "axis", *RESULT])
        values, vectors = descending_eigen(parts["constrained"] / (n - 1), parts["rank_x"])
        inverse, _ = scaled_pinv(m.cross(z_cols, z_cols))
        removed = inverse @ m.cross(z_cols, ys) @ vectors
        ss_t, ss_z, ss_c, ss_r = (np.trace(parts[k]) for k in ("total", "conditioned", "constrained", "residual"))
        df_r = n - 1 - parts["rank_z"] - parts["rank_x"]
        usable = df_r > 0 and parts["rank_x"] > 0 and ss_r > 0
        f = ss_c / parts["rank_x"] / (ss_r / df_r) if usable else None
        out = [
            (pdf[group].iloc[0], f"RDA{k + 1}", n, ss_t / (n - 1), ss_z / (n - 1), ss_c / (n - 1), ss_r / (n - 1),
             parts["rank_z"], parts["rank_x"], int(df_r), f, values[k], values[k] * (n - 1) / ss_t,
             list(map(float, vectors[:, k])), list(map(float, removed[:, k])), held)
            for k in range(len(values))
        ]
        return pd.DataFrame(out, columns=[group, "axis", *RESULT])

    kind = df.schema[group].dataType.simpleString()
    fits = rows.groupBy(group).applyInPandas(
        solve, f"`{group}` {kind}, axis string, n double, total double, conditioned double, constrained double, residual double, "
               "df_condition int, df_model int, df_residual int, f double, eigenvalue double, proportion double, "
               "loadings array<double>, removed array<double>, shift array<double>")
    return fits.withColumn("label", _axis_label())


RESULT = ["n", "total", "conditioned", "constrained", "residual", "df_condition", "df_model", "df_residual", "f", "eigenvalue",
          "proportion", "loadings", "removed", "shift"]


def _condition_columns(condition: Design) -> list:
    return Design(condition.terms, True, condition.levels).columns()


def _fit_scale(power: float, scaling: int, of: str = "") -> Column:
    """What :func:`_axis_scale` gives, from the columns of a table of fits."""
    n, total, share = (F.col(of + c) for c in ("n", "total", "proportion"))
    return F.pow(share, F.lit(power)) * F.pow((n - 1) * total, 0.25) if scaling else F.lit(1.0)


def row_scores_by(df: DataFrame, fits: DataFrame, group: str, species: Sequence[str], axis: str = "RDA1",
                  constraint: Design | None = None, condition: Design | None = None, scaling: int = 3) -> DataFrame:
    """Row scores on one axis of each group's own ordination, what the conditioning part explains taken off.

    ``constraint`` and ``condition`` are those of the fits; the constraint matters only where terms have numbers. A row whose
    group has no such axis, that lacks a number, or that lacks a conditioning factor or has an unlisted level of it, gets NULL.
    """
    constraint, condition = constraint or EMPTY, condition or EMPTY
    numerics = full_design(constraint, condition).numerics()
    place = {name: i for i, name in enumerate([*numerics, *species])}
    fit = F.struct("n", "total", "proportion", "eigenvalue", "loadings", "removed", "shift")
    joined = match(df, fits.where(F.col("axis") == axis).select(group, fit.alias("__fit")), [group], "left")
    raw = F.lit(0.0)
    for j, s in enumerate(species):
        raw = raw + (F.col(s) - F.get("__fit.shift", F.lit(place[s]))) * F.get("__fit.loadings", F.lit(j))
    shifted = {n: f"({e}) - `__fit`.shift[{place[n]}]" for n, e in condition.numerics().items()}
    for k, col in enumerate(_condition_columns(condition)):
        raw = raw - F.get("__fit.removed", F.lit(k)) * column_expression(col, shifted)
    known = F.lit(True)
    for f in condition.factors:
        known = known & F.col(f).cast("string").isin([level_text(v) for v in condition.levels[f]])
    value = raw / F.sqrt(F.col("__fit.eigenvalue") * (F.col("__fit.n") - 1))
    scale = _fit_scale({0: 0.0, 1: 0.5, 2: 0.0, 3: 0.25}[scaling], scaling, "__fit.")
    return joined.withColumn(axis, F.when(known, value * scale)).drop("__fit")


def species_scores_by(fits: DataFrame, group: str, species: Sequence[str], axis: str = "RDA1", scaling: int = 3,
                      labels: Mapping[str, str] | None = None) -> DataFrame:
    """Column scores on one axis of each group's own ordination, with display labels and their rank by score.

    Ties in score take the order of ``species``.
    """
    texts = F.array(*[F.struct(F.lit(j).alias("place"), F.lit(s).alias("species"), F.lit((labels or {}).get(s, s)).alias("label"))
                      for j, s in enumerate(species)])
    scale = _fit_scale({0: 0.0, 1: 0.0, 2: 0.5, 3: 0.25}[scaling], scaling)
    scores = F.transform(texts, lambda t: F.struct(F.get("loadings", t["place"]).alias("score"), t["place"], t["species"],
                                                   t["label"]))
    ordered = fits.where(F.col("axis") == axis).select(group, scale.alias("__scale"), F.array_sort(scores).alias("__scores"))
    return (ordered.select(group, "__scale", F.posexplode("__scores").alias("__at", "__s"))
            .select(group, F.col("__s.species").alias("species"), F.col("__s.label").alias("label"),
                    (F.col("__at") + 1).alias("rank"), (F.col("__s.score") * F.col("__scale")).alias(axis)))


# Groups in ordination space --------------------------------------------------


def centroids(scores: DataFrame, group: Sequence[str], axes: Sequence[str]) -> DataFrame:
    return scores.groupBy(*group).agg(*[F.avg(a).alias(f"c_{a}") for a in axes], F.count(F.lit(1)).alias("n"))


def spokes(scores: DataFrame, group: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """Each row with its group's centroid and the distance to it."""
    joined = match(scores, centroids(scores, group, axes), group, "left")
    total = F.lit(0.0)
    for a in axes:
        total = total + (F.col(a) - F.col(f"c_{a}")) ** 2
    return joined.withColumn("spoke", F.sqrt(total))


def hellinger_table(df: DataFrame, groups: Sequence[str], prefix: str = "h_") -> tuple[DataFrame, list[str]]:
    """Rows with a complete profile, and their transformed columns under new names."""
    return hellinger(df, groups, prefix), [prefix + g for g in groups]
