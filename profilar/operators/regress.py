"""Linear regression from cross products, and the tables and curves around it."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from profilar.functions.distributions import (Z_95, f_upper, normal_quantile_column, p_f, p_normal, p_t, t_quantile,
                                              t_two_sided)
from profilar.functions.linalg import scaled_pinv
from profilar.functions.nulls import ratio
from profilar.operators import mixed
from profilar.operators.design import Design, DesignColumn, Term, column_expression, combination_text, double_text
from profilar.operators.joins import match
from profilar.operators.meta import coefficients
from profilar.operators.moments import Moments, as_columns, collect_moments, shifts
from profilar.operators.ordered import quantiles, sequence_in_group
from profilar.session import shared_folder


@dataclass
class LinearModel:
    response: str
    design: Design
    columns: list[DesignColumn]
    moments: Moments
    n: float
    beta: np.ndarray  # on centred numeric columns
    inverse: np.ndarray
    rank: int
    rss: float
    tss: float

    @property
    def df_residual(self) -> float:
        return self.n - self.rank

    @property
    def sigma2(self) -> float:
        return self.rss / self.df_residual

    @property
    def loglik(self) -> float:
        return -self.n / 2 * (np.log(2 * np.pi) + np.log(self.rss / self.n) + 1)


def _safe_shift(df: DataFrame, design: Design, response: str) -> dict[str, float]:
    """Centre a numeric column only where its uncentred part lies in the design.

    Then the fit is the same and coefficients can be moved back exactly.
    """
    numerics = {**design.numerics(), response: f"`{response}`"}
    values = shifts(df, numerics)
    present = {(c.levels, c.numeric) for c in design.columns()}
    for c in design.columns():
        if c.numeric and (c.levels, None) not in present:
            values[c.numeric] = 0.0
    if not design.intercept:
        values[response] = 0.0
    return values


def _solve(moments: Moments, columns: Sequence[DesignColumn], response: str):
    ys = as_columns([response])
    gram, cross = moments.cross(columns, columns), moments.cross(columns, ys)
    yy = float(moments.cross(ys, ys)[0, 0])
    inverse, rank = scaled_pinv(gram)
    beta = (inverse @ cross)[:, 0]
    return beta, inverse, rank, max(yy - float(beta @ cross[:, 0]), 0.0), yy


def ols(df: DataFrame, response: str, design: Design) -> LinearModel:
    """Ordinary least squares. ``response`` must be a column (take logs beforehand)."""
    moments = collect_moments(df, design, [response], _safe_shift(df, design, response))
    cols = design.columns()
    beta, inverse, rank, rss, yy = _solve(moments, cols, response)
    y_sum = moments.cross([DesignColumn("1", (), None, "1")], as_columns([response]))[0, 0]
    tss = yy - y_sum ** 2 / moments.n if design.intercept else yy
    return LinearModel(response, design, cols, moments, moments.n, beta, inverse, rank, rss, tss)


def raw_coefficients(fit: LinearModel) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and covariance on the uncentred columns."""
    move = np.eye(len(fit.columns))
    places = {(c.levels, c.numeric): i for i, c in enumerate(fit.columns)}
    for j, c in enumerate(fit.columns):
        if c.numeric and fit.moments.shift[c.numeric]:
            move[places[(c.levels, None)], j] -= fit.moments.shift[c.numeric]
    beta = move @ fit.beta
    if fit.design.intercept:
        beta[0] += fit.moments.shift[fit.response]
    return beta, move @ fit.inverse @ move.T * fit.sigma2


def coefficient_table(spark: SparkSession, fit: LinearModel) -> DataFrame:
    beta, cov = raw_coefficients(fit)
    se = np.sqrt(np.clip(np.diag(cov), 0, None))
    t = np.divide(beta, se, out=np.zeros_like(beta), where=se > 0)
    p = t_two_sided(t, fit.df_residual)
    half = t_quantile(0.975, fit.df_residual) * se
    rows = [(c.name, float(b), float(s), float(tv), float(pv), float(b - h), float(b + h))
            for c, b, s, tv, pv, h in zip(fit.columns, beta, se, t, p, np.broadcast_to(half, se.shape))]
    return spark.createDataFrame(
        rows, "term string, estimate double, se double, t double, p double, ci_lb double, ci_ub double")


def fit_summary(spark: SparkSession, fit: LinearModel) -> DataFrame:
    r2 = 1 - fit.rss / fit.tss
    base = 1 if fit.design.intercept else 0
    df1 = fit.rank - base
    adj = 1 - (1 - r2) * (fit.n - base) / fit.df_residual
    f = (fit.tss - fit.rss) / df1 / fit.sigma2 if df1 else None
    p = float(f_upper(f, df1, fit.df_residual)) if df1 else None
    return spark.createDataFrame(
        [(int(fit.n), int(fit.df_residual), float(np.sqrt(fit.sigma2)), float(r2), float(adj),
          None if f is None else float(f), p, float(fit.loglik), aicc_of(fit))],
        "n bigint, df_residual int, sigma double, r2 double, adj_r2 double, f double, p double, "
        "loglik double, aicc double")


def aicc_of(fit: LinearModel) -> float:
    k = fit.rank + 1
    return float(-2 * fit.loglik + 2 * k * fit.n / (fit.n - k - 1))


def compare_aicc(spark: SparkSession, fits: Mapping[str, LinearModel]) -> DataFrame:
    rows = sorted(((name, f.rank + 1, aicc_of(f)) for name, f in fits.items()), key=lambda r: r[2])
    best = rows[0][2]
    return spark.createDataFrame(
        [(n, int(k), a, a - best, i + 1) for i, (n, k, a) in enumerate(rows)],
        "model string, df int, aicc double, delta double, rank int")


def _sub_fit(fit: LinearModel, labels: Sequence[str]) -> tuple[int, float]:
    cols = [c for c in fit.columns if c.term in labels]
    if not cols:
        ys = as_columns([fit.response])
        return 0, float(fit.moments.cross(ys, ys)[0, 0])
    _, _, rank, rss, _ = _solve(fit.moments, cols, fit.response)
    return rank, rss


def _f_row(name: str, df: int, ss: float, fit: LinearModel) -> tuple:
    if df <= 0:
        return (name, 0, float(ss), None, None)
    f = ss / df / fit.sigma2
    return (name, int(df), float(ss), float(f), float(f_upper(f, df, fit.df_residual)))


_F_SCHEMA = "term string, df int, sum_sq double, f double, p double"


def sequential_table(spark: SparkSession, fit: LinearModel) -> DataFrame:
    """Terms added in order, each against the model before it."""
    done = ["1"] if fit.design.intercept else []
    rank, rss = _sub_fit(fit, done)
    rows = []
    for t in fit.design.terms:
        done = [*done, t.label]
        new_rank, new_rss = _sub_fit(fit, done)
        rows.append(_f_row(t.label, new_rank - rank, rss - new_rss, fit))
        rank, rss = new_rank, new_rss
    rows.append(("Residuals", int(fit.df_residual), float(fit.rss), None, None))
    return spark.createDataFrame(rows, _F_SCHEMA)


def nested_test(spark: SparkSession, large: LinearModel, *dropped: str) -> DataFrame:
    """F test of a model against the one without the named terms, from the same cross products."""
    rank, rss = _sub_fit(large, [c for c in dict.fromkeys(c.term for c in large.columns) if c not in dropped])
    return spark.createDataFrame([_f_row("-" + "-".join(dropped), large.rank - rank, rss - large.rss, large)], _F_SCHEMA)


def type_two_table(spark: SparkSession, fit: LinearModel) -> DataFrame:
    """Each term against the model of all terms that do not contain it."""
    def parts(t):
        return set(t.factors) | {n for n, _ in t.atoms}

    base = ["1"] if fit.design.intercept else []
    rows = []
    for t in fit.design.terms:
        others = [o.label for o in fit.design.terms if o is not t and not parts(t) < parts(o)]
        small_rank, small_rss = _sub_fit(fit, base + others)
        large_rank, large_rss = _sub_fit(fit, [*base, *others, t.label])
        rows.append(_f_row(t.label, large_rank - small_rank, small_rss - large_rss, fit))
    rows.append(("Residuals", int(fit.df_residual), float(fit.rss), None, None))
    return spark.createDataFrame(rows, _F_SCHEMA)


def fitted_column(fit: LinearModel) -> Column:
    beta, _ = raw_coefficients(fit)
    return F.expr(combination_text(fit.columns, beta, fit.design.numerics()))


def residuals(df: DataFrame, fit: LinearModel) -> DataFrame:
    """Rows with fitted value and residual."""
    return df.withColumn("fitted", fitted_column(fit)).withColumn("resid", F.col(fit.response) - F.col("fitted"))


def influence(df: DataFrame, fit: LinearModel) -> DataFrame:
    """Residuals with leverage, standardised residual and Cook's distance: one row expression on the stored inverse."""
    shifted = {n: f"({e}) - {double_text(fit.moments.shift[n])}" for n, e in fit.design.numerics().items()}
    rows = residuals(df, fit).withColumns(
        {f"__d{i}": column_expression(c, shifted) for i, c in enumerate(fit.columns)})
    size = range(len(fit.columns))
    leverage = F.expr(" + ".join(f"__d{i} * __d{j} * {double_text(fit.inverse[i, j])}" for i in size for j in size) or "0D")
    rows = rows.withColumn("leverage", leverage).drop(*[f"__d{i}" for i in size])
    rest = 1 - F.col("leverage")
    return rows.withColumn("standardised", ratio("resid", F.sqrt(F.when(rest > 0, rest) * fit.sigma2))).withColumn(
        "cook", F.pow("standardised", F.lit(2.0)) * ratio("leverage", rest) / fit.rank)


def mixed_residuals(df: DataFrame, fits: DataFrame, model: mixed.Model, *, response: str, group: str,
                    v: str | None = None) -> DataFrame:
    """Rows a model uses, with their fixed part, predicted group effect, fitted value and residual.

    Group effects are the best linear predictions at the fitted variances: one sum per group, joined back.
    """
    found = fits.where(F.col("model") == model.name).select("beta", "sigma2", "tau2", "error_variance").first()
    if found is None or found["sigma2"] is None:
        raise ValueError(f"model {model.name} has no estimate")
    rows = df.where(model.where) if model.where else df
    fixed = " + ".join(f"{double_text(b)} * CAST(({e}) AS DOUBLE)" for b, e in zip(found["beta"], model.columns.values()))
    noise = F.lit(float(found["error_variance"])) if v is None else F.col(v) + F.lit(float(found["tau2"]))
    rows = rows.withColumns({"fixed": F.expr(fixed), "__w": 1.0 / noise}).where(
        F.col("fixed").isNotNull() & F.col(response).isNotNull() & F.col(group).isNotNull() & (F.col("__w") > 0))
    sums = rows.groupBy(group).agg(F.sum("__w").alias("__sw"),
                                   F.sum(F.col("__w") * (F.col(response) - F.col("fixed"))).alias("__swr"))
    s2 = float(found["sigma2"])
    out = match(rows, sums, [group], "left").withColumn("effect", s2 * F.col("__swr") / (1 + s2 * F.col("__sw")))
    out = out.withColumn("fitted", F.col("fixed") + F.col("effect"))
    return out.withColumn("resid", F.col(response) - F.col("fitted")).drop("__w", "__sw", "__swr")


def quantile_pairs(df: DataFrame, value: str, key: str) -> DataFrame:
    """Every residual with its rank, plotting position and normal quantile.

    Ranks come from the blocked running count, so the table is sorted in ranges.
    """
    rows = df.where(F.col(value).isNotNull()).select(key, F.col(value).alias("value"))
    ranked = sequence_in_group(rows, [], ["value", key], out="rank")
    n = rows.agg(F.count(F.lit(1))).scalar()
    # Plotting positions: (i − a) / (n + 1 − 2a) with a = 3/8 up to ten rows, 1/2 beyond.
    offset = F.when(n <= 10, F.lit(0.375)).otherwise(F.lit(0.5))
    placed = ranked.withColumn("prob", (F.col("rank") - offset) / (n + 1 - 2 * offset))
    return placed.withColumn("normal", normal_quantile_column("prob"))


def partial_effect(df: DataFrame, fit: LinearModel, x: str, *, by: str | None = None, points: int = 101,
                   typical: Mapping[str, object] | None = None) -> DataFrame:
    """Fitted curve along one covariate with t limits.

    Other covariates are held at ``typical`` values: by default the median of
    a number and the commonest level of a factor. ``by`` gives a curve per
    level of a factor.
    """
    spark = df.sparkSession
    raw = sorted({a for t in fit.design.terms for a in _raw_names(t)})
    limits = df.agg(F.min(x), F.max(x)).first()
    held = dict(typical or {})
    for name in raw:
        if name != x and name not in held:
            held[name] = quantiles(df, [], name, [0.5], ["m"]).first()["m"]
    for f in fit.design.factors:
        if f != by and f not in held:
            held[f] = df.where(F.col(f).isNotNull()).groupBy(f).count().orderBy(F.desc("count"), f).first()[0]
    lo, hi = float(limits[0]), float(limits[1])
    levels = list(fit.design.levels[by]) if by else [None]
    grid = spark.range(points).select((F.lit(lo) + F.col("id") * ((hi - lo) / (points - 1))).alias(x))
    grid = grid.withColumns({k: F.lit(v) for k, v in held.items()})
    if by:
        grid = grid.withColumn(by, F.explode(F.array(*[F.lit(v) for v in levels])))
    _, cov = raw_coefficients(fit)
    numerics = fit.design.numerics()
    xs = [column_expression(c, numerics) for c in fit.columns]
    grid = grid.withColumns({f"__d{i}": e for i, e in enumerate(xs)}).withColumn("fit", fitted_column(fit))
    size = range(len(xs))
    variance = F.expr(" + ".join(
        f"__d{i} * __d{j} * {double_text(cov[i, j])}" for i in size for j in size if cov[i, j]) or "0D")
    t = float(t_quantile(0.975, fit.df_residual))
    grid = grid.withColumn("se", F.sqrt(F.greatest(variance, F.lit(0.0))))
    return grid.withColumns({"lower": F.col("fit") - t * F.col("se"), "upper": F.col("fit") + t * F.col("se")}).select(
        x, *([by] if by else []), "fit", "se", "lower", "upper")


def _raw_names(term) -> list[str]:
    return [m for _, e in term.atoms for m in re.findall(r"`([^`]+)`", e)]


# Many straight lines, correlations -------------------------------------------


def line_per_group(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Least-squares line of y on x for every group, with built-in aggregates."""
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"), F.count(F.lit(1)).alias("n"))


def correlation_test(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Pearson r, t, P and Fisher-z 95 % limits per key."""
    base = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(
        F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"))
    out = base.withColumns({
        "df": (F.col("n") - 2).cast("double"),
        "t": F.col("r") * F.sqrt(ratio(F.col("n") - 2, 1 - F.col("r") * F.col("r"))),
    }).withColumn("p", p_t("t", "df"))
    half = F.lit(Z_95) / F.sqrt(F.col("n") - F.lit(3))
    enough = F.col("n") > 3
    return out.withColumns({
        "ci_lb": F.when(enough, F.tanh(F.atanh("r") - half)), "ci_ub": F.when(enough, F.tanh(F.atanh("r") + half))})


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise correlations of columns (each over rows complete in both), one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    row = df.agg(*[F.corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"r{k}").alias("r"))
        for k, (a, b) in enumerate(pairs)])))


# Random intercept --------------------------------------------------------------


def random_intercept(df: DataFrame, models: Sequence[mixed.Model], *, response: str, group: str,
                     outcome: str | None = None) -> DataFrame:
    """Mixed models with an estimated error variance and a random intercept per group, by REML."""
    return mixed.fit(df, models, y=response, v=None, group=group, random="group", outcome=outcome)


def wald_table(fits: DataFrame) -> DataFrame:
    """Wald χ² with one degree of freedom for each coefficient."""
    out = coefficients(fits).select("model", "term", "estimate", "se", "zval")
    return out.withColumn("chisq", F.col("zval") ** 2).withColumn("p", p_normal("zval")).drop("zval")


def f_table(fits: DataFrame) -> DataFrame:
    """F of each coefficient of a mixed model with one and approximate (Satterthwaite) degrees of freedom, and its P.

    Models without an estimated error variance, or without spare rows, give NULL.
    """
    out = fits.select("model", "vcov", "p", F.posexplode(F.arrays_zip("names", "beta", F.coalesce(
        "df", F.transform("beta", lambda b: F.lit(None).cast("double"))).alias("df"))).alias("at", "one"))
    variance = F.get("vcov", F.col("at") * (F.col("p") + 1))
    return out.select(
        "model", F.col("one.names").alias("term"), ratio(F.col("one.beta") ** 2, variance).alias("f"),
        F.lit(1.0).alias("df1"), F.col("one.df").alias("df2")).withColumn("f", F.when(F.col("df2").isNotNull(), F.col("f"))).withColumn(
        "p", p_f("f", "df1", "df2"))


# Additive smooths ----------------------------------------------------------------


@dataclass
class Additive:
    """Penalised fit; ``cov`` is the Bayesian covariance, ``beta[0]`` belongs to uncentred columns, ``means`` are column means."""
    response: str
    bases: dict[str, list[float]]
    parametric: Design
    names: list[str]
    beta: np.ndarray
    cov: np.ndarray
    means: np.ndarray
    edf: float
    edf_of: dict[str, float]
    penalty: dict[str, float]
    variance: float
    gcv: float
    n: float
    rss: float
    r2: float


def _spline_terms(x: str, knots: Sequence[float]) -> dict[str, str]:
    """Natural cubic basis on given knots: one linear and len(knots) − 2 curved columns, scaled to unit range."""
    low, span = knots[0], knots[-1] - knots[0]
    u = f"((`{x}` - ({low!r})) / {span!r})"
    k = [(v - low) / span for v in knots]

    def cube(t: float) -> str:
        return f"power(greatest({u} - ({t!r}), 0D), 3)"

    def ramp(i: int) -> str:
        return f"(({cube(k[i])} - {cube(k[-1])}) / {k[-1] - k[i]!r})"

    terms = {f"{x}.1": u}
    for i in range(len(k) - 2):
        terms[f"{x}.{i + 2}"] = f"({ramp(i)} - {ramp(len(k) - 2)})"
    return terms


def _bend_penalty(knots: Sequence[float]) -> np.ndarray:
    """∫ f''² of the curved columns, by Simpson's rule on pieces where f'' is linear."""
    low, span = knots[0], knots[-1] - knots[0]
    k = np.array([(v - low) / span for v in knots])

    def second(i, t):
        ramp = lambda j: 6 * (np.maximum(t - k[j], 0) - np.maximum(t - k[-1], 0)) / (k[-1] - k[j])
        return ramp(i) - ramp(len(k) - 2)

    size = len(k) - 2
    out = np.zeros((size, size))
    for a, b in zip(k[:-1], k[1:]):
        t = np.array([a, (a + b) / 2, b])
        f = np.array([second(i, t) for i in range(size)])
        out += (f * np.array([1, 4, 1]) * (b - a) / 6) @ f.T
    return out


def _smoothing(gram: np.ndarray, cross: np.ndarray, yy: float, n: float, parts: Mapping[str, np.ndarray],
               rounds: int = 400) -> dict[str, float]:
    """Penalty of every part by Fellner–Schall steps, which raise the restricted likelihood.

    Each step sets a penalty to variance × (rank / penalty − trace) / roughness times its last value. A part
    without roughness grows to a bound, where its curve is a straight line.
    """
    rank = {x: np.linalg.matrix_rank(s, hermitian=True) for x, s in parts.items()}
    size = {x: np.trace(gram[s.any(axis=0)][:, s.any(axis=0)]) / max(np.trace(s), 1e-300) for x, s in parts.items()}
    lam = dict(size)
    for _ in range(rounds):
        inverse, _ = scaled_pinv(gram + sum(lam[x] * s for x, s in parts.items()))
        beta = inverse @ cross
        rss = max(yy - 2 * beta @ cross + beta @ gram @ beta, 1e-12 * yy)
        variance = rss / max(n - float(np.trace(inverse @ gram)), 1e-9)
        last = dict(lam)
        for x, s in parts.items():
            spare = max(rank[x] - lam[x] * float(np.trace(inverse @ s)), 1e-12)
            rough = max(float(beta @ s @ beta), 1e-300)
            lam[x] = float(np.clip(variance * spare / rough, 1e-9 * size[x], 1e7 * size[x]))
        if all(abs(np.log(lam[x] / last[x])) < 1e-7 for x in parts):
            break
    return lam


def additive(df: DataFrame, response: str, smooths: Sequence[str], *, basis: int = 4,
             parametric: Design | None = None) -> Additive:
    """Sum of penalised cubic regression splines, each with its own smoothing by restricted likelihood.

    One pass gives the knots of all smooths, one the cross products of all basis columns; the penalty search
    then runs on that matrix alone. Rows lacking the response or a covariate are left out of the fit.
    """
    parametric = parametric or Design([])
    names = [f"k{i}" for i in range(basis)]
    values = F.explode(F.array(*[F.struct(F.lit(x).alias("smooth"), F.col(x).cast("double").alias("value")) for x in smooths]))
    stacked = df.select(values.alias("at")).select("at.*")
    found = {r["smooth"]: [float(r[n]) for n in names]
             for r in quantiles(stacked, ["smooth"], "value", [i / (basis - 1) for i in range(basis)], names).collect()}
    bases: dict[str, list[float]] = {}
    extra: dict[str, str] = {}
    for x in smooths:
        knots = found.get(x, [])
        if len(set(knots)) != basis:
            raise ValueError(f"knots of {x} repeat or are missing; use a smaller basis")
        bases[x] = knots
        extra.update(_spline_terms(x, knots))
    design = Design([*parametric.terms, *[Term(atoms=((n, e),)) for n, e in extra.items()]], True, parametric.levels)
    moments = collect_moments(df, design, [response])
    cols, ys = design.columns(), as_columns([response])
    gram, cross, yy = moments.cross(cols, cols), moments.cross(cols, ys)[:, 0], float(moments.cross(ys, ys)[0, 0])
    places = {c.name: i for i, c in enumerate(cols)}
    parts = {}
    for x, knots in bases.items():
        at = [places[f"{x}.{i + 2}"] for i in range(len(knots) - 2)]
        parts[x] = np.zeros_like(gram)
        parts[x][np.ix_(at, at)] = _bend_penalty(knots)
    n = moments.n
    lam = _smoothing(gram, cross, yy, n, parts)
    inverse, _ = scaled_pinv(gram + sum(lam[x] * s for x, s in parts.items()))
    beta = inverse @ cross
    rss = max(float(yy - 2 * beta @ cross + beta @ gram @ beta), 0.0)
    share = np.diag(inverse @ gram)
    edf = float(share.sum())
    variance = rss / (n - edf)
    means = gram[0] / n
    beta = beta.copy()
    for i, c in enumerate(cols):  # back to uncentred columns
        if c.numeric:
            beta[0] -= beta[i] * moments.shift[c.numeric]
            means[i] += moments.shift[c.numeric]
    beta[0] += moments.shift[response]
    total = yy - cross[0] ** 2 / n
    own = {x: float(sum(share[places[name]] for name in _spline_terms(x, knots))) for x, knots in bases.items()}
    return Additive(response, bases, parametric, [c.name for c in cols], beta, inverse * variance, means, edf, own, lam, variance,
                    float(n * rss / (n - edf) ** 2), n, rss, float(1 - rss / total))


def smooth_curve(spark: SparkSession, fit: Additive, x: str, points: int = 100) -> DataFrame:
    """The fitted smooth of one covariate, centred over the rows, with its error and 95 % band."""
    knots = fit.bases[x]
    step = (knots[-1] - knots[0]) / (points - 1)
    grid = spark.range(points).select((F.lit(knots[0]) + F.col("id") * step).alias(x))
    terms = _spline_terms(x, knots)
    at = [fit.names.index(name) for name in terms]
    shape = [F.expr(e) - F.lit(float(fit.means[i])) for i, e in zip(at, terms.values())]
    value = sum((d * F.lit(float(fit.beta[i])) for i, d in zip(at, shape)), F.lit(0.0))
    spread = sum((d * e * F.lit(float(fit.cov[i, j])) for i, d in zip(at, shape) for j, e in zip(at, shape)), F.lit(0.0))
    t = float(t_quantile(0.975, fit.n - fit.edf))
    grid = grid.withColumns({"smooth": value, "se": F.sqrt(F.greatest(spread, F.lit(0.0)))})
    return grid.withColumns({"lower": F.col("smooth") - t * F.col("se"), "upper": F.col("smooth") + t * F.col("se")})


def additive_summary(spark: SparkSession, fit: Additive) -> DataFrame:
    """One row per smooth: its effective degrees of freedom and penalty, beside the figures of the whole fit."""
    return spark.createDataFrame(
        [(fit.response, x, fit.edf_of[x], fit.penalty[x], float(fit.n), fit.edf, fit.variance, fit.gcv, fit.rss, fit.r2)
         for x in fit.bases],
        "response string, smooth string, smooth_edf double, penalty double, n double, edf double, variance double, gcv double, "
        "rss double, r2 double")


# Regression tree -------------------------------------------------------------------


def regression_tree(df: DataFrame, response: str, features: Sequence[str], *, max_depth: int = 4,
                    min_rows: int = 10, min_gain: float = 0.0, seed: int = 1) -> DataFrame:
    """Regression tree as a table of nodes: split, rows, mean and deviance."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    ready = df.select(F.col(response).cast("double").alias("label"), *features).dropna()
    vector = VectorAssembler(inputCols=list(features), outputCol="features").transform(ready)
    tree = DecisionTreeRegressor(maxDepth=max_depth, minInstancesPerNode=min_rows, minInfoGain=min_gain,
                                 seed=seed).fit(vector)
    folder = shared_folder(df.sparkSession)
    tree.write().save(f"{folder}/tree")  # the saved model is itself a table of nodes
    names = F.array(*[F.lit(f) for f in features])
    leaf = F.col("leftChild") < 0
    return df.sparkSession.read.parquet(f"{folder}/tree/data").select(
        F.col("id").alias("node"),
        F.when(~leaf, F.get(names, F.col("split.featureIndex"))).alias("split"),
        F.when(~leaf, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("cut"),
        F.when(~leaf, F.col("leftChild")).alias("if_low"), F.when(~leaf, F.col("rightChild")).alias("if_high"),
        F.col("rawCount").alias("n"), F.col("prediction").alias("mean"),
        (F.col("impurity") * F.col("rawCount")).alias("deviance"), leaf.alias("leaf"))


# Box-Cox ------------------------------------------------------------------------------


def box_cox_profile(df: DataFrame, keys: Sequence[str], value: str, *, low: float = -2.0, high: float = 2.0,
                    step: float = 0.1) -> DataFrame:
    """Log likelihood of each power over a grid, for a one-way layout by ``keys``.

    The grid is an array of sums in one aggregation, so rows are not repeated.
    """
    count = int(round((high - low) / step)) + 1
    lambdas = [round(low + i * step, 10) for i in range(count)]
    rows = df.where(F.col(value).isNotNull())
    if rows.where(F.col(value) <= 0).limit(1).count():
        raise ValueError(f"{value} must be positive")
    scale = rows.agg(F.struct(F.avg(F.ln(value)).alias("m"), F.count(F.lit(1)).alias("n")).alias("s")).first()["s"]
    z = F.col(value) / F.lit(float(np.exp(scale["m"])))  # unit geometric mean

    def power(lam: float) -> Column:
        return F.ln(z) if abs(lam) < 1e-9 else (F.pow(z, F.lit(lam)) - 1) / lam

    within = rows.groupBy(*keys).agg(*[
        (F.var_pop(power(lam)) * F.count(F.lit(1))).alias(f"s{i}") for i, lam in enumerate(lambdas)])
    total = within.agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(count)])
    points = F.array(*[F.struct(F.lit(lam).alias("power"), F.col(f"s{i}").alias("rss"))
                       for i, lam in enumerate(lambdas)])
    return total.select(F.inline(points)).select(
        "power", (F.lit(-float(scale["n"]) / 2) * F.ln("rss")).alias("loglik"))


def best_power(profile: DataFrame) -> DataFrame:
    return profile.agg(F.max_by("power", "loglik").alias("power"), F.max("loglik").alias("loglik"))


def transformed_variants(df: DataFrame, value: str, power: float, *, keep: Sequence[str] = ()) -> DataFrame:
    """Long table of common transformations of a positive column."""
    x = F.col(value).cast("double")
    variants = {
        "raw": x, "log": F.ln(x), "sqrt": F.sqrt(x), "power(1/3)": F.pow(x, F.lit(1.0 / 3.0)),
        "inverse": ratio(F.lit(1.0), x), "Box Cox": F.pow(x, F.lit(float(power))),
    }
    packed = F.array(*[F.struct(F.lit(n).alias("variant"), e.alias("value")) for n, e in variants.items()])
    return df.where(x > 0).select(*keep, F.inline(packed))
