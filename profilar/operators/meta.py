"""Meta-analysis results from fitted models: tables, comparison, prediction, weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profilar.functions.distributions import Z_95, p_chi2, p_normal
from profilar.functions.linalg import scaled_pinv
from profilar.functions.nulls import ratio
from profilar.operators import mixed
from profilar.operators.aggregate import count_rows
from profilar.operators.joins import match, union_padded


def coefficients(fits: DataFrame) -> DataFrame:
    """One row per model and coefficient: estimate, se, z, P and 95 % limits."""
    rows = fits.select("model", "p", "vcov", F.posexplode(F.arrays_zip("names", "beta")).alias("i", "c"))
    variance = F.get("vcov", F.col("i") * F.col("p") + F.col("i"))
    out = rows.select("model", F.col("i").alias("place"), F.col("c.names").alias("term"),
                      F.col("c.beta").alias("estimate"), F.sqrt(variance).alias("se"))
    out = out.withColumn("zval", ratio("estimate", "se"))
    return out.withColumns({
        "pval": p_normal("zval"),
        "ci_lb": F.col("estimate") - Z_95 * F.col("se"),
        "ci_ub": F.col("estimate") + Z_95 * F.col("se"),
    })


def information(fits: DataFrame, method: str = "REML") -> DataFrame:
    """Fit statistics: log likelihood, AIC, BIC, AICc, heterogeneity and omnibus tests.

    AICc is missing for a model with too few rows for its correction.
    """
    k = F.col("p") + F.col("n_components")
    n = F.col("n") - F.col("p") if method == "REML" else F.col("n")
    aic = -2 * F.col("loglik") + 2 * k
    out = fits.select(
        "model", "n", "p", "n_groups", "sigma2", "tau2", "loglik", k.alias("df"), aic.alias("aic"),
        (-2 * F.col("loglik") + k * F.ln(n.cast("double"))).alias("bic"),
        (-2 * F.col("loglik") + 2 * k * ratio(n, F.when(n - k - 1 > 0, n - k - 1))).alias("aicc"),
        F.col("q_residual").alias("qe"), (F.col("n") - F.col("p")).alias("qe_df"),
        F.col("q_model").alias("qm"), F.col("q_model_df").alias("qm_df"))
    return out.withColumns({"qe_p": p_chi2("qe", "qe_df"), "qm_p": p_chi2("qm", "qm_df")})


def compare(fits: DataFrame, sets: Mapping[str, Sequence[str]] | None = None, method: str = "REML") -> DataFrame:
    """df and AICc per model, ranked within each candidate set; models without an estimate come last.

    ``sets`` names the models to compare together; without it all form one set.
    Models are few: the ranking window runs over one row per model.
    """
    info = information(fits, method).select("model", "df", "aicc")
    if sets:
        rows = [(s, m) for s, models in sets.items() for m in models]
        listed = fits.sparkSession.createDataFrame(rows, "candidate_set string, model string")
        info = listed.join(info, "model")
    else:
        info = info.withColumn("candidate_set", F.lit("all"))
    w = Window.partitionBy("candidate_set")
    return info.withColumns({
        "delta": F.col("aicc") - F.min("aicc").over(w),
        "rank": F.rank().over(w.orderBy(F.col("aicc").asc_nulls_last())).cast("bigint"),
    })


def _usable(model: mixed.Model, y: str, v: str) -> str:
    """SQL test for the effects that a model can use."""
    tests = [f"`{y}` IS NOT NULL", f"`{v}` > 0", *[f"({e}) IS NOT NULL" for e in model.columns.values()]]
    return " AND ".join(tests + ([f"({model.where})"] if model.where else []))


def typical_variance(effects: DataFrame, models: Sequence[mixed.Model], y: str = "yi", v: str = "vi") -> dict[str, float | None]:
    """(k − p) / tr(P) per model, P the residual weight matrix: one pass of weighted cross products for all models."""
    sums = []
    for n, m in enumerate(models):
        xs = [f"CAST(({e}) AS DOUBLE)" for e in m.columns.values()]
        products = [f"sum(CASE WHEN {_usable(m, y, v)} THEN {a} * {b} / power(`{v}`, {power}) END)"
                    for power in (1, 2) for a in xs for b in xs]
        counts = [f"CAST(sum(CASE WHEN {_usable(m, y, v)} THEN 1 ELSE 0 END) AS DOUBLE)",
                  f"sum(CASE WHEN {_usable(m, y, v)} THEN 1 / `{v}` END)"]
        sums.append(F.expr(f"array({', '.join(counts + products)})").alias(f"m{n}"))
    row, out = effects.agg(*sums).first(), {}
    for n, m in enumerate(models):
        p, (k, weight, *rest) = len(m.columns), row[f"m{n}"]
        if any(r is None for r in (weight, *rest)) or k <= p:
            out[m.name] = None
            continue
        once, twice = np.array(rest, dtype=float).reshape(2, p, p)
        inverse, rank = scaled_pinv(once)
        trace = weight - float(np.trace(inverse @ twice))
        out[m.name] = (k - rank) / trace if trace > 0 else None
    return out


def model_performance(fits: DataFrame, effects: DataFrame, models: Sequence[mixed.Model] | None = None, y: str = "yi",
                      v: str = "vi") -> DataFrame:
    """Heterogeneity summaries per model: τ² + σ², H², I², with the information criteria.

    ``models`` are those of ``fits``; without them every model is an intercept over all effects.
    """
    if models is None:
        models = [mixed.intercept_and(name=r["model"]) for r in fits.select("model").distinct().collect()]
    values = [(name, value) for name, value in typical_variance(effects, models, y, v).items()]
    table = fits.sparkSession.createDataFrame(values, "model string, typical double")
    spread = F.col("sigma2") + F.col("tau2")
    return match(information(fits), table, ["model"], "left", null_safe=False).select(
        "model", spread.alias("tau2"), ratio(spread, spread + F.col("typical")).alias("i2"),
        (1 + ratio(spread, "typical")).alias("h2"), "qe", "qe_df", "qe_p", "aic", "bic", "aicc")


def with_level_counts(table: DataFrame, effects: DataFrame, column: str, kind: str) -> DataFrame:
    """Add the number of effects per level to the coefficients of a level-means model."""
    counts = count_rows(effects.where(F.col(column).isNotNull()), [column], "size").select(
        F.concat(F.lit(f"{column}["), F.col(column).cast("string"), F.lit("]")).alias("term"),
        F.col(column).cast("string").alias("grp"), "size")
    return match(table, counts, ["term"], "left", null_safe=False).withColumn("type", F.lit(kind))


def predict(fits: DataFrame, grid: DataFrame, terms: Mapping[str, Column | str]) -> DataFrame:
    """Fitted value and 95 % limits on a grid.

    ``terms`` gives, for each coefficient in order, its value on the grid (a
    column). Every model must have exactly these coefficients; grid and models
    are joined through the model key of the grid.
    """
    xs = [F.expr(t) if isinstance(t, str) else t for t in terms.values()]
    p = len(xs)
    joined = grid.join(fits.select("model", "beta", "vcov"), "model")
    value, variance = F.lit(0.0), F.lit(0.0)
    for i in range(p):
        value = value + F.col("beta")[i] * xs[i]
        for j in range(p):
            variance = variance + F.col("vcov")[i * p + j] * xs[i] * xs[j]
    out = joined.withColumns({"pred": value, "se": F.sqrt(variance)})
    return out.withColumns({
        "ci_lb": F.col("pred") - Z_95 * F.col("se"), "ci_ub": F.col("pred") + Z_95 * F.col("se"),
    }).drop("beta", "vcov")


def row_weights(effects: DataFrame, fits: DataFrame, *, key: str, v: str = "vi", y: str = "yi", group: str = "site",
                models: Sequence[mixed.Model] | None = None) -> DataFrame:
    """Percent weight of every effect in every model: the diagonal of the inverse covariance.

    An effect counts in a model that can use it; ``models`` tells which columns each needs (none: an intercept). Effects
    meet models, of which there are few, as an array of their variances.
    """
    if models is None:
        models = [mixed.intercept_and(name=r["model"]) for r in fits.select("model").distinct().collect()]
    use = F.lit(False)
    for m in models:
        use = use | ((F.col("__m.model") == m.name) & F.expr(_usable(m, y, v)))
    variances = fits.agg(F.collect_list(F.struct("model", "sigma2", "tau2"))).scalar()
    w = effects.withColumn("__m", F.explode(variances)).where(use).withColumns({
        "model": F.col("__m.model"), "__s2": F.col("__m.sigma2"), "__w": 1.0 / (F.col(v) + F.col("__m.tau2"))})
    sums = w.groupBy("model", group).agg(F.sum("__w").alias("__sw"))
    joined = match(w, sums, ["model", group], "left")
    g = F.col("__s2") / (1 + F.col("__s2") * F.col("__sw"))
    diag = joined.select("model", key, group, (F.col("__w") - g * F.col("__w") ** 2).alias("__d"))
    totals = diag.groupBy("model").agg(F.sum("__d").alias("__total"))
    return match(diag, totals, ["model"], "left", null_safe=False).select(
        "model", key, group, (F.col("__d") * 100 / F.col("__total")).alias("weight"))


def pooled_moments(effects: DataFrame, by: Sequence[str] = (), y: str = "yi", v: str = "vi") -> DataFrame:
    """Closed-form pooling per key: equal-effects and moment-based random-effects estimates."""
    w = 1 / F.col(v)
    sums = effects.where((F.col(v) > 0) & F.col(y).isNotNull()).groupBy(*by).agg(
        F.sum(w).alias("w"), F.sum(w * w).alias("w2"), F.sum(w * F.col(y)).alias("wy"),
        F.sum(w * F.col(y) * F.col(y)).alias("wyy"), F.count(F.lit(1)).alias("k"))
    q = F.col("wyy") - ratio(F.col("wy") ** 2, "w")
    tau2 = F.greatest(F.lit(0.0), ratio(q - (F.col("k") - 1), F.col("w") - ratio("w2", "w")))
    return sums.select(*by, "k", ratio("wy", "w").alias("estimate"), F.sqrt(ratio(F.lit(1.0), "w")).alias("se"),
                       q.alias("q"), tau2.alias("tau2_moment"))


def forest_table(effects: DataFrame, summary: DataFrame, *, label: str, weights: DataFrame | None = None) -> DataFrame:
    """Rows of a forest display: each effect the models can use, with limits and weight, then the summary."""
    rows = effects.where(F.col("yi").isNotNull() & (F.col("vi") > 0)).select(F.col(label).alias("label"), F.col("yi").alias("estimate"), F.col("lci").alias("ci_lb"),
                          F.col("uci").alias("ci_ub"), F.lit("effect").alias("type"))
    if weights is not None:
        rows = match(rows, weights.select(F.col(label).alias("label"), "weight"), ["label"], "left")
    total = summary.select(F.col("term").alias("label"), "estimate", "ci_lb", "ci_ub", F.lit("summary").alias("type"))
    return union_padded(rows, total)


def facet_table(*tables: DataFrame) -> DataFrame:
    """Stack level tables of several moderators."""
    return union_padded(*tables)


fit = mixed.fit
