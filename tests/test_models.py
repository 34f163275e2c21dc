"""Linear algebra against dense NumPy on small fixtures, and published example values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from profilar.functions import distributions as dist
from profilar.operators import distance, meta, mixed, monotone, ordination, permute, regress
from profilar.operators.design import Design, crossed, factor, logged, num, squared
from profilar.operators.moments import gram_of_arrays, moment_rows

SPECIES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    n = 90
    site = rng.choice(["s1", "s2", "s3"], n, p=[0.5, 0.3, 0.2])
    trt = rng.choice(["ctl", "t1", "t2"], n)
    cn, wn = rng.normal(2000, 2, n), rng.normal(5, 1, n)
    raw = rng.gamma(2.0, 1.0, (n, 4)) + 0.2 * (trt == "t1")[:, None] * np.arange(4) + 0.1 * np.abs(cn - 2000)[:, None]
    y = np.sqrt(raw / raw.sum(1, keepdims=True))
    resp = 1 + 0.3 * wn + 0.5 * (trt == "t2") + (site == "s2") * 0.7 + rng.normal(0, 0.4, n)
    return dict(n=n, key=np.arange(n), site=site, trt=trt, cn=cn, wn=wn, y=y, resp=resp)


@pytest.fixture(scope="module")
def frame(spark, rows):
    data = [(int(rows["key"][i]), str(rows["site"][i]), str(rows["trt"][i]), float(rows["cn"][i]), float(rows["wn"][i]),
             *map(float, rows["y"][i]), float(rows["resp"][i])) for i in range(rows["n"])]
    return spark.createDataFrame(
        data, "key bigint, site string, trt string, cn double, wn double, a double, b double, c double, d double, "
              "resp double").cache()


LV = {"site": ["s1", "s2", "s3"], "trt": ["ctl", "t1", "t2"]}


def dummies(values, levels):
    return np.array([[float(v == lev) for lev in levels[1:]] for v in values])


def hat(x):
    return x @ np.linalg.pinv(x)


def dense_rda(y, x, z):
    n = len(y)
    one = np.ones((n, 1))
    z1 = np.hstack([one] + ([z] if z is not None else []))
    full = np.hstack([z1, x])
    fit = hat(full) @ y - hat(z1) @ y
    resid = y - hat(full) @ y
    return fit, resid, y - hat(z1) @ y, np.linalg.matrix_rank(full) - np.linalg.matrix_rank(z1)


def test_partial_rda_matches_dense(spark, rows, frame):
    s, t = dummies(rows["site"], LV["site"]), dummies(rows["trt"], LV["trt"])
    inter = np.hstack([t[:, [i]] * s[:, [j]] for i in range(2) for j in range(2)])
    fit_y, resid, inner, rank = dense_rda(rows["y"], np.hstack([t, s, inter]), s)
    n = rows["n"]
    fit = ordination.redundancy(frame, SPECIES, Design(crossed(factor("trt"), factor("site")), levels=LV),
                                Design([factor("site")], levels=LV))
    assert fit.constrained == pytest.approx(np.sum(fit_y ** 2) / (n - 1), rel=1e-9)
    assert fit.residual == pytest.approx(np.sum(resid ** 2) / (n - 1), rel=1e-9)
    assert fit.total == pytest.approx(fit.conditioned + fit.constrained + fit.residual, rel=1e-9)
    assert fit.rank_constraint == rank
    u, sv, vt = np.linalg.svd(fit_y, full_matrices=False)
    assert fit.eigenvalues[:fit.n_constrained] == pytest.approx(sv[:fit.n_constrained] ** 2 / (n - 1), rel=1e-7)
    # Row scores: weighted sums of the conditioned rows, symmetric scaling.
    got = {r["key"]: r["RDA1"] for r in ordination.row_scores(frame, fit, choices=[1], scaling=3).collect()}
    v = fit.vectors[:, 0]
    lam = fit.eigenvalues[0]
    want = inner @ v / np.sqrt(lam * (n - 1)) * (lam / fit.total) ** 0.25 * ((n - 1) * fit.total) ** 0.25
    assert [got[k] for k in range(n)] == pytest.approx(list(want), rel=1e-7, abs=1e-10)
    assert np.abs(vt[0] @ v) == pytest.approx(1.0, abs=1e-9)


def test_continuous_rda_and_margin(spark, rows, frame):
    x = np.column_stack([rows["cn"] - rows["cn"].mean(), rows["wn"]])
    s = dummies(rows["site"], LV["site"])
    fit_y, resid, _, _ = dense_rda(rows["y"], x, s)
    fit = ordination.redundancy(frame, SPECIES, Design([num("cn"), num("wn")]), Design([factor("site")], levels=LV))
    assert fit.constrained * (rows["n"] - 1) == pytest.approx(np.sum(fit_y ** 2), rel=1e-8)
    table = {r["term"]: r for r in permute.permutation_test(frame, fit, key="key", by="margin", n_perm=49).collect()}
    small, _, _, _ = dense_rda(rows["y"], x[:, [1]], s)
    ss = np.sum(fit_y ** 2) - np.sum(small ** 2)
    want = ss / (np.sum(resid ** 2) / (rows["n"] - 5))
    assert table["cn"]["f"] == pytest.approx(want, rel=1e-6)
    assert 0 < table["cn"]["p"] <= 1 and table["cn"]["df"] == 1
    axes = permute.permutation_test(frame, fit, key="key", by="axis", n_perm=19).collect()
    assert axes[0]["f"] == pytest.approx(fit.eigenvalues[0] * (rows["n"] - 1) / (np.sum(resid ** 2) / (rows["n"] - 5)), rel=1e-6)


def test_permutation_identity_and_blocks(spark, rows, frame, monkeypatch):
    design = Design([factor("trt")], levels=LV)
    fit = ordination.redundancy(frame, SPECIES, design)
    plain = permute.permutation_test(frame, fit, key="key", strata=["site"], n_perm=60, seed=5).first()
    again = permute.permutation_test(frame.repartition(3), fit, key="key", strata=["site"], n_perm=60, seed=5).first()
    monkeypatch.setattr(permute, "CHUNK_ROWS", 700)
    monkeypatch.setattr(permute, "BLOCK", 50)
    blocked = permute.permutation_test(frame, fit, key="key", strata=["site"], n_perm=60, seed=5).first()
    assert plain == again == blocked


def test_permuted_rows_stay_in_stratum(spark, frame):
    from profilar.operators.ordered import sequence_in_group

    base = frame.select(F.col("key").alias("__key"), "site", F.col("a").alias("y0"), F.lit(1.0).alias("x0"))
    base = sequence_in_group(base, ["site"], ["__key"], out="__place")
    got = permute.permuted_moments(base, ["site"], ["site"], 1, 1, 1, 5, 1)
    sums = {r["site"]: r["s"] for r in frame.groupBy("site").agg(F.sum("a").alias("s")).collect()}
    for r in got.collect():
        assert r["cross"][0] == pytest.approx(sums[r["site"]])


def test_group_ordinations_equal_single_ones(spark, frame):
    design = Design([factor("trt")], levels=LV)
    by = {r["site"]: r for r in ordination.redundancy_by(frame, "site", SPECIES, design).where("axis = 'RDA1'").collect()}
    for s in LV["site"]:
        one = ordination.redundancy(frame.where(F.col("site") == s), SPECIES, design)
        assert by[s]["eigenvalue"] == pytest.approx(one.eigenvalues[0], rel=1e-8)
        assert by[s]["constrained"] == pytest.approx(one.constrained, rel=1e-8)
        assert by[s]["loadings"] == pytest.approx(list(one.vectors[:, 0]), abs=1e-7)
    fits = ordination.redundancy_by(frame, "site", SPECIES, design)
    scored = {r["key"]: r["RDA1"] for r in ordination.row_scores_by(frame, fits, "site", SPECIES).collect()}
    alone = ordination.redundancy(frame.where("site = 's1'"), SPECIES, design)
    for r in ordination.row_scores(frame.where("site = 's1'"), alone, choices=[1], scaling=3).collect():
        assert scored[r["key"]] == pytest.approx(r["RDA1"], rel=1e-6, abs=1e-9)


def test_conditioned_group_ordinations_equal_single_ones(spark, frame):
    constraint = Design(crossed(factor("trt"), num("wn")), levels=LV)
    condition = Design([num("wn")], levels=LV)
    tagged = frame.withColumn("half", F.when(F.col("site") == LV["site"][0], "one").otherwise("other"))
    fits = ordination.redundancy_by(tagged, "half", SPECIES, constraint, condition)
    first = {r["half"]: r for r in fits.where("axis = 'RDA1'").collect()}
    scored = {r["key"]: r["RDA1"] for r in ordination.row_scores_by(
        tagged, fits, "half", SPECIES, constraint=constraint, condition=condition).collect()}
    cols = {(r["half"], r["species"]): r for r in ordination.species_scores_by(fits, "half", SPECIES, labels={SPECIES[0]: "A"}).collect()}
    assert set(first) == {"one", "other"}
    for half, r in first.items():
        part = tagged.where(F.col("half") == half)
        one = ordination.redundancy(part, SPECIES, constraint, condition)
        assert [r["total"], r["conditioned"], r["constrained"], r["residual"]] == pytest.approx(
            [one.total, one.conditioned, one.constrained, one.residual], rel=1e-7)
        assert (r["df_condition"], r["df_model"], r["df_residual"]) == (one.rank_condition, one.rank_constraint, one.residual_df)
        assert r["label"] == ordination.axis_table(spark, one).first()["label"]
        for x in ordination.row_scores(part, one, choices=[1], scaling=3).collect():
            assert scored[x["key"]] == pytest.approx(x["RDA1"], rel=1e-6, abs=1e-8)
        alone = ordination.species_scores(spark, one, choices=[1], scaling=3, labels={SPECIES[0]: "A"}).collect()
        for n, x in enumerate(alone):
            got = cols[half, x["species"]]
            assert got["RDA1"] == pytest.approx(x["RDA1"], abs=1e-7) and got["label"] == x["label"] and got["rank"] == n + 1


def test_rows_outside_a_group_fit_have_no_score(spark, frame):
    constraint, condition = Design([factor("trt")], levels=LV), Design([factor("site")], levels=LV)
    tagged = frame.withColumn("all", F.lit("all"))
    fits = ordination.redundancy_by(tagged, "all", SPECIES, constraint, condition)
    odd = tagged.limit(1).withColumn("site", F.lit(None).cast("string")).unionByName(
        tagged.limit(1).withColumn("all", F.lit("unknown"))).unionByName(tagged.limit(1).withColumn("site", F.lit("unlisted")))
    scored = ordination.row_scores_by(odd, fits, "all", SPECIES, constraint=constraint, condition=condition).collect()
    assert [r["RDA1"] for r in scored] == [None] * 3
    assert ordination.redundancy_by(tagged.where("false"), "all", SPECIES, constraint, condition).count() == 0


def test_wide_cross_products(spark, frame):
    narrow = moment_rows(frame, ["site"], {s: s for s in SPECIES})
    arrays = frame.select("site", F.array(F.lit(1.0), *SPECIES).alias("v"))
    wide = {r["site"]: r["upper"] for r in gram_of_arrays(arrays, ["site"], 5).collect()}
    for r in narrow.collect():
        assert wide[r["site"]] == pytest.approx(r["upper"])


def test_vector_and_factor_fit(spark, rows, frame):
    fit = ordination.principal_components(frame, SPECIES)
    scored = ordination.row_scores(frame, fit)
    pts = {r["key"]: (r["PC1"], r["PC2"]) for r in scored.collect()}
    x = np.array([pts[k] for k in range(rows["n"])])
    w = rows["wn"] - rows["wn"].mean()
    fitted = hat(x - x.mean(0)) @ w
    row = permute.fit_vectors(scored, ["PC1", "PC2"], ["wn"], key="key", n_perm=29).first()
    assert row["r2"] == pytest.approx(np.sum(fitted ** 2) / np.sum(w ** 2), rel=1e-7)
    assert row["PC1"] ** 2 + row["PC2"] ** 2 == pytest.approx(1.0)
    fac = permute.fit_factor(scored, ["PC1", "PC2"], "trt", LV["trt"], key="key", n_perm=29).first()
    within = sum(((x[rows["trt"] == t] - x[rows["trt"] == t].mean(0)) ** 2).sum() for t in LV["trt"])
    assert fac["r2"] == pytest.approx(1 - within / ((x - x.mean(0)) ** 2).sum(), rel=1e-7)


def test_principal_coordinates(spark, rows, frame):
    euclid, values = distance.principal_coordinates(frame, "key", SPECIES, frame, "key", "euclidean", k=2)
    pca = ordination.principal_components(frame, SPECIES)
    assert values[:3] == pytest.approx(pca.eigenvalues[:3] * (rows["n"] - 1), rel=1e-8)
    got = {r["key"]: r["Axis1"] for r in euclid.collect()}
    want = (rows["y"] - rows["y"].mean(0)) @ pca.vectors[:, 0]
    sign = np.sign(got[0] * want[0])
    assert [got[k] for k in range(rows["n"])] == pytest.approx(list(sign * want), abs=1e-8)
    # Bray-Curtis against the dense double-centred matrix.
    y = rows["y"]
    d = np.abs(y[:, None] - y[None]).sum(2) / (y[:, None] + y[None]).sum(2)
    j = np.eye(len(y)) - 1 / len(y)
    lam, vec = np.linalg.eigh(-0.5 * j @ d ** 2 @ j)
    points, _ = distance.principal_coordinates(frame, "key", SPECIES, frame, "key", "bray", k=2)
    got = {r["key"]: r["Axis1"] for r in points.collect()}
    assert np.abs([got[k] for k in range(len(y))]) == pytest.approx(np.abs(vec[:, -1] * np.sqrt(lam[-1])), abs=1e-8)


def test_stress_is_zero_for_a_rising_relation(spark):
    df = spark.createDataFrame([(i / 50, (i / 50) ** 2) for i in range(1, 50)], "d double, o double")
    assert distance.stress(df, "d", "o").first()["stress"] == pytest.approx(0.0, abs=1e-7)
    worse = spark.createDataFrame([(0.1, 3.0), (0.2, 1.0), (0.3, 2.0)], "d double, o double")
    got = distance.stress(worse, "d", "o").first()
    assert got["stress"] == pytest.approx(np.sqrt((1 + 1 + 0) / 14)) and got["n_pairs"] == 3


# Published example: 13 vaccine trials (Colditz et al. 1994); columns tpos, tneg, cpos, cneg.
TRIALS = [(4, 119, 11, 128), (6, 300, 29, 274), (3, 228, 11, 209), (62, 13536, 248, 12619), (33, 5036, 47, 5761),
          (180, 1361, 372, 1079), (8, 2537, 10, 619), (505, 87886, 499, 87892), (29, 7470, 45, 7232),
          (17, 1699, 65, 1600), (186, 50448, 141, 27197), (5, 2493, 3, 2338), (27, 16886, 29, 17825)]


def test_random_effects_published_values(spark):
    data = []
    for i, (a, b, c, d) in enumerate(TRIALS):
        data.append((i, float(np.log(a / (a + b)) - np.log(c / (c + d))), 1 / a - 1 / (a + b) + 1 / c - 1 / (c + d)))
    df = spark.createDataFrame(data, "site int, yi double, vi double")
    fits = mixed.fit(df, [mixed.intercept_and()], random="row")
    coef = meta.coefficients(fits).first()
    assert coef["estimate"] == pytest.approx(-0.7145, abs=1e-4)
    assert coef["se"] == pytest.approx(0.1798, abs=1e-4)
    perf = meta.model_performance(fits, df).first()
    assert perf["tau2"] == pytest.approx(0.3132, abs=1e-4)
    assert perf["i2"] == pytest.approx(0.9222, abs=1e-4) and perf["h2"] == pytest.approx(12.86, abs=1e-2)
    assert perf["qe"] == pytest.approx(152.2330, abs=1e-3)
    info = meta.information(fits).first()
    assert info["loglik"] == pytest.approx(-12.2024, abs=1e-3)
    # One row per site: a site intercept is the same model.
    site = mixed.fit(df, [mixed.intercept_and()], random="group")
    assert site.first()["sigma2"] == pytest.approx(perf["tau2"], rel=1e-6)


def dense_loglik(y, x, v, groups, sigma2, tau2, reml=True):
    g = (groups[:, None] == groups[None]).astype(float)
    big = np.diag(v + tau2) + sigma2 * g
    inv = np.linalg.inv(big)
    a = x.T @ inv @ x
    beta = np.linalg.solve(a, x.T @ inv @ y)
    rss = (y - x @ beta) @ inv @ (y - x @ beta)
    n, p = x.shape
    ll = -0.5 * ((n - p if reml else n) * np.log(2 * np.pi) + np.linalg.slogdet(big)[1] + rss)
    if reml:
        ll += 0.5 * np.linalg.slogdet(x.T @ x)[1] - 0.5 * np.linalg.slogdet(a)[1]
    return ll, beta, np.linalg.inv(a)


@pytest.fixture(scope="module")
def effects(spark):
    rng = np.random.default_rng(11)
    k = 40
    groups = rng.integers(0, 9, k)
    x = rng.normal(10, 3, k)
    v = rng.uniform(0.01, 0.1, k)
    y = 0.2 + 0.05 * x + rng.normal(0, 0.4, 9)[groups] + rng.normal(0, 0.25, k) + rng.normal(0, np.sqrt(v))
    df = spark.createDataFrame(
        [(i, f"g{g}", float(a), float(b), float(c), "lo" if a < 10 else "hi")
         for i, (g, a, b, c) in enumerate(zip(groups, x, y, v))],
        "id int, site string, x double, yi double, vi double, band string").cache()
    return df, groups, x, y, v


def test_site_intercept_matches_dense(spark, effects):
    df, groups, x, y, v = effects
    models = [mixed.intercept_and(), mixed.intercept_and("x"), mixed.level_means("band", ["hi", "lo"])]
    fits = {r["model"]: r for r in mixed.fit(df, models).collect()}
    designs = {"1": np.ones((len(y), 1)), "1+x": np.column_stack([np.ones(len(y)), x]),
               "band-1": np.column_stack([x >= 10, x < 10]).astype(float)}
    for name, d in designs.items():
        r = fits[name]
        ll, beta, cov = dense_loglik(y, d, v, groups, r["sigma2"], 0.0)
        assert r["loglik"] == pytest.approx(ll, abs=1e-9)
        assert r["beta"] == pytest.approx(list(beta), rel=1e-8, abs=1e-10)
        assert r["vcov"] == pytest.approx(list(cov.ravel()), rel=1e-7, abs=1e-12)
        for step in (0.99, 1.01):
            assert dense_loglik(y, d, v, groups, r["sigma2"] * step, 0.0)[0] <= ll + 1e-12
        for step in (0.9999, 1.0001):
            assert dense_loglik(y, d, v, groups, r["sigma2"] * step, 0.0)[0] <= ll + 1e-9


def test_nested_components_match_dense(spark, effects):
    df, groups, x, y, v = effects
    r = mixed.fit(df, [mixed.intercept_and("x", x2="x * x")], random="group/row").first()
    d = np.column_stack([np.ones(len(y)), x, x * x])
    ll = dense_loglik(y, d, v, groups, r["sigma2"], r["tau2"])[0]
    assert r["loglik"] == pytest.approx(ll, abs=1e-7)
    best = max(dense_loglik(y, d, v, groups, s, t)[0]
               for s in np.linspace(0, 0.5, 51) for t in np.linspace(0, 0.3, 61))
    assert ll >= best - 1e-9
    for fs in (0.98, 1.0, 1.02):
        for ft in (0.98, 1.0, 1.02):
            if (fs, ft) != (1.0, 1.0):
                assert dense_loglik(y, d, v, groups, r["sigma2"] * fs, r["tau2"] * ft)[0] < ll
    assert 0 < r["tau2"] and 0 < r["sigma2"]


def test_zero_variance_boundary(spark):
    df = spark.createDataFrame([(f"g{i % 3}", 1.0 + 1e-3 * i, 1.0) for i in range(9)], "site string, yi double, vi double")
    assert mixed.fit(df, [mixed.intercept_and()]).first()["sigma2"] == 0.0
    single = spark.createDataFrame([("g", 1.0, 0.1), ("g", 2.0, 0.1)], "site string, yi double, vi double")
    assert mixed.fit(single, [mixed.intercept_and()]).first()["n_groups"] == 1


def test_single_effect_gets_no_extra_variance(spark):
    df = spark.createDataFrame([("a", "s", 1.0, 0.2), ("b", "s", 1.0, 0.2), ("b", "t", 2.0, 0.2)],
                               "o string, site string, yi double, vi double")
    for random in ("row", "group", "group/row"):
        got = {r["model"]: r for r in mixed.fit(df, [mixed.intercept_and()], outcome="o", random=random).collect()}
        assert got["a|1"]["sigma2"] == got["a|1"]["tau2"] == 0.0 and got["a|1"]["beta"] == pytest.approx([1.0])
        assert got["b|1"]["beta"][0] == pytest.approx(1.5)


def test_model_without_enough_rows_has_no_estimate(spark):
    df = spark.createDataFrame([("s", 1.0, 0.2, 3.0, 6.0), ("t", 2.0, 0.3, 4.0, 8.0), ("t", 1.5, 0.3, 5.0, 10.0),
                                ("u", 1.2, 0.2, 6.0, 12.0), ("u", 1.8, 0.3, 7.0, 14.0), ("s", 1.6, 0.2, 8.0, 16.0)],
                               "site string, yi double, vi double, x double, twice double")
    models = [mixed.intercept_and(), mixed.intercept_and("x", where="x < 4", name="few"), mixed.intercept_and("x", "twice")]
    fits = mixed.fit(df, models)
    got = {r["model"]: r for r in fits.collect()}
    assert got["few"]["loglik"] is None and got["1+x+twice"]["beta"] == [None] * 3
    assert got["1"]["loglik"] is not None
    ranks = {r["model"]: (r["rank"], r["aicc"]) for r in meta.compare(fits).collect()}
    assert ranks["1"][0] == 1 and ranks["1"][1] is not None and ranks["few"] == (2, None)


def test_criterion_is_missing_where_undefined(spark):
    df = spark.createDataFrame([("s", 1.0, 0.2), ("t", 2.0, 0.3), ("t", 1.5, 0.3)], "site string, yi double, vi double")
    assert meta.information(mixed.fit(df, [mixed.intercept_and()])).first()["aicc"] is None


def test_boolean_and_unlisted_factor_levels(spark):
    rng = np.random.default_rng(8)
    data = [(bool(i % 2), ["a", "b", "c"][i % 3], float(2 * (i % 2) + rng.normal()), 1e7 if i % 2 else 0.5) for i in range(90)]
    df = spark.createDataFrame(data, "flag boolean, g string, y double, d double")
    from profilar.operators.moments import collect_moments
    y = np.array([r[2] for r in data])
    odd = np.array([r[0] for r in data])
    for name, levels in (("flag", [False, True]), ("d", [0.5, 1e7])):
        m = collect_moments(df, Design([factor(name)], levels={name: levels}), ["y"])
        cols = Design([factor(name)], levels={name: levels}).columns()
        assert m.cross(cols, cols)[1, 1] == 45
        assert m.cross(cols[1:], [c for c in cols[:1]])[0, 0] == 45 and m.n == 90
        assert m.cross(cols, cols).tolist() == [[90, 45], [45, 45]] and (y[odd].mean() > y[~odd].mean())
    m = collect_moments(df, Design([factor("g")], levels={"g": ["a", "b"]}), ["y"])
    assert m.n == 60  # rows of level c are not part of the model


def test_weights_and_heterogeneity_of_two_models(spark, effects):
    df, groups, x, y, v = effects
    df = df.withColumn("z", F.when(F.col("id") % 4 != 0, F.col("x")))
    models = [mixed.intercept_and(name="one"), mixed.intercept_and("z", name="two")]
    fits = mixed.fit(df, models)
    ids = np.arange(len(y))
    got = {(r["model"], r["id"]): r["weight"] for r in meta.row_weights(df, fits, key="id", models=models).collect()}
    typical = meta.typical_variance(df, models)
    for r in fits.collect():
        use = ids if r["model"] == "one" else ids[ids % 4 != 0]
        g = (groups[use][:, None] == groups[use][None]).astype(float)
        w = np.diag(np.linalg.inv(np.diag(v[use]) + r["sigma2"] * g))
        assert [got[r["model"], i] for i in use] == pytest.approx(list(100 * w / w.sum()), rel=1e-8)
        design = np.column_stack([np.ones(len(use)), x[use]])[:, :1 if r["model"] == "one" else 2]
        a = np.diag(1 / v[use])
        p = a - a @ design @ np.linalg.inv(design.T @ a @ design) @ design.T @ a
        assert typical[r["model"]] == pytest.approx((len(use) - design.shape[1]) / np.trace(p))
    assert len(got) == len(ids) + (ids % 4 != 0).sum()


def test_missing_stratum_is_permuted(spark, frame):
    from profilar.operators.ordered import sequence_in_group

    some = frame.withColumn("site", F.when(F.col("site") != "s1", F.col("site")))
    base = some.select(F.col("key").alias("__key"), "site", F.col("a").alias("y0"), F.lit(1.0).alias("x0"))
    base = sequence_in_group(base, ["site"], ["__key"], out="__place")
    got = permute.permuted_moments(base, ["site"], [], 1, 1, 1, 3, 1).collect()
    total = frame.agg(F.sum("a")).first()[0]
    assert len(got) == 3 and all(r["cross"][0] == pytest.approx(total) for r in got)


def test_weights_prediction_and_comparison(spark, effects):
    df, groups, x, y, v = effects
    fits = mixed.fit(df, [mixed.intercept_and("x")])
    r = fits.first()
    g = (groups[:, None] == groups[None]).astype(float)
    w = np.diag(np.linalg.inv(np.diag(v) + r["sigma2"] * g))
    got = {q["id"]: q["weight"] for q in meta.row_weights(df, fits, key="id").collect()}
    assert [got[i] for i in range(len(y))] == pytest.approx(list(100 * w / w.sum()), rel=1e-8)
    grid = spark.createDataFrame([("1+x", 4.0)], "model string, x double")
    p = meta.predict(fits, grid, {"intrcpt": "1D", "x": "x"}).first()
    _, beta, cov = dense_loglik(y, np.column_stack([np.ones(len(y)), x]), v, groups, r["sigma2"], 0.0)
    z = np.array([1.0, 4.0])
    assert p["pred"] == pytest.approx(z @ beta) and p["se"] == pytest.approx(np.sqrt(z @ cov @ z))
    info = meta.compare(fits).first()
    n, k = len(y) - 2, 3
    assert info["aicc"] == pytest.approx(-2 * r["loglik"] + 2 * k * n / (n - k - 1))


def test_regression_tables(spark, rows, frame):
    design = Design(crossed(num("cn"), factor("trt")) + [squared("wn"), logged("wn")], levels=LV)
    fit = regress.ols(frame, "resp", design)
    t = dummies(rows["trt"], LV["trt"])
    cn, wn, y = rows["cn"], rows["wn"], rows["resp"]
    x = np.column_stack([np.ones(len(y)), cn - 2000, t, t * (cn - 2000)[:, None], wn ** 2, np.log(wn)])
    rss = np.sum((y - hat(x) @ y) ** 2)
    assert fit.rss == pytest.approx(rss, rel=1e-7)
    coef = {r["term"]: r for r in regress.coefficient_table(spark, fit).collect()}
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    assert coef["wn^2"]["estimate"] == pytest.approx(beta[6], rel=1e-5)
    assert coef["cn:trt[t1]"]["estimate"] == pytest.approx(beta[4], rel=1e-5)
    out = {r["key"]: r["resid"] for r in regress.residuals(frame, fit).collect()}
    assert [out[k] for k in range(len(y))] == pytest.approx(list(y - hat(x) @ y), abs=1e-6)
    seq = regress.sequential_table(spark, fit).collect()
    assert sum(r["sum_sq"] for r in seq) == pytest.approx(np.sum((y - y.mean()) ** 2), rel=1e-8)
    two = {r["term"]: r for r in regress.type_two_table(spark, fit).collect()}
    no_trt = np.column_stack([np.ones(len(y)), cn - 2000, wn ** 2, np.log(wn)])
    with_trt = np.column_stack([no_trt, t])
    gap = np.sum((y - hat(no_trt) @ y) ** 2) - np.sum((y - hat(with_trt) @ y) ** 2)
    assert two["trt"]["sum_sq"] == pytest.approx(gap, rel=1e-6) and two["trt"]["df"] == 2
    curve = regress.partial_effect(frame, fit, "cn", by="trt", points=5)
    assert curve.count() == 15
    no_intercept = regress.ols(frame, "resp", Design([num("wn")], intercept=False))
    assert regress.raw_coefficients(no_intercept)[0][0] == pytest.approx(wn @ y / (wn @ wn), rel=1e-9)


def test_mixed_regression_matches_dense(spark, rows, frame):
    r = regress.random_intercept(frame, [mixed.intercept_and("wn")], response="resp", group="site").first()
    y = rows["resp"]
    x = np.column_stack([np.ones(len(y)), rows["wn"]])
    codes = np.unique(rows["site"], return_inverse=True)[1]

    def criterion(se2, s2):
        g = (codes[:, None] == codes[None]).astype(float)
        big = se2 * np.eye(len(y)) + s2 * g
        inv = np.linalg.inv(big)
        a = x.T @ inv @ x
        b = np.linalg.solve(a, x.T @ inv @ y)
        e = y - x @ b
        return -0.5 * ((len(y) - 2) * np.log(2 * np.pi) + np.linalg.slogdet(big)[1] + np.linalg.slogdet(a)[1] + e @ inv @ e), b

    top, b = criterion(r["error_variance"], r["sigma2"])
    assert r["loglik"] == pytest.approx(top, abs=1e-8) and r["beta"] == pytest.approx(list(b), rel=1e-8)
    for f in (0.98, 1.02):
        assert criterion(r["error_variance"] * f, r["sigma2"])[0] < top
        assert criterion(r["error_variance"], r["sigma2"] * f)[0] < top


def test_additive_reproduces_a_line_and_a_curve(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 10, 400)
    df = spark.createDataFrame([(float(a), float(2 * a + 1), float(np.sin(a / 2) + rng.normal(0, 0.05))) for a in x],
                               "x double, line double, curve double")
    line = regress.additive(df, "line", ["x"])
    assert line.r2 == pytest.approx(1.0, abs=1e-9)
    pts = regress.smooth_curve(spark, line, "x", 3).orderBy("x").collect()
    assert pts[2]["smooth"] - pts[0]["smooth"] == pytest.approx(2 * (pts[2]["x"] - pts[0]["x"]), rel=1e-6)
    curve = regress.additive(df, "curve", ["x"], basis=8)
    assert curve.r2 > 0.98 and 3 < curve.edf < 9


def test_smooths_of_unequal_roughness_against_dense_restricted_likelihood(spark):
    rng = np.random.default_rng(4)
    n, basis = 300, 8
    x, z = rng.uniform(0, 10, n), rng.uniform(100, 104, n)
    y = np.sin(1.5 * x) + 0.2 * (z - 102) + rng.normal(0, 0.3, n)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, z, y)], "x double, z double, y double")
    fit = regress.additive(df, "y", ["x", "z"], basis=basis)

    def columns(v, knots, at):
        u, k = (at - knots[0]) / (knots[-1] - knots[0]), (knots - knots[0]) / (knots[-1] - knots[0])
        cube = lambda t: np.maximum(u - t, 0) ** 3
        ramp = [(cube(k[i]) - cube(k[-1])) / (k[-1] - k[i]) for i in range(basis - 1)]
        return np.stack([u, *[r - ramp[-1] for r in ramp[:-1]]], axis=1)

    def penalty(knots):  # the integral of squared second derivatives on a fine grid
        at = np.linspace(knots[0], knots[-1], 200_001)
        h = (at[1] - at[0]) / (knots[-1] - knots[0])
        second = np.gradient(np.gradient(columns(at, knots, at), h, axis=0), h, axis=0)[2:-2]
        return second.T @ second * h

    knots = [np.quantile(v, np.linspace(0, 1, basis)) for v in (x, z)]
    parts = [columns(v, k, v) for v, k in zip((x, z), knots)]
    full = np.hstack([np.ones((n, 1)), *parts])
    slots = [slice(1, basis), slice(basis, 2 * basis - 1)]
    own = []
    for slot, k in zip(slots, knots):
        s = np.zeros((full.shape[1],) * 2)
        s[slot, slot] = penalty(k)
        own.append(s)

    def criterion(logs):  # profiled restricted likelihood, written with a density of the rows
        s = sum(np.exp(v) * p for v, p in zip(logs, own))
        free = [0, 1, basis]
        bent = [i for i in range(full.shape[1]) if i not in free]
        cover = np.eye(n) + full[:, bent] @ np.linalg.solve(s[np.ix_(bent, bent)], full[:, bent].T)
        inverse, f = np.linalg.inv(cover), full[:, free]
        inner = f.T @ inverse @ f
        r = y - f @ np.linalg.solve(inner, f.T @ inverse @ y)
        return (n - 3) * np.log(r @ inverse @ r) + np.linalg.slogdet(cover)[1] + np.linalg.slogdet(inner)[1]

    found = np.log([fit.penalty["x"], fit.penalty["z"]])
    best = criterion(found)
    for step in ([0.3, 0], [-0.3, 0], [0, -0.7], [0, -2.0]):
        assert criterion(found + np.array(step)) > best - 1e-4
    assert fit.edf_of["x"] > 5 and fit.edf_of["z"] < 2.5 and fit.penalty["x"] < fit.penalty["z"]
    s = fit.penalty["x"] * own[0] + fit.penalty["z"] * own[1]
    beta = np.linalg.solve(full.T @ full + s, full.T @ y)
    edf = np.trace(np.linalg.solve(full.T @ full + s, full.T @ full))
    assert fit.edf == pytest.approx(edf, rel=1e-4)
    curve = regress.smooth_curve(spark, fit, "x", 21).orderBy("x").collect()
    at = np.array([r["x"] for r in curve])
    shape = columns(x, knots[0], at) - parts[0].mean(axis=0)
    assert [r["smooth"] for r in curve] == pytest.approx(list(shape @ beta[slots[0]]), abs=1e-4)
    cov = np.linalg.inv(full.T @ full + s)[slots[0], slots[0]] * np.sum((y - full @ beta) ** 2) / (n - edf)
    assert [r["se"] for r in curve] == pytest.approx(list(np.sqrt(np.einsum("ij,jk,ik->i", shape, cov, shape))), rel=1e-3)
    assert all(r["lower"] < r["smooth"] < r["upper"] for r in curve)


def test_tree_and_quantile_pairs(spark, rows, frame):
    step = frame.withColumn("s", F.when(F.col("wn") > 5, 10.0).otherwise(0.0))
    tree = regress.regression_tree(step, "s", ["wn", "cn"], max_depth=2, min_rows=2)
    root = tree.where("node = 0").first()
    assert root["split"] == "wn" and 4.5 < root["cut"] < 5.5
    assert tree.where("leaf").agg(F.sum("n")).first()[0] == rows["n"]
    qq = regress.quantile_pairs(frame, "resp", "key").orderBy("rank").collect()
    assert [r["value"] for r in qq] == sorted(rows["resp"].tolist())
    assert qq[0]["normal"] == pytest.approx(float(dist.normal_quantile(0.5 / 90)), abs=1e-6)


def test_tail_probabilities():
    assert dist.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert float(dist.t_two_sided(2.2281388519649385, 10)) == pytest.approx(0.05, abs=1e-10)
    assert float(dist.f_upper(4.964602743730711, 1, 10)) == pytest.approx(0.05, abs=1e-10)
    assert float(dist.chi2_upper(3.841458820694124, 1)) == pytest.approx(0.05, abs=1e-10)
    assert float(dist.chi2_upper(18.307038053275146, 10)) == pytest.approx(0.05, abs=1e-10)
    assert float(dist.t_quantile(0.975, 10)) == pytest.approx(2.2281388519649385, abs=1e-9)


def test_correlation(spark, rows, frame):
    r = regress.correlation_test(frame, "wn", "resp").first()
    assert r["r"] == pytest.approx(np.corrcoef(rows["wn"], rows["resp"])[0, 1])
    assert r["ci_lb"] < r["r"] < r["ci_ub"] and 0 <= r["p"] <= 1


def test_permutation_p_by_brute_force(spark, rows, frame):
    """Replay the permutations outside the engine and refit every permuted table densely."""
    n_perm, seed = 39, 9
    design = Design([factor("trt"), num("wn")], levels=LV)
    fit = ordination.redundancy(frame, SPECIES, design, Design([num("cn")]))
    got = permute.permutation_test(frame, fit, key="key", strata=["site"], n_perm=n_perm, seed=seed).first()
    keys = permute.round_keys(seed, np.arange(n_perm + 1))
    z = (rows["cn"] - 2000)[:, None]
    x = np.hstack([dummies(rows["trt"], LV["trt"]), rows["wn"][:, None]])
    fit_y, resid, inner, rank = dense_rda(rows["y"], x, z)

    def f_of(y):
        a, r, _, k = dense_rda(y, x, z)
        return (np.sum(a ** 2) / k) / (np.sum(r ** 2) / (rows["n"] - 1 - 1 - k))

    observed = f_of(rows["y"])
    assert got["f"] == pytest.approx(observed, rel=1e-7)
    hits = 0
    for b in range(1, n_perm + 1):
        permuted = np.empty_like(inner)
        for s in LV["site"]:
            place = np.flatnonzero(rows["site"] == s)  # in the order of keys
            onto = permute.partner_places(np.arange(len(place)), np.full(len(place), len(place)), keys[b:b + 1])[:, 0]
            permuted[place[onto]] = inner[place]
        hits += f_of(permuted) >= observed - 1e-8
    assert got["p"] == pytest.approx((1 + hits) / (n_perm + 1))


def test_influence_against_the_hat_matrix(spark):
    rng = np.random.default_rng(12)
    g, x = rng.integers(0, 3, 60), rng.normal(100, 1, 60)
    y = 2 * x + g + rng.normal(size=60)
    df = spark.createDataFrame([(i, "abc"[a], float(b), float(c)) for i, (a, b, c) in enumerate(zip(g, x, y))],
                               "id int, g string, x double, y double")
    fit = regress.ols(df, "y", Design([num("x"), factor("g")], levels={"g": ["a", "b", "c"]}))
    d = np.column_stack([np.ones(60), x - 100, g == 1, g == 2]).astype(float)
    hat = d @ np.linalg.inv(d.T @ d) @ d.T
    h, e = np.diag(hat), y - hat @ y
    s2 = e @ e / 56
    rows = regress.influence(df, fit).orderBy("id").collect()
    assert [r["leverage"] for r in rows] == pytest.approx(list(h), rel=1e-7)
    assert [r["standardised"] for r in rows] == pytest.approx(list(e / np.sqrt(s2 * (1 - h))), rel=1e-6)
    assert [r["cook"] for r in rows] == pytest.approx(list(e ** 2 / s2 * h / (1 - h) ** 2 / 4), rel=1e-5)


def test_mixed_residuals_against_dense_prediction(spark, effects):
    df, groups, x, y, v = effects
    model = mixed.intercept_and("x")
    for known in (None, "vi"):
        fits = mixed.fit(df, [model], v=known)
        r = fits.first()
        rows = regress.mixed_residuals(df, fits, model, response="yi", group="site", v=known).orderBy("id").collect()
        noise = np.full(len(y), r["error_variance"]) if known is None else v
        g = (groups[:, None] == groups[None]).astype(float)
        fixed = np.column_stack([np.ones(len(y)), x]) @ np.array(r["beta"])
        effect = r["sigma2"] * g @ np.linalg.inv(np.diag(noise) + r["sigma2"] * g) @ (y - fixed)
        assert [q["effect"] for q in rows] == pytest.approx(list(effect), rel=1e-6, abs=1e-9)
        assert [q["resid"] for q in rows] == pytest.approx(list(y - fixed - effect), rel=1e-6, abs=1e-9)


def test_column_scores_and_eigenvalues(spark):
    df = spark.createDataFrame([(1.0, 0.0, 2.0, 4.0), (3.0, 0.0, 6.0, 0.0)], "a double, b double, p double, q double")
    rows = {r["component"]: (r["p"], r["q"]) for r in distance.column_scores(df, ["a", "b"], ["p", "q"]).collect()}
    assert rows == {"a": (5.0, 1.0), "b": (None, None)}
    table = distance.eigenvalue_table(df, np.array([3.0, 1.0, -1.0])).collect()
    assert [(r["axis"], r["share"]) for r in table] == [(1, 0.75), (2, 0.25), (3, -0.25)]


def test_empty_profiles_have_no_distance(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0)], "k int, a double, b double")
    found = {(r["k"], r["anchor"]): r["d"] for r in distance.to_anchors(df, "k", ["a", "b"], df, "k").collect()}
    assert found == {(1, 1): None, (1, 2): 1.0, (2, 1): 1.0, (2, 2): 0.0}


def test_scaling_rows_keep_large_keys(spark):
    """A NULL key in the batch does not round the others, nor other columns that are kept."""
    big = 1 << 60
    rows = [(None, None, 1.0, 2.0), (big + 1, big + 2, 2.0, 1.0), (big + 2, big + 1, 0.5, 4.0), (big + 3, None, 3.0, 3.0)]
    df = spark.createDataFrame(rows, "k long, other long, a double, b double").coalesce(1)
    anchors = df.where("k is not null")
    points, _ = distance.principal_coordinates(df, "k", ["a", "b"], anchors, "k", k=2, keep=["other"])
    assert {(r["k"], r["other"]) for r in points.collect()} == {r[:2] for r in rows}
    found = distance.to_anchors(df, "k", ["a", "b"], anchors, "k").collect()
    assert {(r["k"], r["anchor"]) for r in found} == {(a, b) for a in range(big + 1, big + 4) for b in range(big + 1, big + 4)}


def test_group_permutations_equal_single_ones(spark, frame):
    design = Design([factor("trt")], levels=LV)
    rows = {r["site"]: r for r in permute.permutation_test_by(frame, "site", SPECIES, design, key="key", n_perm=30,
                                                               seed=4, chunk=20).collect()}
    assert set(rows) == set(LV["site"])
    for s, r in rows.items():
        part = frame.where(F.col("site") == s)
        one = permute.permutation_test(part, ordination.redundancy(part, SPECIES, design), key="key", n_perm=30, seed=4).first()
        assert r["f"] == pytest.approx(one["f"]) and r["p"] == pytest.approx(one["p"]) and r["df_model"] == one["df"]


@pytest.mark.parametrize("reml", [True, False])
def test_variance_derivatives_equal_dense_ones(reml):
    """Score, observed and average information from group sums, against finite differences and dense matrices."""
    rng = np.random.default_rng(8)
    n, sizes = 24, [5, 1, 9, 9]
    x = np.column_stack([np.ones(n), rng.normal(size=n), rng.normal(size=n) ** 2 * 10])
    y, v, group = rng.normal(size=n) + x[:, 1], rng.uniform(0.1, 0.5, size=n), np.repeat(np.arange(4), sizes)
    p, z = 3, np.equal.outer(group, np.arange(4)).astype(float)

    def from_sums(tau2, sigma2):
        w, e = 1 / (v + tau2), np.column_stack([np.ones(n), x, y])
        s = [np.array([(e[group == g] * w[group == g, None] ** k).T @ e[group == g] for g in range(4)]) for k in (1, 2, 3)]
        lnv = np.array([np.log(v + tau2)[group == g].sum() for g in range(4)])
        return mixed._Sums(mixed._group_parts(s, lnv, sigma2), p, n, x.T @ x, reml, False)

    at, h = np.array([0.3, 0.2]), 1e-4
    found = from_sums(*at)
    ll = lambda d: from_sums(*(at + d)).loglik
    unit = np.eye(2) * h
    score = [(ll(u) - ll(-u)) / (2 * h) for u in unit]
    assert found.score == pytest.approx(score, rel=1e-5)
    second = [[(ll(a + b) - ll(a - b) - ll(b - a) + ll(-a - b)) / (4 * h * h) for b in unit] for a in unit]
    assert found.observed == pytest.approx(-np.array(second), rel=1e-4)
    cov = np.diag(v + at[0]) + at[1] * z @ z.T
    inv = np.linalg.inv(cov)
    proj = inv - inv @ x @ np.linalg.inv(x.T @ inv @ x) @ x.T @ inv
    parts = [proj @ y, z @ z.T @ proj @ y]
    assert found.average == pytest.approx(0.5 * np.array([[a @ proj @ b for b in parts] for a in parts]), rel=1e-8)
    sign, logdet = np.linalg.slogdet(cov)
    beta = np.linalg.solve(x.T @ inv @ x, x.T @ inv @ y)
    dense = -0.5 * ((n - p * reml) * np.log(2 * np.pi) + logdet + (y - x @ beta) @ inv @ (y - x @ beta))
    if reml:
        dense += 0.5 * (np.linalg.slogdet(x.T @ x)[1] - np.linalg.slogdet(x.T @ inv @ x)[1])
    assert found.loglik == pytest.approx(dense)


def test_profiled_variance_derivatives():
    """With the error variance profiled out, the score and information are those of the profile likelihood."""
    rng = np.random.default_rng(9)
    n, group = 20, np.repeat(np.arange(5), 4)
    x, y = np.column_stack([np.ones(n), rng.normal(size=n)]), rng.normal(size=n) + np.repeat(rng.normal(size=5), 4)
    e = np.column_stack([np.ones(n), x, y])
    s = [np.array([e[group == g].T @ e[group == g] for g in range(5)])]

    def at(ratio):
        return mixed._Sums(mixed._group_parts(s, np.zeros(5), ratio), 2, n, x.T @ x, True, True)

    h, found = 1e-4, at(0.7)
    assert found.score[0] == pytest.approx((at(0.7 + h).loglik - at(0.7 - h).loglik) / (2 * h), rel=1e-5)
    assert found.observed[0, 0] == pytest.approx(-(at(0.7 + h).loglik - 2 * found.loglik + at(0.7 - h).loglik) / h ** 2, rel=1e-4)


def test_searches_settle_in_few_passes(spark, monkeypatch):
    rng = np.random.default_rng(10)
    rows = [(f"g{k % 12}", float(rng.normal(size=1)[0] + k % 12 / 6), 0.05 + 0.1 * rng.random(), float(k % 7)) for k in range(240)]
    df = spark.createDataFrame(rows, "site string, yi double, vi double, x double")
    passes, plain = [], mixed._evaluated
    monkeypatch.setattr(mixed, "_evaluated", lambda *a: passes.append(1) or plain(*a))
    for random in ("row", "group", "group/row"):
        passes.clear()
        fits = mixed.fit(df, [mixed.intercept_and(), mixed.intercept_and("x")], random=random)
        assert fits.count() == 2 and len(passes) <= 9, random  # the last one is that at zero variance


@pytest.mark.parametrize("seed", [47, 205])
def test_row_and_group_variance_settle_at_the_limit(spark, seed):
    """The first Newton step leads below zero for the row variance; cut off there alone, it pointed downhill."""
    rng = np.random.default_rng(seed)
    v = 0.05 + 0.1 * rng.random(48)
    y = rng.normal(size=48) * np.sqrt(v) + np.repeat(rng.normal(size=12), 4) * 0.3
    df = spark.createDataFrame([(f"g{k // 4}", float(y[k]), float(v[k]), k % 7.0) for k in range(48)], "site string, yi double, vi double, x double")
    model = mixed.intercept_and("x", x2="x * x")
    both, alone = (mixed.fit(df, [model], random=r).first() for r in ("group/row", "group"))
    assert both["tau2"] == 0 and both["sigma2"] == pytest.approx(alone["sigma2"], rel=1e-5)
    assert both["loglik"] == pytest.approx(alone["loglik"], rel=1e-9)


@pytest.mark.parametrize("strata,factors", [(["site"], ["trt", "site"]), ([], ["trt"]), (["site"], [])])
def test_held_and_joined_moments_agree(spark, frame, monkeypatch, strata, factors):
    from profilar.operators.ordered import sequence_in_group

    some = frame.withColumn("site", F.when(F.col("site") != "s1", F.col("site")))
    base = some.select("key", F.col("key").alias("__key"), "site", "trt", F.col("a").alias("y0"), F.col("b").alias("y1"), F.col("wn").alias("x0"))
    base = sequence_in_group(base, strata, ["__key"], out="__place").drop("__key")

    def rows():
        return {tuple(r[c] for c in ("__b", *factors)): r["cross"] for r in
                permute.permuted_moments(base, strata, factors, 1, 2, 3, 9, 4).collect()}

    held = rows()
    monkeypatch.setattr(permute, "HELD_ROWS", 0)
    joined = rows()
    assert held.keys() == joined.keys() and all(held[k] == pytest.approx(joined[k]) for k in held)


@pytest.mark.parametrize("strata,factors", [(["site"], ["trt", "site"]), ([], ["trt"]), ([], []), (["key"], ["trt"])])
def test_permutations_move_no_row_per_permutation(spark, frame, monkeypatch, strata, factors):
    """Blocks of design rows, several permutations to a task, strata that cross chunks; nothing is joined per permutation."""
    from profilar.operators.ordered import sequence_in_group

    some = frame.withColumn("site", F.when(F.col("site") != "s1", F.col("site")))
    base = some.select("key", F.col("key").alias("__key"), "site", "trt", F.col("a").alias("y0"), F.col("b").alias("y1"), F.col("wn").alias("x0"))
    base = sequence_in_group(base, strata, ["__key"], out="__place").drop("__key")

    def table():
        return permute.permuted_moments(base, strata, factors, 1, 2, 3, 60, 4)

    def rows():
        return {tuple(r[c] for c in ("__b", *factors)): r["cross"] for r in table().collect()}

    held = rows()
    monkeypatch.setattr(permute, "HELD_ROWS", 0)
    for pack, block, numbers in ((7, 12 * 28, 1 << 23), (1000, 1 << 20, 200)):
        monkeypatch.setattr(permute, "PACK_ROWS", pack, raising=False)
        monkeypatch.setattr(permute, "HELD_BYTES", block, raising=False)
        monkeypatch.setattr(permute, "SUMMED_NUMBERS", numbers, raising=False)
        streamed = rows()
        assert held.keys() == streamed.keys() and all(held[k] == pytest.approx(streamed[k]) for k in held)
    if not factors:
        assert "Join" not in table()._jdf.queryExecution().optimizedPlan().toString()


def test_partner_places_are_bijections():
    """Every size and key gives a permutation; over many keys each place goes everywhere about equally often."""
    keys = permute.round_keys(3, np.arange(1, 2001))
    for n in (1, 2, 3, 4, 5, 16, 17, 99):
        onto = permute.partner_places(np.arange(n), np.full(n, n), keys[:200])
        assert (np.sort(onto, axis=0) == np.arange(n)[:, None]).all()
    for n in (2, 3, 5, 12):
        onto = permute.partner_places(np.arange(n), np.full(n, n), keys)
        counts = np.array([np.bincount(row, minlength=n) for row in onto])
        chi2 = ((counts - 2000 / n) ** 2 / (2000 / n)).sum()
        assert chi2 < (n - 1) ** 2 + 5 * np.sqrt(2 * (n - 1) ** 2) + 5, n
    orders = {tuple(c) for c in permute.partner_places(np.arange(4), np.full(4, 4), keys).T}
    assert len(orders) == 24  # all of them
    big = permute.partner_places(np.array([0, 5, (1 << 40) - 1]), np.full(3, 1 << 40), keys[:50])
    assert (big < 1 << 40).all() and len(np.unique(big)) == 150


def plain_rising(x, y, w):
    """Fitted values by the rule max over starts of min over ends of averages, at each different x."""
    levels = sorted(set(x))
    tw = [sum(w[i] for i in range(len(x)) if x[i] == v) for v in levels]
    ty = [sum(w[i] * y[i] for i in range(len(x)) if x[i] == v) for v in levels]
    return {v: max(min(sum(ty[a:e + 1]) / sum(tw[a:e + 1]) for e in range(k, len(levels))) for a in range(k + 1))
            for k, v in enumerate(levels)}


@pytest.mark.parametrize("kind", ["noise", "falling", "rising", "ties", "one"])
def test_rising_fit_in_ranges(spark, kind):
    """Ranges of few blocks, pools over many ranges, ties and weights, against the max-min rule."""
    rng = np.random.default_rng(3)
    n = 1 if kind == "one" else 70
    x = rng.integers(0, 12, size=n).astype(float) if kind == "ties" else rng.permutation(n) / 7.0
    y = {"falling": -x, "rising": x ** 2}.get(kind, np.sqrt(x) + rng.normal(size=n))
    w = rng.integers(1, 4, size=n).astype(float)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), w.tolist())), "x double, y double, w double")
    want = plain_rising(x.tolist(), y.tolist(), w.tolist())
    for size in (4, 9, 1000):
        pools = sorted(monotone.rising_fit(df, "x", "y", "w", range_blocks=size).collect(), key=lambda r: r["low"])
        fitted = [r["fitted"] for r in pools]
        assert fitted == sorted(fitted) and sum(r["w"] for r in pools) == w.sum()
        got = {v: next(r["fitted"] for r in pools if r["low"] <= v <= r["high"]) for v in want}
        assert got == pytest.approx(want)
        assert sum(r["square"] for r in pools) == pytest.approx((w * y * y).sum())


def test_rising_fit_writes_pools_alone(spark, monkeypatch):
    """Rows move once; what is written is pooled. Equal x meet across batches, and one x may own most rows."""
    from profilar.operators import ordered

    rng = np.random.default_rng(3)
    x = np.where(np.arange(6000) % 3 == 0, rng.random(6000), 0.5)
    y = rng.normal(size=6000)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double").repartition(5)
    saved, plain = [], monotone.save_and_reload

    def counted(table, name="step"):
        out = plain(table, name)
        saved.append(out.count())
        return out

    monkeypatch.setattr(monotone, "save_and_reload", counted)
    monkeypatch.setattr(ordered, "save_and_reload", counted)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "64")
    try:
        pools = sorted(monotone.rising_fit(df, "x", "y", range_blocks=300).collect(), key=lambda r: r["low"])
    finally:
        spark.conf.set(batch, before)
    levels, at = np.unique(x, return_inverse=True)
    w, s, square = (np.bincount(at, v).tolist() for v in (np.ones(6000), y, y * y))
    want = monotone.pool_blocks(list(zip(levels.tolist(), levels.tolist(), w, s, square)))
    assert [(p["low"], p["high"], p["w"]) for p in pools] == [b[:3] for b in want]
    assert [p["s"] for p in pools] == pytest.approx([b[3] for b in want]) and [p["square"] for p in pools] == pytest.approx([b[4] for b in want])
    assert max(saved) < len(levels) / 3


def test_rising_fit_of_nothing(spark):
    df = spark.createDataFrame([(None, 1.0), (2.0, None)], "x double, y double")
    assert monotone.rising_fit(df, "x", "y").count() == 0
    assert distance.stress(df, "x", "y").first()["stress"] is None


def test_mixed_f_degrees_of_freedom(spark):
    """Balanced data have exact degrees of freedom; unbalanced ones are compared with dense matrices and numeric slopes."""
    rng = np.random.default_rng(12)
    g = np.repeat(np.arange(12), 6)
    steps = rng.normal(size=6)
    between, within = rng.normal(size=12)[g], np.tile(steps - steps.mean(), 12)  # centred: the intercept is a group effect alone
    y = between + rng.normal(size=12)[g] * 2 + rng.normal(size=72)
    rows = [(f"g{a}", float(b), float(c), float(d)) for a, b, c, d in zip(g, between, within, y)]
    frame = spark.createDataFrame(rows, "site string, b double, w double, y double")
    models = [mixed.intercept_and("b", "w")]
    fits = regress.random_intercept(frame, models, response="y", group="site")
    table = {r["term"]: r for r in regress.f_table(fits).collect()}
    assert [table[t]["df2"] for t in ("intrcpt", "b", "w")] == pytest.approx([10, 10, 59], rel=1e-6)
    wald = {r["term"]: r["chisq"] for r in regress.wald_table(fits).collect()}
    assert all(r["f"] == pytest.approx(wald[t]) and r["p"] == pytest.approx(float(dist.f_upper(r["f"], 1.0, r["df2"])))
               for t, r in table.items())

    keep = [n for n in range(72) if n % 5 and n not in (1, 2, 3)]
    fits = regress.random_intercept(spark.createDataFrame([rows[n] for n in keep], frame.schema), models, response="y", group="site")
    got, one = {r["term"]: r["df2"] for r in regress.f_table(fits).collect()}, fits.first()
    x = np.column_stack([np.ones(len(keep)), between[keep], within[keep]])
    same = np.equal.outer(g[keep], g[keep]).astype(float)

    def variances(theta):
        return np.diag(np.linalg.inv(x.T @ np.linalg.solve(theta[0] * np.eye(len(keep)) + theta[1] * same, x)))

    theta = np.array([one["error_variance"], one["sigma2"]])
    inverse = np.linalg.inv(theta[0] * np.eye(len(keep)) + theta[1] * same)
    p = inverse - inverse @ x @ np.linalg.solve(x.T @ inverse @ x, x.T @ inverse)
    parts = [p, p @ same]
    information = np.array([[np.sum(a * b.T) / 2 for b in parts] for a in parts])
    slopes = np.array([(variances(theta + h) - variances(theta - h)) / 2e-5 for h in 1e-5 * np.eye(2)])
    want = 2 * variances(theta) ** 2 / np.einsum("ik,ij,jk->k", slopes, np.linalg.inv(information), slopes)
    assert [got[t] for t in ("intrcpt", "b", "w")] == pytest.approx(list(want), rel=1e-5)
    known = mixed.fit(frame.withColumn("v", F.lit(1.0)), models, y="y", v="v", group="site")
    assert all(r["df2"] is None and r["f"] is None for r in regress.f_table(known).collect())
