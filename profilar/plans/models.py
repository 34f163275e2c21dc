"""Queries on ordination, meta-analysis and regression."""

from __future__ import annotations

from pyspark.sql import functions as F

from profilar.functions.nulls import tidy
from profilar.operators import (aggregate, distance, effects, joins, landmarks, meta, mixed, ordination, permute, regress, reshape,
                                shares)
from profilar.operators.design import Design, crossed, factor, logged, num, squared
from profilar.operators.mixed import intercept_and, level_means
from profilar.operators.moments import moment_rows
from profilar.plans import bindings as b
from profilar.plans.hash_text import permutations
from profilar.plans.registry import query
from profilar.plans.relations import CELL_COVARIATES, MD, rom_table
from profilar.plans.sql_text import (chi2_tail, coefficient_rows, covariance, cross_products, eigenpairs, f_tail, multi_fit, rising_pools,
                                       nested_search, normal_quantile, orthogonal_steps, restricted_search, stacked_models, sweep,
                                       t_tail, variance_search, z_tail)
from profilar.session import save_and_reload

P = b.sql(b.SQL_PROFILES)
T = b.sql(b.SQL_TABLE)
H = [f"h_{g}" for g in b.GROUPS]
PERMUTATIONS = 999
LEVELS = {"site": b.SITES, "treatment": [b.CONTROL] + [t for t in b.TREATMENTS if t != b.CONTROL]}
TREATMENT = Design([factor("treatment")], levels=LEVELS)
SITE = Design([factor("site")], levels=LEVELS)
CROSSED = Design(crossed(factor("treatment"), factor("site")), levels=LEVELS)

SQL_H = P + """,
h AS (SELECT sample, site, treatment, trt_id, sqrt("ECONOMY") AS a, sqrt("LARGE") AS b,
             sqrt("SMALL_MEDIUM") AS c, sqrt("STANDARD") AS d FROM profiles)"""


RECURSIVE = SQL_H.replace("WITH", "WITH RECURSIVE", 1)
_SUM4 = "var_samp(a) + var_samp(b) + var_samp(c) + var_samp(d)"

# Partial ordination by treatment within site: fitted part = cell mean − site mean.
PARTIAL = RECURSIVE + ", ct AS (SELECT sample, site, treatment, trt_id, " + ", ".join(
    f"{x} - avg({x}) OVER (PARTITION BY site) AS w{x}, "
    f"avg({x}) OVER (PARTITION BY site, treatment) - avg({x}) OVER (PARTITION BY site) AS f{x}" for x in "abcd"
) + " FROM h)," + covariance("cov", "ct", ["fa", "fb", "fc", "fd"]) + "," + eigenpairs("rda", "cov", 4, 2) + f""",
sz AS (SELECT count(*) AS n, {_SUM4} AS tot FROM h),
sc AS (SELECT ct.*, (wa * x.v1 + wb * x.v2 + wc * x.v3 + wd * x.v4) / sqrt(x.value * (n - 1)) *
         power(x.value / tot, 0.25) * power((n - 1) * tot, 0.25) AS s1,
       (wa * y.v1 + wb * y.v2 + wc * y.v3 + wd * y.v4) / sqrt(y.value * (n - 1)) *
         power(y.value / tot, 0.25) * power((n - 1) * tot, 0.25) AS s2 FROM ct, rda1 x, rda2 y, sz)"""

# Ordination on covariates within site.
CONTINUOUS = RECURSIVE + "," + b.SQL_COVARIATES + """,
hc AS (SELECT h.*, cn, qty, tax FROM h JOIN covariates USING (sample) WHERE cn IS NOT NULL)"""


def _between(keys: str) -> str:
    """Sum of squares between cells, over the four transformed columns."""
    parts = " + ".join(f"n * power({x}m - (SELECT avg({x}) FROM h), 2)" for x in "abcd")
    means = ", ".join(f"avg({x}) AS {x}m" for x in "abcd")
    return f"(SELECT sum({parts}) FROM (SELECT count(*) AS n, {means} FROM h GROUP BY {keys}))"


_TOTAL = "(SELECT (count(*) - 1) * (var_samp(a) + var_samp(b) + var_samp(c) + var_samp(d)) FROM h)"


def profile_rows(spark, folder):
    """Profiles with covariates and transformed columns, stored once for the passes that follow."""
    df, _ = ordination.hellinger_table(b.sample_table(spark, folder), b.GROUPS)
    return save_and_reload(df, "profiles")


def _rounded(df, digits=6, skip=()):
    doubles = [c for c, t in df.dtypes if t == "double" and c not in skip]
    return reshape.map_columns(df, lambda c: tidy(c, digits), columns=doubles)


# Ordination ------------------------------------------------------------------


@query("gram_entries", "M2", SQL_H + """
SELECT count(*)::DOUBLE AS n, round(sum(a), 4) AS s_a, round(sum(a * a), 4) AS s_aa, round(sum(a * b), 4) AS s_ab,
       round(sum(c * d), 4) AS s_cd FROM h""")
def gram_entries(spark, folder):
    df, hs = ordination.hellinger_table(b.profiles(spark, folder), b.GROUPS)
    m = moment_rows(df, [], {h: f"`{h}`" for h in hs})
    u = F.col("upper")  # order: 11 1a 1b 1c 1d aa ab ac ad bb bc bd cc cd dd
    return m.select(u[0].alias("n"), tidy(u[1], 4).alias("s_a"), tidy(u[5], 4).alias("s_aa"),
                    tidy(u[6], 4).alias("s_ab"), tidy(u[13], 4).alias("s_cd"))


@query("component_inertia", "M3 M7", SQL_H + f"SELECT 'total' AS component, round({_TOTAL} / (count(*) - 1), 6) AS inertia FROM h")
def component_inertia(spark, folder):
    fit = ordination.principal_components(profile_rows(spark, folder), H)
    table = spark.createDataFrame([("total", float(fit.eigenvalues.sum()))], "component string, inertia double")
    return _rounded(table)


@query("embedding_inertia", "M2 M3", """
WITH e AS (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
v AS (SELECT i, var_samp(x) AS v FROM e GROUP BY 1)
SELECT CAST(count(*) AS INTEGER) AS columns, round(sum(v), 4) AS inertia FROM v""")
def embedding_inertia(spark, folder):
    """Wide profiles: the per-task matrix path of the cross-product kernel."""
    raw = b.table(spark, folder, "embeddings")
    width = raw.agg(F.max(F.size("embedding"))).first()[0]
    wide = raw.select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(width)])
    fit = ordination.principal_components(wide, [f"e{i}" for i in range(width)])
    out = spark.createDataFrame([(width, float(fit.eigenvalues.sum()))], "columns int, inertia double")
    return _rounded(out, 4)


@query("factor_inertia", "M4 M7 M11", SQL_H + f""",
s AS (SELECT count(*) AS n, count(DISTINCT treatment) AS k, {_TOTAL} AS t, {_between("treatment")} AS m FROM h)
SELECT round(t / (n - 1), 6) AS total, round(m / (n - 1), 6) AS constrained, round((t - m) / (n - 1), 6) AS residual,
       CAST(k - 1 AS INTEGER) AS rank, round((m / (k - 1)) / ((t - m) / (n - k)), 5) AS f FROM s""")
def factor_inertia(spark, folder):
    fit = ordination.redundancy(profile_rows(spark, folder), H, TREATMENT)
    f = fit.constrained / fit.rank_constraint / (fit.residual / fit.residual_df)
    out = spark.createDataFrame(
        [(fit.total, fit.constrained, fit.residual, fit.rank_constraint, float(f))],
        "total double, constrained double, residual double, rank int, f double")
    return _rounded(_rounded(out, 6, ["f"]), 5, ["total", "constrained", "residual"])


@query("partial_inertia", "M5 M7", SQL_H + f""",
s AS (SELECT count(*) AS n, count(DISTINCT trt_id) AS k, count(DISTINCT site) AS j, {_TOTAL} AS t,
             {_between("site")} AS z, {_between("site, treatment")} AS m FROM h)
SELECT component, round(v / (n - 1), 6) AS inertia, round(v / t, 6) AS proportion, CAST(r AS INTEGER) AS rank FROM s,
LATERAL (VALUES ('total', t, NULL), ('conditioned', z, j - 1), ('constrained', m - z, k - j),
                ('residual', t - m, 4)) AS x(component, v, r)""")
def partial_inertia(spark, folder):
    fit = ordination.redundancy(profile_rows(spark, folder), H, CROSSED, SITE)
    return _rounded(ordination.inertia_table(spark, fit))


def _axis_rows() -> str:
    parts = [f"SELECT {i} AS rank, 'RDA{i}' AS axis, value FROM con{i}" for i in (1, 2)]
    parts += [f"SELECT {i + 2}, 'PC{i}', value FROM res{i}" for i in (1, 2, 3, 4)]
    return " UNION ALL ".join(parts)


@query("axis_labels", "M8 M6", CONTINUOUS + "," + multi_fit("hc", "sample", "abcd", ["cn", "qty"], "site") + ","
       + covariance("cf", "mf", [f"f_{x}" for x in "abcd"]) + "," + eigenpairs("con", "cf", 4, 2) + ","
       + covariance("ce", "mf", [f"e_{x}" for x in "abcd"]) + "," + eigenpairs("res", "ce", 4, 4) + f""",
ax AS ({_axis_rows()}),
tt AS (SELECT {_SUM4} AS tot FROM hc)
SELECT CAST(rank AS INTEGER) AS rank, axis, round(value, 6) AS eigenvalue, round(value / tot, 6) AS proportion,
       round(sum(value / tot) OVER (ORDER BY rank), 6) AS running,
       axis || ' (' || regexp_replace(CAST(round_even(100 * value / tot, 1) AS VARCHAR), '\\.0$', '') || '%)' AS label
FROM ax, tt""")
def axis_labels(spark, folder):
    fit = ordination.redundancy(profile_rows(spark, folder), H, Design([num("cn"), num("qty")]), SITE)
    return _rounded(ordination.axis_table(spark, fit))


@query("row_scores", "M9 M5", PARTIAL + """
SELECT sample, site, round(s1, 5) AS "RDA1", round(s2, 5) AS "RDA2" FROM sc""")
def row_scores(spark, folder):
    df = profile_rows(spark, folder)
    fit = ordination.redundancy(df, H, CROSSED, SITE)
    scored = ordination.row_scores(df, fit, choices=[1, 2], scaling=3)
    return _rounded(scored.select("sample", "site", "RDA1", "RDA2"), 5)


@query("component_scores", "M3 M9", RECURSIVE + "," + covariance("cov", "h", "abcd") + "," + eigenpairs("lead", "cov", 4, 1) + f""",
c AS (SELECT power((count(*) - 1) * {_TOTAL} / (count(*) - 1), 0.25) AS k, count(*) AS n, avg(a) AS ma, avg(b) AS mb,
             avg(c) AS mc, avg(d) AS md FROM h)
SELECT sample, round(value, 6) AS eigenvalue,
  round(((a - ma) * v1 + (b - mb) * v2 + (c - mc) * v3 + (d - md) * v4) / sqrt(value * (n - 1)) * k, 5) AS score
FROM h, lead1, c""")
def component_scores(spark, folder):
    df = profile_rows(spark, folder)
    fit = ordination.principal_components(df, H)
    scored = ordination.row_scores(df, fit, axes=["PC1"])
    return scored.select("sample", tidy(F.lit(float(fit.eigenvalues[0]))).alias("eigenvalue"), tidy("PC1", 5).alias("score"))


@query("species_scores", "M10 O3 F5", PARTIAL + """
SELECT species, label, round(p * power(x.value / tot, 0.25) * power((n - 1) * tot, 0.25), 6) AS "RDA1",
       round(q * power(y.value / tot, 0.25) * power((n - 1) * tot, 0.25), 6) AS "RDA2"
FROM rda1 x, rda2 y, sz, LATERAL (VALUES ('h_ECONOMY', 'Economy', x.v1, y.v1), ('h_LARGE', 'Large', x.v2, y.v2),
  ('h_SMALL_MEDIUM', 'Small medium', x.v3, y.v3), ('h_STANDARD', 'Standard', x.v4, y.v4)) AS t(species, label, p, q)""")
def species_scores(spark, folder):
    fit = ordination.redundancy(profile_rows(spark, folder), H, CROSSED, SITE)
    labels = {h: h[2:].replace("_", " ").capitalize() for h in H}
    return _rounded(ordination.species_scores(spark, fit, choices=[1, 2], scaling=3, labels=labels))


def _arrow(x: str, k: int) -> str:
    lin = f"(f_a * con{k}.v1 + f_b * con{k}.v2 + f_c * con{k}.v3 + f_d * con{k}.v4)"
    return (f"SELECT '{x}' AS \"constraint\", 'RDA{k}' AS axis, round(sum(c_{x} * {lin}) / "
            f"sqrt(sum(g_{x} * g_{x}) * sum({lin} * {lin})), 5) AS correlation FROM mf, con{k}")


@query("constraint_arrows", "M6 M7", CONTINUOUS + ","
       + multi_fit("hc", "sample", "abcd", ["cn", "qty", "tax"], "site") + ","
       + covariance("cf", "mf", [f"f_{x}" for x in "abcd"]) + "," + eigenpairs("con", "cf", 4, 3) + " "
       + " UNION ALL ".join(_arrow(x, k) for x in ("cn", "qty", "tax") for k in (1, 2, 3)))
def constraint_arrows(spark, folder):
    fit = ordination.redundancy(profile_rows(spark, folder), H, Design([num("cn"), num("qty"), num("tax")]), SITE)
    return _rounded(ordination.constraint_correlations(spark, fit), 5)


@query("ordination_by_site", "M14 D1 DM9", SQL_H + """,
g AS (SELECT site, avg(a) AS ga, avg(b) AS gb, avg(c) AS gc, avg(d) AS gd, count(*) AS n,
             count(DISTINCT treatment) AS k,
             (count(*) - 1) * (var_samp(a) + var_samp(b) + var_samp(c) + var_samp(d)) AS t FROM h GROUP BY 1),
m AS (SELECT site, treatment, count(*) AS c0, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(d) AS md
      FROM h GROUP BY ALL),
s AS (SELECT site, any_value(n) AS n, any_value(k) AS k, any_value(t) AS t,
             sum(c0 * (power(ma - ga, 2) + power(mb - gb, 2) + power(mc - gc, 2) + power(md - gd, 2))) AS ss
      FROM m JOIN g USING (site) GROUP BY site)
SELECT site, n::DOUBLE AS n, round(t / (n - 1), 6) AS total, round(ss / (n - 1), 6) AS constrained,
       CASE WHEN n > k THEN round((ss / (k - 1)) / ((t - ss) / (n - k)), 4) END AS f FROM s""")
def ordination_by_site(spark, folder):
    df = profile_rows(spark, folder)
    fits = ordination.redundancy_by(df, "site", H, TREATMENT).where("axis = 'RDA1'")
    return fits.select("site", "n", tidy("total").alias("total"), tidy("constrained").alias("constrained"),
                       tidy("f", 4).alias("f"))


@query("row_scores_by_site", "M14 M9", RECURSIVE + ", ct AS (SELECT sample, site, " + ", ".join(
    f"{x} - avg({x}) OVER (PARTITION BY site) AS w{x}, "
    f"avg({x}) OVER (PARTITION BY site, treatment) - avg({x}) OVER (PARTITION BY site) AS f{x}" for x in "abcd")
    + " FROM h)," + covariance("cov", "ct", ["fa", "fb", "fc", "fd"], "site") + "," + eigenpairs("rda", "cov", 4, 1) + f""",
sz AS (SELECT site AS key, count(*) AS n, {_SUM4} AS tot FROM h GROUP BY 1)
SELECT sample, site, round((wa * v1 + wb * v2 + wc * v3 + wd * v4) / sqrt(value * (n - 1)) *
  power(value / tot, 0.25) * power((n - 1) * tot, 0.25), 5) AS "RDA1"
FROM ct JOIN rda1 ON site = rda1.key JOIN sz ON site = sz.key""")
def row_scores_by_site(spark, folder):
    df = profile_rows(spark, folder)
    fits = save_and_reload(ordination.redundancy_by(df, "site", H, TREATMENT), "fits")
    return _rounded(ordination.row_scores_by(df, fits, "site", H).select("sample", "site", "RDA1"), 5)


# One ordination per region: treatment within site, site conditioned out.
REGIONAL = (RECURSIVE + """, hr AS (SELECT h.*, r_name AS region FROM h JOIN nation ON n_name = site JOIN region ON r_regionkey = n_regionkey),
ct AS (SELECT sample, site, region, treatment, """ + ", ".join(
    f"{x} - avg({x}) OVER (PARTITION BY site) AS w{x}, "
    f"avg({x}) OVER (PARTITION BY site, treatment) - avg({x}) OVER (PARTITION BY site) AS f{x}" for x in "abcd")
    + " FROM hr)," + covariance("cov", "ct", ["fa", "fb", "fc", "fd"], "region") + "," + eigenpairs("rda", "cov", 4, 1) + f""",
sz AS (SELECT region AS key, count(*) AS n, count(DISTINCT site) AS j, count(DISTINCT (site, treatment)) AS k, {_SUM4} AS tot
       FROM hr GROUP BY 1),
pt AS (SELECT region AS key, {" + ".join(f"sum(f{x} * f{x})" for x in "abcd")} AS ss_c,
              {" + ".join(f"sum(power(w{x} - f{x}, 2))" for x in "abcd")} AS ss_r FROM ct GROUP BY 1)""")


def regional_fits(spark, folder):
    places = b.table(spark, folder, "nation").join(b.table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    df = save_and_reload(joins.match(profile_rows(spark, folder), places.select(
        F.col("n_name").alias("site"), F.col("r_name").alias("region")), ["site"], "inner"), "regional")
    return df, save_and_reload(ordination.redundancy_by(df, "region", H, CROSSED, SITE), "fits")


@query("ordination_by_region", "M14 M7 M8 D1", REGIONAL + """
SELECT key AS region, n::DOUBLE AS n, round(tot, 6) AS total, round(tot - (ss_c + ss_r) / (n - 1), 6) AS conditioned,
       round(ss_c / (n - 1), 6) AS constrained, round(ss_r / (n - 1), 6) AS residual, CAST(j - 1 AS INTEGER) AS df_condition,
       CAST(k - j AS INTEGER) AS df_model, CAST(n - k AS INTEGER) AS df_residual,
       round((ss_c / (k - j)) / (ss_r / (n - k)), 4) AS f,
       'RDA1 (' || regexp_replace(CAST(round_even(100 * value / tot, 1) AS VARCHAR), '\\.0$', '') || '%)' AS label
FROM sz JOIN pt USING (key) JOIN rda1 USING (key)""")
def ordination_by_region(spark, folder):
    _, fits = regional_fits(spark, folder)
    out = fits.where("axis = 'RDA1'").select("region", "n", "total", "conditioned", "constrained", "residual", "df_condition",
                                             "df_model", "df_residual", "f", "label")
    return _rounded(_rounded(out, 6, ["f"]), 4, ["total", "conditioned", "constrained", "residual"])


@query("row_scores_by_region", "M14 M9", REGIONAL + """
SELECT sample, region, round((wa * v1 + wb * v2 + wc * v3 + wd * v4) / sqrt(value * (n - 1)) *
  power(value / tot, 0.25) * power((n - 1) * tot, 0.25), 5) AS "RDA1"
FROM ct JOIN rda1 ON region = rda1.key JOIN sz ON region = sz.key""")
def row_scores_by_region(spark, folder):
    df, fits = regional_fits(spark, folder)
    scored = ordination.row_scores_by(df, fits, "region", H, constraint=CROSSED, condition=SITE)
    return _rounded(scored.select("sample", "region", "RDA1"), 5)


@query("species_scores_by_region", "M14 M10 O3 F5", REGIONAL + """,
s AS (SELECT key AS region, species, label, p * power(value / tot, 0.25) * power((n - 1) * tot, 0.25) AS score
      FROM rda1 JOIN sz USING (key), LATERAL (VALUES ('h_ECONOMY', 'Economy', v1), ('h_LARGE', 'Large', v2),
        ('h_SMALL_MEDIUM', 'Small medium', v3), ('h_STANDARD', 'Standard', v4)) AS t(species, label, p))
SELECT region, species, label, CAST(row_number() OVER (PARTITION BY region ORDER BY score) AS INTEGER) AS rank,
       round(score, 6) AS "RDA1" FROM s""")
def species_scores_by_region(spark, folder):
    _, fits = regional_fits(spark, folder)
    labels = {h: h[2:].replace("_", " ").capitalize() for h in H}
    return _rounded(ordination.species_scores_by(fits, "region", H, labels=labels))


@query("standardised_scores", "M15 W9 A4 J3", PARTIAL + "," + b.SQL_COVARIATES + """,
ba AS (SELECT site, avg(s1) AS base FROM sc WHERE treatment = 'BUILDING' GROUP BY 1),
st AS (SELECT sc.site, trt_id, s1 - base AS std, cn FROM sc LEFT JOIN ba USING (site) JOIN covariates USING (sample)
       WHERE treatment <> 'BUILDING')
SELECT site, trt_id, round(avg(std), 5) AS "std_M", round(stddev_samp(std) / sqrt(count(std)), 5) AS "std_SE",
       round(avg(cn), 5) AS "cn_M", round(stddev_samp(cn) / sqrt(count(cn)), 5) AS "cn_SE" FROM st GROUP BY ALL""")
def standardised_scores(spark, folder):
    df = profile_rows(spark, folder)
    fit = ordination.redundancy(df, H, CROSSED, SITE)
    scored = ordination.row_scores(df, fit, choices=[1], scaling=3)
    std = shares.difference_from_control(scored, by=["site"], treatment="treatment", control=b.CONTROL,
                                         value="RDA1", out="std")
    return _rounded(aggregate.summarise(std, ["site", "trt_id"], ["std", "cn"], ["M", "SE"], na="skip"), 5)


@query("group_centroids", "M16", SQL_H + """,
c AS (SELECT trt_id, avg(a) AS ca, avg(c) AS cc FROM h GROUP BY 1)
SELECT sample, round(ca, 6) AS ca, round(cc, 6) AS cc,
       round(sqrt(power(a - ca, 2) + power(c - cc, 2)), 6) AS spoke FROM h JOIN c USING (trt_id)""")
def group_centroids(spark, folder):
    df, _ = ordination.hellinger_table(b.profiles(spark, folder), b.GROUPS)
    out = ordination.spokes(df, ["trt_id"], ["h_ECONOMY", "h_SMALL_MEDIUM"])
    return out.select("sample", tidy("c_h_ECONOMY").alias("ca"), tidy("c_h_SMALL_MEDIUM").alias("cc"),
                      tidy("spoke").alias("spoke"))


@query("pseudo_f_overall", "M11 M7", SQL_H + f""",
s AS (SELECT count(*) AS n, count(DISTINCT trt_id) AS k, count(DISTINCT site) AS j, {_TOTAL} AS t,
             {_between("site")} AS z, {_between("site, treatment")} AS m FROM h)
SELECT 'Model' AS term, CAST(k - j AS INTEGER) AS df, round((m - z) / (n - 1), 6) AS variance,
       round((m - z) / (k - j) / ((t - m) / (n - k)), 4) AS f FROM s
UNION ALL SELECT 'Residual', CAST(n - k AS INTEGER), round((t - m) / (n - 1), 6), NULL FROM s""")
def pseudo_f_overall(spark, folder):
    df = profile_rows(spark, folder)
    fit = ordination.redundancy(df, H, CROSSED, SITE)
    return _f_table(permute.permutation_test(df, fit, key="sample", n_perm=0))


def _f_table(table):
    return _rounded(_rounded(table.drop("p"), 6, ["f"]), 4, ["variance"])


def _part(r: int) -> str:
    return " + ".join(f"power(sum(r{r} * w_{x}), 2) / sum(r{r} * r{r})" for x in "abcd")


_MARGIN = (CONTINUOUS + "," + multi_fit("hc", "sample", "abcd", ["qty", "cn"], "site")
           + f", m1 AS (SELECT {_part(2)} AS ss FROM mf), "
           + multi_fit("hc", "sample", "abcd", ["cn", "qty"], "site").replace("mf", "mg")
           + f", m2 AS (SELECT {_part(2)} AS ss FROM mg), "
           + "rs AS (SELECT count(*) AS n, sum(e_a * e_a + e_b * e_b + e_c * e_c + e_d * e_d) AS rss FROM mf), "
           + "js AS (SELECT count(DISTINCT site) AS j FROM hc)")


@query("pseudo_f_margin", "M12 M6", _MARGIN + """
SELECT 'cn' AS term, CAST(1 AS INTEGER) AS df, round(ss / (n - 1), 6) AS variance, round(ss / (rss / (n - j - 2)), 4) AS f
FROM m1, rs, js
UNION ALL SELECT 'qty', 1, round(ss / (n - 1), 6), round(ss / (rss / (n - j - 2)), 4) FROM m2, rs, js
UNION ALL SELECT 'Residual', CAST(n - j - 2 AS INTEGER), round(rss / (n - 1), 6), NULL FROM rs, js""")
def pseudo_f_margin(spark, folder):
    df = profile_rows(spark, folder)
    fit = ordination.redundancy(df, H, Design([num("cn"), num("qty")]), SITE)
    return _f_table(permute.permutation_test(df, fit, key="sample", by="margin", n_perm=0))


@query("pseudo_f_axis", "M13 M6", _MARGIN + "," + covariance("cf", "mf", [f"f_{x}" for x in "abcd"]) + ","
       + eigenpairs("con", "cf", 4, 2) + """
SELECT 'RDA1' AS term, CAST(1 AS INTEGER) AS df, round(value, 6) AS variance,
       round(value * (n - 1) / (rss / (n - j - 2)), 4) AS f FROM con1, rs, js
UNION ALL SELECT 'RDA2', 1, round(value, 6), round(value * (n - 1) / (rss / (n - j - 2)), 4) FROM con2, rs, js
UNION ALL SELECT 'Residual', CAST(n - j - 2 AS INTEGER), round(rss / (n - 1), 6), NULL FROM rs, js""")
def pseudo_f_axis(spark, folder):
    df = profile_rows(spark, folder)
    fit = ordination.redundancy(df, H, Design([num("cn"), num("qty")]), SITE)
    return _f_table(permute.permutation_test(df, fit, key="sample", by="axis", n_perm=0))


_PC = (CONTINUOUS + "," + covariance("cov", "h", "abcd") + "," + eigenpairs("pc", "cov", 4, 2) + """,
mm AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(d) AS md FROM h),
pt AS (SELECT h.*, ((a - ma) * x.v1 + (b - mb) * x.v2 + (c - mc) * x.v3 + (d - md) * x.v4) / sqrt(x.value) AS p1,
              ((a - ma) * y.v1 + (b - mb) * y.v2 + (c - mc) * y.v3 + (d - md) * y.v4) / sqrt(y.value) AS p2
       FROM h, mm, pc1 x, pc2 y)""")


@query("vector_directions", "M17", _PC + """,
vf AS (SELECT p1, p2, cn, qty, tax, avg(p1) OVER () AS m1, avg(p2) OVER () AS m2
       FROM pt JOIN covariates USING (sample) WHERE cn IS NOT NULL),
vk AS (SELECT *, (sum((p1 - m1) * (p2 - m2)) OVER ()) / (sum(power(p1 - m1, 2)) OVER ()) AS k FROM vf),
vq AS (SELECT *, p2 - m2 - k * (p1 - m1) AS r2 FROM vk),
r AS (""" + " UNION ALL ".join(
    f"SELECT '{v}' AS variable, sum((p1 - m1) * {v}) / sum(power(p1 - m1, 2)) AS g, "
    f"sum((r2) * {v}) / sum(r2 * r2) AS s2, k, "
    f"(power(sum((p1 - m1) * {v}), 2) / sum(power(p1 - m1, 2)) + power(sum(r2 * {v}), 2) / sum(r2 * r2)) / "
    f"((count(*) - 1) * var_samp({v})) AS r2 FROM vq GROUP BY k" for v in ("cn", "qty", "tax")) + """)
SELECT variable, round((g - k * s2) / sqrt(power(g - k * s2, 2) + s2 * s2), 5) AS "PC1",
       round(s2 / sqrt(power(g - k * s2, 2) + s2 * s2), 5) AS "PC2", round(r2, 6) AS r2 FROM r""")
def vector_directions(spark, folder):
    df = profile_rows(spark, folder)
    scored = ordination.row_scores(df, ordination.principal_components(df, H))
    out = permute.fit_vectors(scored, ["PC1", "PC2"], ["cn", "qty", "tax"], key="sample", n_perm=0).drop("p")
    return _rounded(_rounded(out, 6, ["PC1", "PC2"]), 5, ["r2"])


@query("factor_share", "M17", _PC + """,
g AS (SELECT treatment, count(*) AS c, avg(p1) AS m1, avg(p2) AS m2 FROM pt GROUP BY 1)
SELECT 'treatment' AS variable, round((SELECT sum(c * (power(m1 - (SELECT avg(p1) FROM pt), 2)
    + power(m2 - (SELECT avg(p2) FROM pt), 2))) FROM g) / ((count(*) - 1) * (var_samp(p1) + var_samp(p2))), 6) AS r2 FROM pt""")
def factor_share(spark, folder):
    df = profile_rows(spark, folder)
    scored = ordination.row_scores(df, ordination.principal_components(df, H))
    out = permute.fit_factor(scored, ["PC1", "PC2"], "treatment", LEVELS["treatment"], key="sample", n_perm=0)
    return _rounded(out.drop("p"))


_CLOSE = 1.4901161193847656e-08  # how near a permuted statistic counts as equal
_WITHIN = RECURSIVE + ", hw AS (SELECT sample, site, treatment, " + ", ".join(
    f"{x} - avg({x}) OVER (PARTITION BY site) AS {x}" for x in "abcd") + " FROM h), " + permutations(
    "h", "sample", "site", PERMUTATIONS) + """,
pv AS (SELECT m.b, d.site, d.treatment, s.a, s.b AS b2, s.c, s.d FROM moved m JOIN hw s ON s.sample = m.key
       JOIN h d ON d.sample = m.onto UNION ALL SELECT 0, site, treatment, a, b, c, d FROM hw),
pc AS (SELECT b, site, treatment, count(*) AS n,
              count(*) * (power(avg(a), 2) + power(avg(b2), 2) + power(avg(c), 2) + power(avg(d), 2)) AS ss FROM pv GROUP BY ALL),
tt AS (SELECT site, count(*) AS n, count(DISTINCT treatment) AS k, sum(a * a + b * b + c * c + d * d) AS t FROM hw GROUP BY 1)"""


@query("permutation_overall", "M11", _WITHIN + """,
w AS (SELECT sum(n) AS n, sum(k) AS k, count(*) AS j, sum(t) AS t FROM tt),
f AS (SELECT b, sum(ss) AS m, (sum(ss) / any_value(k - j)) / ((any_value(t) - sum(ss)) / any_value(w.n - k)) AS f FROM pc, w GROUP BY b),
o AS (SELECT * FROM f WHERE b = 0)
SELECT 'Model' AS term, CAST(k - j AS INTEGER) AS df, round(o.m / (n - 1), 6) AS variance, round(o.f, 4) AS f,
       (1 + (SELECT count(*) FROM f WHERE b > 0 AND f.f >= o.f - """ + str(_CLOSE) + f""")) / {PERMUTATIONS + 1.0} AS p FROM o, w
UNION ALL SELECT 'Residual', CAST(n - k AS INTEGER), round((t - o.m) / (n - 1), 6), NULL, NULL FROM o, w""")
def permutation_overall(spark, folder):
    """The permutations are replayed in the SQL from the same hash."""
    df = profile_rows(spark, folder)
    fit = ordination.redundancy(df, H, CROSSED, SITE)
    out = permute.permutation_test(df, fit, key="sample", strata=["site"], n_perm=PERMUTATIONS)
    return _rounded(_rounded(out, 6, ["f"]), 4, ["variance", "p"])


@query("permutation_by_site", "M14 M11", _WITHIN + """,
f AS (SELECT b, site, any_value(tt.n) AS n, any_value(k) AS k,
             (sum(ss) / any_value(k - 1)) / ((any_value(t) - sum(ss)) / any_value(tt.n - k)) AS f
      FROM pc JOIN tt USING (site) WHERE k > 1 AND tt.n > k GROUP BY ALL),
o AS (SELECT * FROM f WHERE b = 0)
SELECT o.site, CAST(any_value(o.k) - 1 AS INTEGER) AS df_model, CAST(any_value(o.n - o.k) AS INTEGER) AS df_residual,
       round(any_value(o.f), 4) AS f, (1 + count(*) FILTER (f.f >= o.f - """ + str(_CLOSE) + f""")) / {PERMUTATIONS + 1.0} AS p
FROM o JOIN f ON f.site = o.site AND f.b > 0 GROUP BY o.site""")
def permutation_by_site(spark, folder):
    out = permute.permutation_test_by(profile_rows(spark, folder), "site", H, TREATMENT, key="sample", n_perm=PERMUTATIONS)
    return _rounded(_rounded(out, 4, ["p"]), 6, ["f"])


@query("permutation_margin", "M12 M6")
def permutation_margin(spark, folder):
    df = profile_rows(spark, folder)
    fit = ordination.redundancy(df, H, Design([num("cn"), num("qty")]), SITE)
    return _rounded(permute.permutation_test(df, fit, key="sample", by="margin", n_perm=PERMUTATIONS))


@query("permutation_axis", "M13 M6")
def permutation_axis(spark, folder):
    df = profile_rows(spark, folder)
    design = Design(crossed(num("cn"), factor("treatment")), levels=LEVELS)
    fit = ordination.redundancy(df, H, design)
    return _rounded(permute.permutation_test(df, fit, key="sample", by="axis", n_perm=PERMUTATIONS))


@query("vector_fit", "M17", _PC + """,
vc AS (SELECT sample, p1 - avg(p1) OVER () AS x, p2 - avg(p2) OVER () AS y, cn - avg(cn) OVER () AS cn, qty - avg(qty) OVER () AS qty,
              tax - avg(tax) OVER () AS tax FROM pt JOIN covariates USING (sample) WHERE cn IS NOT NULL),
gg AS (SELECT sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy, sum(cn * cn) AS t_cn, sum(qty * qty) AS t_qty,
              sum(tax * tax) AS t_tax FROM vc), """ + permutations("vc", "sample", "0", PERMUTATIONS) + """,
vp AS (SELECT m.b, d.x, d.y, s.cn, s.qty, s.tax FROM moved m JOIN vc s ON s.sample = m.key JOIN vc d ON d.sample = m.onto
       UNION ALL SELECT 0, x, y, cn, qty, tax FROM vc),
vs AS (""" + " UNION ALL ".join(
    f"SELECT '{v}' AS variable, b, sum(x * {v}) AS u, sum(y * {v}) AS w, any_value(t_{v}) AS t FROM vp, gg GROUP BY b"
    for v in ("cn", "qty", "tax")) + """),
vr AS (SELECT variable, b, u, w, xx, xy, yy, (u * u * yy - 2 * u * w * xy + w * w * xx) / (xx * yy - xy * xy) / t AS r2 FROM vs, gg),
vo AS (SELECT variable, (u * yy - w * xy) / (xx * yy - xy * xy) AS s1, (w * xx - u * xy) / (xx * yy - xy * xy) AS s2, r2
       FROM vr WHERE b = 0)
SELECT variable, round(any_value(s1 / sqrt(s1 * s1 + s2 * s2)), 5) AS "PC1", round(any_value(s2 / sqrt(s1 * s1 + s2 * s2)), 5) AS "PC2",
       round(any_value(vo.r2), 6) AS r2, (1 + count(*) FILTER (vr.r2 >= vo.r2 - """ + str(_CLOSE) + f""")) / {PERMUTATIONS + 1.0} AS p
FROM vo JOIN vr USING (variable) WHERE b > 0 GROUP BY variable""")
def vector_fit(spark, folder):
    df = profile_rows(spark, folder)
    fit = ordination.principal_components(df, H)
    scored = save_and_reload(ordination.row_scores(df, fit).select("sample", "PC1", "PC2", "cn", "qty", "tax"), "scores")
    out = permute.fit_vectors(scored, ["PC1", "PC2"], ["cn", "qty", "tax"], key="sample", n_perm=PERMUTATIONS)
    return _rounded(_rounded(out, 6, ["PC1", "PC2"]), 5, ["r2", "p"])


@query("factor_fit", "M17", _PC + ", " + permutations("h", "sample", "0", PERMUTATIONS) + """,
fp AS (SELECT m.b, d.treatment, s.p1, s.p2 FROM moved m JOIN pt s ON s.sample = m.key JOIN h d ON d.sample = m.onto
       UNION ALL SELECT 0, treatment, p1, p2 FROM pt),
ft AS (SELECT avg(p1) AS m1, avg(p2) AS m2, var_pop(p1) * count(*) + var_pop(p2) * count(*) AS t FROM pt),
fc AS (SELECT b, treatment, count(*) * (power(avg(p1) - any_value(m1), 2) + power(avg(p2) - any_value(m2), 2)) AS ss FROM fp, ft GROUP BY ALL),
fr AS (SELECT b, sum(ss) / any_value(t) AS r2 FROM fc, ft GROUP BY b),
fo AS (SELECT r2 FROM fr WHERE b = 0)
SELECT 'treatment' AS variable, round(any_value(fo.r2), 6) AS r2,
       (1 + count(*) FILTER (fr.r2 >= fo.r2 - """ + str(_CLOSE) + f""")) / {PERMUTATIONS + 1.0} AS p FROM fr, fo WHERE b > 0""")
def factor_fit(spark, folder):
    df = profile_rows(spark, folder)
    fit = ordination.principal_components(df, H)
    scored = ordination.row_scores(df, fit)
    return _rounded(permute.fit_factor(scored, ["PC1", "PC2"], "treatment", LEVELS["treatment"], key="sample",
                                       n_perm=PERMUTATIONS))


_ANCHORS = SQL_H.replace('sqrt("ECONOMY") AS a', '"ECONOMY" AS a').replace('sqrt("LARGE") AS b', '"LARGE" AS b') \
    .replace('sqrt("SMALL_MEDIUM") AS c', '"SMALL_MEDIUM" AS c').replace('sqrt("STANDARD") AS d', '"STANDARD" AS d') + """,
k AS (SELECT site AS anchor, avg(a) AS ka, avg(b) AS kb, avg(c) AS kc, avg(d) AS kd FROM h GROUP BY 1)"""


@query("anchor_distance_bray", "M18 DM11 J9", _ANCHORS + """
SELECT sample, anchor, round((abs(a - ka) + abs(b - kb) + abs(c - kc) + abs(d - kd)) /
       (a + b + c + d + ka + kb + kc + kd), 6) AS d FROM h, k""")
def anchor_distance_bray(spark, folder):
    df = b.profiles(spark, folder)
    sites = distance.group_profiles(df, "site", b.GROUPS)
    return _rounded(distance.to_anchors(df, "sample", b.GROUPS, sites, "site"))


@query("anchor_distance_euclidean", "M18", _ANCHORS + """
SELECT sample, anchor, round(sqrt(power(a - ka, 2) + power(b - kb, 2) + power(c - kc, 2) + power(d - kd, 2)), 6) AS d
FROM h, k""")
def anchor_distance_euclidean(spark, folder):
    df = b.profiles(spark, folder)
    sites = distance.group_profiles(df, "site", b.GROUPS)
    return _rounded(distance.to_anchors(df, "sample", b.GROUPS, sites, "site", metric="euclidean"))


@query("principal_coordinates", "M19")
def principal_coordinates(spark, folder):
    df = profile_rows(spark, folder)
    cells = distance.group_profiles(df, "trt_id", b.GROUPS)
    points, _ = distance.principal_coordinates(df, "sample", b.GROUPS, cells, "trt_id", k=3)
    return _rounded(points)


@query("scaling_eigenvalues", "M19")
def scaling_eigenvalues(spark, folder):
    df = profile_rows(spark, folder)
    cells = distance.group_profiles(df, "trt_id", b.GROUPS)
    _, values = distance.principal_coordinates(df, "sample", b.GROUPS, cells, "trt_id", k=3)
    return _rounded(distance.eigenvalue_table(df, values), 5)


@query("scaled_component_scores", "M18 M19")
def scaled_component_scores(spark, folder):
    df = profile_rows(spark, folder)
    cells = distance.group_profiles(df, "trt_id", b.GROUPS)
    points, _ = distance.principal_coordinates(df, "sample", b.GROUPS, cells, "trt_id", k=2, keep=b.GROUPS)
    return _rounded(distance.column_scores(points, b.GROUPS, ["Axis1", "Axis2"]), 5)


@query("ordination_stress", "M20 M18 M19")
def ordination_stress(spark, folder):
    df = profile_rows(spark, folder)
    cells = save_and_reload(distance.group_profiles(df, "trt_id", b.GROUPS), "cells")
    axes = ["Axis1", "Axis2"]
    points, _ = distance.principal_coordinates(df, "sample", b.GROUPS, cells, "trt_id", k=2, keep=b.GROUPS)
    placed, _ = distance.principal_coordinates(cells, "trt_id", b.GROUPS, cells, "trt_id", k=2, keep=b.GROUPS)
    pairs = distance.several_to_anchors(points, "sample", placed, "trt_id",
                                        {"d": (b.GROUPS, "bray"), "d_ord": (axes, "euclidean")})
    return _rounded(distance.stress(pairs, "d", "d_ord"), 5)


_COMPONENT_PAIRS = (RECURSIVE + "," + covariance("cov", "h", "abcd") + "," + eigenpairs("pc", "cov", 4, 2) + """,
mm AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(d) AS md FROM h),
pt AS (SELECT sample, site, a, b, c, d, (a - ma) * x.v1 + (b - mb) * x.v2 + (c - mc) * x.v3 + (d - md) * x.v4 AS p1,
              (a - ma) * y.v1 + (b - mb) * y.v2 + (c - mc) * y.v3 + (d - md) * y.v4 AS p2 FROM h, mm, pc1 x, pc2 y),
an AS (SELECT site, avg(a) AS a, avg(b) AS b, avg(c) AS c, avg(d) AS d, avg(p1) AS p1, avg(p2) AS p2 FROM pt GROUP BY 1),
pairs AS (SELECT sqrt(power(pt.a - an.a, 2) + power(pt.b - an.b, 2) + power(pt.c - an.c, 2) + power(pt.d - an.d, 2)) AS d,
                 sqrt(power(pt.p1 - an.p1, 2) + power(pt.p2 - an.p2, 2)) AS o FROM pt, an)""")


@query("component_stress", "M20 M18 M3", _COMPONENT_PAIRS + "," + rising_pools("pairs", "d", "o") + """
SELECT count(*) AS n_pairs, round(sqrt(greatest(sum(o * o) - (SELECT sum(s * s / w) FROM pools), 0) / sum(o * o)), 5) AS stress FROM pairs""")
def component_stress(spark, folder):
    """How well the distances to site centroids on two components follow those in the full space."""
    df = profile_rows(spark, folder)
    vectors, axes = ordination.principal_components(df, H).vectors, ["p1", "p2"]
    placed = df.withColumns({a: sum((F.col(h) * float(vectors[j, k]) for j, h in enumerate(H)), F.lit(0.0)) for k, a in enumerate(axes)})
    sites = distance.group_profiles(placed, "site", [*H, *axes])
    pairs = distance.several_to_anchors(placed, "sample", sites, "site", {"d": (H, "euclidean"), "d_ord": (axes, "euclidean")})
    return _rounded(distance.stress(pairs, "d", "d_ord"), 5)


def _farthest_sql(k: int) -> str:
    """Landmarks one after the other: each step adds the distance to the last one and takes the farthest row."""
    far = "sqrt(power(e.a - l.a, 2) + power(e.b - l.b, 2) + power(e.c - l.c, 2) + power(e.d - l.d, 2))"
    sql = RECURSIVE + """,
e0 AS MATERIALIZED (SELECT sample, a, b, c, d, CAST('inf' AS DOUBLE) AS near, 0 AS spot FROM h),
l1 AS MATERIALIZED (SELECT 1 AS step, * FROM e0 ORDER BY sample LIMIT 1)"""
    for i in range(1, k + 1):
        sql += f""",
e{i} AS MATERIALIZED (SELECT e.sample, e.a, e.b, e.c, e.d, least(e.near, {far}) AS near, CASE WHEN {far} < e.near THEN {i} ELSE e.spot END AS spot
  FROM e{i - 1} e, l{i} l)"""
        if i < k:
            sql += f""",
l{i + 1} AS MATERIALIZED (SELECT {i + 1} AS step, * FROM e{i} WHERE near > 0 ORDER BY near DESC, sample LIMIT 1)"""
    chosen = " UNION ALL ".join(f"SELECT step, sample, near FROM l{i}" for i in range(1, k + 1))
    return sql + f""",
ls AS ({chosen}), cv AS (SELECT spot AS step, count(*) AS n_rows, max(near) AS radius FROM e{k} GROUP BY 1)
SELECT step, sample, CASE WHEN step > 1 THEN round(near, 6) END AS distance, n_rows, round(radius, 6) AS radius FROM ls JOIN cv USING (step)"""


@query("landmark_rows", "M19 M18", _farthest_sql(8))
def landmark_rows(spark, folder):
    """Eight samples that cover all profiles: each the farthest from those before, with the rows nearest to it."""
    df = profile_rows(spark, folder)
    chosen = landmarks.farthest_first(df, "sample", H, 8)
    cover = landmarks.coverage(df, H, chosen)
    return _rounded(chosen.select("step", "sample", "distance").join(cover, "step"))


def _nonmetric(spark, folder):
    df = profile_rows(spark, folder)
    chosen = landmarks.farthest_first(df, "sample", b.GROUPS, 30, metric="bray")
    return landmarks.nonmetric_scaling(df, "sample", b.GROUPS, chosen, "sample", metric="bray", restarts=20)


@query("nonmetric_points", "M18 M19 M20")
def nonmetric_points(spark, folder):
    """Every sample on two non-metric axes, with the stress of its own distances to the landmarks."""
    return _rounded(_nonmetric(spark, folder).rows, 5)


@query("nonmetric_trials", "M20")
def nonmetric_trials(spark, folder):
    """Stress at the end of every restart; the rows are placed on the best."""
    fit = _nonmetric(spark, folder)
    return _rounded(fit.trials.select("restart", "steps", "stress", (F.col("stress") == fit.stress).alias("best")), 6)


# Meta-analysis ---------------------------------------------------------------

META = MD + CELL_COVARIATES + """,
j AS (SELECT *, split_part(trt_id, '_', 3) AS biome FROM es LEFT JOIN cov USING (trt_id))"""
TREATED = [t for t in b.TREATMENTS if t != b.CONTROL]
_BIOMES = [f"CASE WHEN biome = '{t}' THEN 1 ELSE 0 END" for t in TREATED]


def _bins(column: str) -> list[str]:
    return [f"CASE WHEN {column} = {i} THEN 1 WHEN {column} IS NOT NULL THEN 0 END" for i in (1, 2, 3)]


_BINNED = META + "".join(f""",
q_{x} AS (SELECT quantile_cont({x}, 1.0 / 3) AS a_{x}, quantile_cont({x}, 2.0 / 3) AS z_{x} FROM j)""" for x in ("n_added", "n_rate")) + """,
jb AS (SELECT *, CASE WHEN n_added <= a_n_added THEN 1 WHEN n_added <= z_n_added THEN 2 WHEN n_added IS NOT NULL THEN 3 END AS f_nad,
  CASE WHEN n_rate <= a_n_rate THEN 1 WHEN n_rate <= z_n_rate THEN 2 WHEN n_rate IS NOT NULL THEN 3 END AS f_nrt
  FROM j, q_n_added, q_n_rate)"""
LEVEL_SQL = _BINNED + ", rows AS (" + stacked_models({
    "biome-1": ("jb", _BIOMES, "true"), "f_nad-1": ("jb", _bins("f_nad"), "true"),
    "f_nrt-1": ("jb", _bins("f_nrt"), "true")}, 4, "yi", "vi") + ")," + restricted_search("rows", 4)
BINS = {"f_nad": ("n_added", 3), "f_nrt": ("n_rate", 3)}


def _rom(spark, folder, bins=None):
    return rom_table(spark, folder, bins).withColumns({
        "biome": F.substring_index("trt_id", "_", -1), "obs": F.col("sdn").cast("string")})


@query("equal_effects", "E6", META + """
SELECT count(*) AS k, round(sum(yi / vi) / sum(1 / vi), 6) AS estimate, round(sqrt(1 / sum(1 / vi)), 6) AS se,
       round(sum(yi * yi / vi) - power(sum(yi / vi), 2) / sum(1 / vi), 4) AS q,
       round(greatest(0, (sum(yi * yi / vi) - power(sum(yi / vi), 2) / sum(1 / vi) - (count(*) - 1)) /
         (sum(1 / vi) - sum(1 / (vi * vi)) / sum(1 / vi))), 6) AS tau2_moment
FROM j WHERE vi > 0 AND yi IS NOT NULL""")
def equal_effects(spark, folder):
    out = meta.pooled_moments(_rom(spark, folder))
    return out.select("k", tidy("estimate").alias("estimate"), tidy("se").alias("se"), tidy("q", 4).alias("q"),
                      tidy("tau2_moment").alias("tau2_moment"))


@query("equal_effects_moderator", "E6 E9 E13", META + """,
s AS (SELECT sum(1 / vi) AS w, sum(n_added / vi) AS wx, sum(yi / vi) AS wy, sum(n_added * n_added / vi) AS wxx,
             sum(n_added * yi / vi) AS wxy FROM j WHERE vi > 0 AND yi IS NOT NULL AND n_added IS NOT NULL)
SELECT 'intrcpt' AS term, round((wxx * wy - wx * wxy) / (w * wxx - wx * wx), 5) AS estimate,
       round(sqrt(wxx / (w * wxx - wx * wx)), 5) AS se FROM s
UNION ALL SELECT 'n_added', round((w * wxy - wx * wy) / (w * wxx - wx * wx), 5),
       round(sqrt(w / (w * wxx - wx * wx)), 5) FROM s""")
def equal_effects_moderator(spark, folder):
    fits = mixed.fit(_rom(spark, folder), [intercept_and("n_added")], random="none")
    return meta.coefficients(fits).select("term", tidy("estimate", 5).alias("estimate"), tidy("se", 5).alias("se"))


@query("random_effects", "E7 E14", META + "," + variance_search("j", "row") + """,
t AS (SELECT (count(*) - 1) * sum(1 / vi) / (power(sum(1 / vi), 2) - sum(1 / (vi * vi))) AS typical,
             sum(yi * yi / vi) - power(sum(yi / vi), 2) / sum(1 / vi) AS q FROM e)
SELECT round(s, 5) AS tau2, round(s / (s + typical), 4) AS i2, round(1 + s / typical, 4) AS h2,
       round(q, 4) AS qe, n - 1 AS qe_df, round(-2 * ll + 4, 4) AS aic,
       round(""" + chi2_tail("q", "n - 1") + """, 6) AS qe_p FROM reml, t""")
def random_effects(spark, folder):
    rom = _rom(spark, folder)
    fits = mixed.fit(rom, [intercept_and()], random="row")
    out = meta.model_performance(fits, rom).select("tau2", "i2", "h2", "qe", "qe_df", "aic", tidy("qe_p").alias("qe_p"))
    return _rounded(_rounded(out, 4, ["tau2", "qe_p"]), 5, ["i2", "h2", "qe", "aic", "qe_p"])


@query("heterogeneity_per_model", "E14 E7", META + """,
u AS (SELECT yi, vi, n_added AS x, 'intercept' AS model FROM j WHERE vi > 0 AND yi IS NOT NULL
      UNION ALL SELECT yi, vi, n_added, 'moderator' FROM j WHERE vi > 0 AND yi IS NOT NULL AND n_added IS NOT NULL),
s AS (SELECT model, count(*) AS k, sum(1 / vi) AS w, sum(x / vi) AS wx, sum(x * x / vi) AS wxx, sum(1 / (vi * vi)) AS v,
             sum(x / (vi * vi)) AS vx, sum(x * x / (vi * vi)) AS vxx FROM u GROUP BY 1)
SELECT model, round(CASE model WHEN 'intercept' THEN (k - 1) / (w - v / w)
  ELSE (k - 2) / (w - (wxx * v - 2 * wx * vx + w * vxx) / (w * wxx - wx * wx)) END, 6) AS typical FROM s""")
def heterogeneity_per_model(spark, folder):
    """The typical sampling variance behind I² and H², for two models at once."""
    models = [intercept_and(name="intercept"), intercept_and("n_added", name="moderator")]
    found = meta.typical_variance(_rom(spark, folder), models)
    return _rounded(spark.createDataFrame(list(found.items()), "model string, typical double"))


@query("site_random_effects", "E8 E13 E14 DM10", META + "," + variance_search("j", "group") + """
SELECT round(estimate, 5) AS estimate, round(sqrt(1 / a), 5) AS se, round(estimate * sqrt(a), 4) AS zval,
       round(estimate - 1.959963984540054 / sqrt(a), 5) AS ci_lb, round(s, 5) AS sigma2, round(ll, 5) AS loglik,
       n, round(-2 * ll + 4.0 * (n - 1) / (n - 4), 4) AS aicc,
       round(""" + z_tail("estimate * sqrt(a)") + """, 6) AS pval FROM reml""")
def site_random_effects(spark, folder):
    fits = mixed.fit(_rom(spark, folder), [intercept_and()])
    out = meta.coefficients(fits).join(meta.information(fits), "model").select(
        "estimate", "se", "zval", "ci_lb", "sigma2", "loglik", "n", "aicc", tidy("pval").alias("pval"))
    return _rounded(_rounded(out, 4, ["estimate", "se", "ci_lb", "sigma2", "loglik", "pval"]), 5, ["zval", "aicc", "pval"])


@query("level_estimates", "E10 E13 A6 E19", LEVEL_SQL + ", co AS (" + coefficient_rows({
    "biome-1": [f"biome[{t}]" for t in TREATED], "f_nad-1": [f"f_nad[{i}]" for i in (1, 2, 3)],
    "f_nrt-1": [f"f_nrt[{i}]" for i in (1, 2, 3)]}) + """),
sizes AS (SELECT 'biome[' || biome || ']' AS term, count(*) AS size FROM jb GROUP BY ALL
  UNION ALL SELECT 'f_nad[' || f_nad || ']', count(*) FROM jb GROUP BY ALL
  UNION ALL SELECT 'f_nrt[' || f_nrt || ']', count(*) FROM jb GROUP BY ALL)
SELECT term, estimate, se, size FROM co LEFT JOIN sizes USING (term)""")
def level_estimates(spark, folder):
    rom = _rom(spark, folder, BINS)
    fits = mixed.fit(rom, [level_means("biome", TREATED), level_means("f_nad", [1, 2, 3]),
                           level_means("f_nrt", [1, 2, 3])])
    table = meta.coefficients(fits)
    parts = [meta.with_level_counts(table.where(F.col("model") == f"{c}-1"), rom, c, kind)
             for c, kind in (("biome", "Biome"), ("f_nad", "N added"), ("f_nrt", "N rate"))]
    return _rounded(meta.facet_table(*parts).select("term", "estimate", "se", "size"), 5)


QUADRATIC_ADDED = intercept_and("n_added", n_added2="`n_added` * `n_added`")


@query("quadratic_nested", "E11", META + ", rows AS (" + stacked_models(
    {"m": ("j", ["1", "n_added", "n_added * n_added"], "true")}, 3, "yi", "vi") + ")," + nested_search("rows", 3) + ", co AS (" + coefficient_rows({"m": ["intrcpt", "n_added", "n_added2"]}) + """)
SELECT term, estimate, se, round(t, 5) AS tau2, round(s, 5) AS sigma2, round(ll, 5) AS loglik FROM co, fit""")
def quadratic_nested(spark, folder):
    fits = mixed.fit(_rom(spark, folder), [QUADRATIC_ADDED], random="group/row")
    table = meta.coefficients(fits).join(fits.select("model", "tau2", "sigma2", "loglik"), "model")
    return _rounded(table.select("term", "estimate", "se", "tau2", "sigma2", "loglik"), 5)


@query("quadratic_prediction", "E11 E15 F15 A10")
def quadratic_prediction(spark, folder):
    rom = _rom(spark, folder)
    fits = mixed.fit(rom, [QUADRATIC_ADDED], random="group/row")
    limits = rom.agg(F.struct(F.min("n_added").alias("lo"), F.max("n_added").alias("hi")).alias("s")).scalar()
    grid = spark.range(100).select((limits["lo"] + F.col("id") * (limits["hi"] - limits["lo"]) / 99).alias("n_added"),
                                   F.lit(QUADRATIC_ADDED.name).alias("model"))
    return _rounded(meta.predict(fits, grid, {"intrcpt": "1D", "n_added": "n_added", "sq": "n_added * n_added"}), 5)


def _ranked(sets: str) -> str:
    """AICc rows from CTE ``fit``; one variance component."""
    return f""",
ic AS (SELECT key AS model, p + 1 AS df, CASE WHEN n >= p THEN -2 * ll + 2.0 * (p + 1) * (n - p) / nullif(greatest(n - p - p - 2, 0), 0) END AS aicc,
              {sets} AS candidate_set FROM fit)
SELECT model, CAST(df AS INTEGER) AS df, round(aicc, 4) AS aicc, candidate_set,
       round(aicc - min(aicc) OVER (PARTITION BY candidate_set), 4) AS delta,
       rank() OVER (PARTITION BY candidate_set ORDER BY aicc) AS rank FROM ic"""


@query("subset_fits", "E12 E17", META + ", rows AS (" + stacked_models({
    f"{biome}:{name}": ("j", cols, f"biome = '{biome}'") for biome in ("AUTOMOBILE", "MACHINERY")
    for name, cols in (("1", ["1"]), ("n_added", ["1", "n_added"]))}, 2, "yi", "vi") + "),"
    + restricted_search("rows", 2) + _ranked("split_part(key, ':', 1)"))
def subset_fits(spark, folder):
    models = []
    for biome in ("AUTOMOBILE", "MACHINERY"):
        where = f"biome = '{biome}'"
        models += [intercept_and(where=where, name=f"{biome}:1"),
                   intercept_and("n_added", where=where, name=f"{biome}:n_added")]
    fits = mixed.fit(_rom(spark, folder), models)
    sets = {biome: [f"{biome}:1", f"{biome}:n_added"] for biome in ("AUTOMOBILE", "MACHINERY")}
    return _rounded(meta.compare(fits, sets), 4)


MODERATORS = ["n_added", "n_rate", "n_year", "cnratio"]
SUBSETS = [[m for i, m in enumerate(MODERATORS) if mask >> i & 1] for mask in range(16)]


@query("candidate_models", "E18 E17 E9", META.replace("avg(tax) AS n_rate,", "avg(tax) AS n_rate, avg(n_year) AS n_year,")
       + ", rows AS (" + stacked_models({"+".join(["1", *s]): ("j", ["1", *s], "true") for s in SUBSETS}, 5, "yi", "vi")
       + ")," + restricted_search("rows", 5) + _ranked("'all'"))
def candidate_models(spark, folder):
    """Every subset of the moderators, fitted as rows of one job."""
    models = [intercept_and(*s) for s in SUBSETS]
    return _rounded(meta.compare(mixed.fit(_rom(spark, folder), models)), 4)


@query("outcome_models", "E4 E7 E13", META + "," + variance_search(
    "j", "row", by="split_part(trt_id, '_', 3)") + """
SELECT key || '|1' AS model, round(estimate, 5) AS estimate, round(sqrt(1 / a), 5) AS se FROM reml""")
def outcome_models(spark, folder):
    """The same model for several outcomes at once: one per treatment level."""
    fits = mixed.fit(_rom(spark, folder), [intercept_and()], outcome="biome", random="row")
    return _rounded(meta.coefficients(fits).select("model", "estimate", "se"), 5)


@query("prediction_grid", "E15 A10", META + """,
e AS (SELECT 1 / vi AS w, yi, n_added AS x, cnratio AS z FROM j
      WHERE vi > 0 AND yi IS NOT NULL AND n_added IS NOT NULL AND cnratio IS NOT NULL),
m AS (SELECT sum(w) AS sw, sum(w * yi) / sum(w) AS my, sum(w * x) / sum(w) AS mx, sum(w * z) / sum(w) AS mz FROM e),
p AS (SELECT sum(w * (x - mx) * (z - mz)) / sum(w * (z - mz) * (z - mz)) AS k FROM e, m),
b AS (SELECT sum(w * (z - mz) * yi) / sum(w * (z - mz) * (z - mz)) AS bz, sum(w * (z - mz) * (z - mz)) AS szz,
             sum(w * (x - mx - k * (z - mz)) * yi) / sum(w * power(x - mx - k * (z - mz), 2)) AS bx,
             sum(w * power(x - mx - k * (z - mz), 2)) AS sxx FROM e, m, p),
r AS (SELECT min(n_added) AS lo, max(n_added) AS hi, avg(cnratio) AS cn FROM j),
g AS (SELECT lo + i * (hi - lo) / 99 AS n_added, cn FROM r, range(100) t(i))
SELECT round(n_added, 5) AS n_added, round(my + bz * (cn - mz) + bx * (n_added - mx - k * (cn - mz)), 5) AS pred,
  round(sqrt(1 / sw + power(cn - mz, 2) / szz + power(n_added - mx - k * (cn - mz), 2) / sxx), 5) AS se
FROM g, m, p, b""")
def prediction_grid(spark, folder):
    rom = _rom(spark, folder)
    model = intercept_and("n_added", "cnratio")
    fits = mixed.fit(rom, [model], random="none")
    s = rom.agg(F.struct(F.min("n_added").alias("lo"), F.max("n_added").alias("hi"),
                         F.avg("cnratio").alias("cn")).alias("s")).scalar()
    grid = spark.range(100).select(F.lit(model.name).alias("model"), s["cn"].alias("cnratio"),
                                   (s["lo"] + F.col("id") * (s["hi"] - s["lo"]) / 99).alias("n_added"))
    return _rounded(meta.predict(fits, grid, {"intrcpt": "1D", "n_added": "n_added", "cnratio": "cnratio"}).select(
        "n_added", "pred", "se"), 5)


WEIGHTS = META + "," + variance_search("j", "group") + """,
d AS (SELECT j.site, trt_id, yi, vi, 1 / vi - s / (1 + s * w) / (vi * vi) AS d FROM j JOIN g USING (site), reml
      WHERE vi > 0 AND yi IS NOT NULL),
wt AS (SELECT site, trt_id, yi, vi, d * 100 / sum(d) OVER () AS weight FROM d)"""


@query("model_weights", "E16", WEIGHTS + "SELECT trt_id, site, round(weight, 4) AS weight FROM wt")
def model_weights(spark, folder):
    rom = _rom(spark, folder)
    return _rounded(meta.row_weights(rom, mixed.fit(rom, [intercept_and()]), key="trt_id").drop("model"), 4)


@query("forest_rows", "E19 E16 U1", WEIGHTS + """
SELECT trt_id AS label, round(yi, 5) AS estimate, round(yi - 1.96 * sqrt(vi), 5) AS ci_lb,
       round(yi + 1.96 * sqrt(vi), 5) AS ci_ub, round(weight, 4) AS weight, 'effect' AS type FROM wt
UNION ALL SELECT 'intrcpt', round(estimate, 5), round(estimate - 1.959963984540054 / sqrt(a), 5),
       round(estimate + 1.959963984540054 / sqrt(a), 5), NULL, 'summary' FROM reml""")
def forest_rows(spark, folder):
    rom = _rom(spark, folder)
    fits = mixed.fit(rom, [intercept_and()])
    weights = meta.row_weights(rom, fits, key="trt_id").drop("model")
    out = (meta.forest_table(rom, meta.coefficients(fits), label="trt_id", weights=weights))
    return _rounded(_rounded(out, 5, ["weight"]), 4, ["estimate", "ci_lb", "ci_ub"])


# Regression ------------------------------------------------------------------

LINE = b.sql(b.SQL_COVARIATES) + " SELECT "


@query("linear_model_single", "L1", LINE + """'(Intercept)' AS term, round(regr_intercept(cn, n_lines), 5) AS estimate,
  round(regr_r2(cn, n_lines), 6) AS r2 FROM covariates
UNION ALL SELECT 'n_lines', round(regr_slope(cn, n_lines), 5), round(regr_r2(cn, n_lines), 6) FROM covariates""")
def linear_model_single(spark, folder):
    df = save_and_reload(b.covariates(spark, folder).select("cn", "n_lines"), "rows")
    fit = regress.ols(df, "cn", Design([num("n_lines")]))
    table = regress.coefficient_table(spark, fit).select("term", tidy("estimate", 5).alias("estimate"))
    return table.withColumn("r2", tidy(F.lit(1 - fit.rss / fit.tss)))


def _lm_rows(spark, folder):
    return save_and_reload(b.sample_table(spark, folder).where("lcratio > 0").withColumn("lrr", F.ln("lcratio")), "lm")


QUADRATIC = Design([num("n_lines"), num("cn"), squared("n_lines")])
LM = T + """,
lm AS (SELECT sample, treatment, ln(lcratio) AS lrr, n_lines, cn, n_lines * n_lines AS n2 FROM tab
       WHERE lcratio > 0 AND cn IS NOT NULL),""" + orthogonal_steps("lm", "lrr", ["n_lines", "cn", "n2"], "sample")
FULL = Design(crossed(num("cn"), factor("treatment")) + [logged("qty")], levels=LEVELS)


OTHERS = [t for t in b.TREATMENTS if t != b.CONTROL]
# Covariates are centred in the SQL too; coefficients of the uncentred intercept follow.
FULL_ROWS = T + """,
ln0 AS (SELECT sample, site, treatment, ln(lcratio) AS lrr, n_lines, cn, ln(qty) AS lq FROM tab
        WHERE lcratio > 0 AND cn IS NOT NULL),
lr AS (SELECT 'm' AS key, *, cn - avg(cn) OVER () AS cc, lq - avg(lq) OVER () AS lc, avg(cn) OVER () AS mc,
              avg(lq) OVER () AS ml FROM ln0)"""


def _full_columns(*blocks: str) -> list[str]:
    pieces = {"1": ["1"], "cn": ["cc"], "treatment": [f"CASE WHEN treatment = '{t}' THEN 1 ELSE 0 END" for t in OTHERS],
              "cn:treatment": [f"CASE WHEN treatment = '{t}' THEN cc ELSE 0 END" for t in OTHERS], "log(qty)": ["lc"]}
    return [c for blk in blocks for c in pieces[blk]]


def _design(name: str, *blocks: str) -> str:
    """CTEs for a least-squares fit of lrr on the named blocks, result in CTE ``{name}``."""
    cols = _full_columns(*blocks)
    body = ", ".join(f"({c})::DOUBLE AS x{i}" for i, c in enumerate(cols))
    return (f"{name}_x AS (SELECT key, lrr, {body} FROM lr)," + cross_products(f"{name}_c", f"{name}_x", len(cols), "lrr")
            + "," + sweep(name, f"{name}_c", len(cols), ["key", "n"]))


_FULL = ("1", "cn", "treatment", "cn:treatment", "log(qty)")
_FULL_NAMES = ["(Intercept)", "cn", *[f"treatment[{t}]" for t in OTHERS], *[f"cn:treatment[{t}]" for t in OTHERS], "log(qty)"]


@query("linear_model", "L1 L2", FULL_ROWS + "," + _design("fu", *_FULL) + "\n" + " UNION ALL ".join(
    f"SELECT '{n}' AS term, round(b{i}, 5) AS estimate, round(sqrt(v{i}_{i} * rss / (n - 11)), 5) AS se, "
    f"round(b{i} / sqrt(v{i}_{i} * rss / (n - 11)), 4) AS t, "
    f"round({t_tail(f'b{i} / sqrt(v{i}_{i} * rss / (n - 11))', 'n - 11')}, 6) AS p FROM fu"
    for i, n in enumerate(_FULL_NAMES) if n.startswith("cn") or n == "log(qty)"))
def linear_model(spark, folder):
    """Coefficients that do not depend on where the covariates are centred."""
    table = regress.coefficient_table(spark, regress.ols(_lm_rows(spark, folder), "lrr", FULL))
    kept = table.where("term LIKE 'cn%' OR term = 'log(qty)'").select("term", "estimate", "se", "t", "p")
    return _rounded(_rounded(_rounded(kept, 5, ["t", "p"]), 4, ["estimate", "se", "p"]), 6, ["estimate", "se", "t"])


@query("linear_model_all_terms", "L1 L2")
def linear_model_all_terms(spark, folder):
    return _rounded(regress.coefficient_table(spark, regress.ols(_lm_rows(spark, folder), "lrr", FULL)))


def _f_rows(table):
    """An F table, rounded as in the SQL."""
    return table.select("term", "df", tidy("sum_sq", 5).alias("sum_sq"), tidy("f", 4).alias("f"), tidy("p", 6).alias("p"))


@query("linear_summary", "L1", LM + """,
r AS (SELECT n, tss, tss - s1 - s2 - s3 AS rss FROM ss)
SELECT n, CAST(n - 4 AS INTEGER) AS df_residual, round(sqrt(rss / (n - 4)), 6) AS sigma, round(1 - rss / tss, 6) AS r2,
       round(1 - rss / tss * (n - 1) / (n - 4), 6) AS adj_r2, round((tss - rss) / 3 / (rss / (n - 4)), 5) AS f,
       round(-n / 2.0 * (ln(2 * pi()) + ln(rss / n) + 1), 4) AS loglik,
       round(n * (ln(2 * pi()) + ln(rss / n) + 1) + 10.0 * n / (n - 6), 4) AS aicc,
       round(""" + f_tail("(tss - rss) / 3 / (rss / (n - 4))", "3", "n - 4") + """, 6) AS p FROM r""")
def linear_summary(spark, folder):
    out = regress.fit_summary(spark, regress.ols(_lm_rows(spark, folder), "lrr", QUADRATIC))
    out = _rounded(out, 6, ["f", "loglik", "aicc"])
    return _rounded(_rounded(out, 4, ["sigma", "r2", "adj_r2", "f", "p"]), 5, ["sigma", "r2", "adj_r2", "loglik", "aicc", "p"])


@query("sequential_terms", "L3 L2", LM + """,
r AS (SELECT *, (tss - s1 - s2 - s3) AS rss, (tss - s1 - s2 - s3) / (n - 4) AS ms FROM ss)
SELECT term, CAST(df AS INTEGER) AS df, round(ss, 5) AS sum_sq, round(f, 4) AS f,
  CASE WHEN f IS NOT NULL THEN round(""" + f_tail("f", "df", "n - 4") + """, 6) END AS p FROM r, LATERAL (VALUES
  ('n_lines', 1, s1, s1 / ms), ('cn', 1, s2, s2 / ms), ('n_lines^2', 1, s3, s3 / ms), ('Residuals', n - 4, rss, NULL))
  AS x(term, df, ss, f)""")
def sequential_terms(spark, folder):
    return _f_rows(regress.sequential_table(spark, regress.ols(_lm_rows(spark, folder), "lrr", QUADRATIC)))


@query("nested_models", "L3", LM + """
SELECT '-n_lines^2' AS term, CAST(1 AS INTEGER) AS df, round(s3, 5) AS sum_sq,
       round(s3 / ((tss - s1 - s2 - s3) / (n - 4)), 4) AS f,
       round(""" + f_tail("s3 / ((tss - s1 - s2 - s3) / (n - 4))", "1", "n - 4") + """, 6) AS p FROM ss""")
def nested_models(spark, folder):
    fit = regress.ols(_lm_rows(spark, folder), "lrr", QUADRATIC)
    return _f_rows(regress.nested_test(spark, fit, "n_lines^2"))


@query("type_two_terms", "L4", FULL_ROWS + "," + ",".join([
    _design("fu", *_FULL), _design("nocn", "1", "treatment", "log(qty)"), _design("notr", "1", "cn", "log(qty)"),
    _design("main", "1", "cn", "treatment", "log(qty)"), _design("nolq", "1", "cn", "treatment", "cn:treatment")]) + """,
s2 AS (SELECT fu.rss / (fu.n - 11) AS ms, fu.n, fu.rss, nocn.rss - main.rss AS cn, notr.rss - main.rss AS tr,
              main.rss - fu.rss AS ia, nolq.rss - fu.rss AS lq FROM fu, nocn, notr, main, nolq)
SELECT term, CAST(df AS INTEGER) AS df, round(ss, 5) AS sum_sq, round(CASE WHEN term <> 'Residuals' THEN ss / df / ms END, 4) AS f,
  CASE WHEN term <> 'Residuals' THEN round(""" + f_tail("ss / df / ms", "df", "n - 11") + """, 6) END AS p
FROM s2, LATERAL (VALUES ('cn', 1, cn), ('treatment', 4, tr), ('cn:treatment', 4, ia), ('log(qty)', 1, lq),
  ('Residuals', n - 11, rss)) AS x(term, df, ss)""")
def type_two_terms(spark, folder):
    return _f_rows(regress.type_two_table(spark, regress.ols(_lm_rows(spark, folder), "lrr", FULL)))


@query("linear_comparison", "L5", LM + """,
w AS (SELECT sum(c * power(m - (SELECT avg(lrr) FROM lm), 2)) AS between
      FROM (SELECT count(*) AS c, avg(lrr) AS m FROM lm GROUP BY treatment)),
a AS (SELECT model, k, n * (ln(2 * pi()) + ln(rss / n) + 1) + 2.0 * k * n / (n - k - 1) AS aicc FROM ss, w,
  LATERAL (VALUES ('quadratic', 5, tss - s1 - s2 - s3), ('linear', 4, tss - s1 - s2), ('treatment', 6, tss - between))
  AS x(model, k, rss))
SELECT model, CAST(k AS INTEGER) AS df, round(aicc, 4) AS aicc, round(aicc - min(aicc) OVER (), 4) AS delta,
       CAST(rank() OVER (ORDER BY aicc) AS INTEGER) AS rank FROM a""")
def linear_comparison(spark, folder):
    df = _lm_rows(spark, folder)
    designs = {"quadratic": QUADRATIC, "linear": QUADRATIC.without("n_lines^2"),
               "treatment": Design([factor("treatment")], levels=LEVELS)}
    return _rounded(regress.compare_aicc(spark, {n: regress.ols(df, "lrr", d) for n, d in designs.items()}), 4)


@query("mixed_model", "L6", FULL_ROWS + ", rows AS (" + stacked_models(
    {"1+n_lines+cn": ("lr", ["1", "n_lines", "cn"], "true")}, 3, "lrr", "1.0") + "),"
    + restricted_search("rows", 3, estimated=True) + "\n"
    + coefficient_rows({"1+n_lines+cn": ["intrcpt", "n_lines", "cn"]}, 4))
def mixed_model(spark, folder):
    fits = regress.random_intercept(_lm_rows(spark, folder), [intercept_and("n_lines", "cn")], response="lrr", group="site")
    return _rounded(regress.wald_table(fits).select("model", "term", "estimate", "se"), 4)


@query("mixed_model_f", "L6")
def mixed_model_f(spark, folder):
    fits = regress.random_intercept(_lm_rows(spark, folder), [intercept_and("n_lines", "cn")], response="lrr", group="site")
    return _rounded(regress.f_table(fits), 4)


@query("covariance_model", "L7", FULL_ROWS + """,
ct AS (SELECT site, ln(avg(lcratio)) AS log_c FROM tab WHERE lcratio > 0 AND treatment = 'BUILDING' GROUP BY 1),
an AS (SELECT lr.*, log_c FROM lr JOIN ct USING (site) WHERE treatment <> 'BUILDING'),
rows AS (""" + stacked_models({"1+log_c+n_lines+cn": ("an", ["1", "log_c", "n_lines", "cn"], "true")}, 4, "lrr", "1.0") + "),"
    + restricted_search("rows", 4, estimated=True) + "\n"
    + coefficient_rows({"1+log_c+n_lines+cn": ["intrcpt", "log_c", "n_lines", "cn"]}, 4))
def covariance_model(spark, folder):
    rows = effects.sample_log_ratio(b.sample_table(spark, folder).where("lcratio > 0"), site="site", treatment="treatment",
                                    control=b.CONTROL, value="lcratio", baseline={"lcratio": "control"})
    rows = rows.withColumns({"log_f": F.ln("lcratio"), "log_c": F.ln("control")})
    fits = regress.random_intercept(rows, [intercept_and("log_c", "n_lines", "cn")], response="log_f", group="site")
    return _rounded(regress.wald_table(fits).select("model", "term", "estimate", "se"), 4)


@query("additive_model", "L8")
def additive_model(spark, folder):
    fit = regress.additive(_lm_rows(spark, folder), "lrr", ["cn", "qty"],
                           parametric=Design([factor("treatment")], levels=LEVELS))
    return _rounded(regress.additive_summary(spark, fit))


@query("smooth_curve", "L8 L10")
def smooth_curve(spark, folder):
    fit = regress.additive(_lm_rows(spark, folder), "lrr", ["cn", "qty"])
    return _rounded(regress.smooth_curve(spark, fit, "cn"))


@query("regression_tree", "L9")
def regression_tree(spark, folder):
    return _rounded(regress.regression_tree(_lm_rows(spark, folder), "lrr", ["cn", "qty", "n_lines"]), 5)


@query("partial_effect", "L10 F15")
def partial_effect(spark, folder):
    df = _lm_rows(spark, folder)
    return _rounded(regress.partial_effect(df, regress.ols(df, "lrr", FULL), "cn", by="treatment"))


RESID = LM + """,
res AS (SELECT key AS sample, mean + b1 * r1 + b2 * r2 + b3 * r3 AS fitted,
               raw - (mean + b1 * r1 + b2 * r2 + b3 * r3) AS resid FROM o, ss)"""


@query("residual_rows", "L11", RESID + "SELECT sample, round(fitted, 5) AS fitted, round(resid, 5) AS resid FROM res")
def residual_rows(spark, folder):
    df = _lm_rows(spark, folder)
    return _rounded(regress.residuals(df, regress.ols(df, "lrr", QUADRATIC)).select("sample", "fitted", "resid").where("fitted IS NOT NULL"), 5)


@query("row_influence", "L11", LM + """,
iv AS (SELECT key AS sample, 1.0 / count(*) OVER () + r1 * r1 / sum(r1 * r1) OVER () + r2 * r2 / sum(r2 * r2) OVER ()
         + r3 * r3 / sum(r3 * r3) OVER () AS h, raw - (mean + b1 * r1 + b2 * r2 + b3 * r3) AS e,
         (tss - s1 - s2 - s3) / (n - 4) AS ms FROM o, ss)
SELECT sample, round(h, 6) AS leverage, round(e / sqrt(ms * (1 - h)), 5) AS standardised,
       round(e * e / ms * h / power(1 - h, 2) / 4, 6) AS cook FROM iv""")
def row_influence(spark, folder):
    df = _lm_rows(spark, folder)
    out = regress.influence(df, regress.ols(df, "lrr", QUADRATIC)).where("fitted IS NOT NULL")
    return out.select("sample", tidy("leverage").alias("leverage"), tidy("standardised", 5).alias("standardised"),
                      tidy("cook").alias("cook"))


@query("mixed_residuals", "L11 L6")
def mixed_residuals(spark, folder):
    df, model = _lm_rows(spark, folder), intercept_and("n_lines", "cn")
    fits = regress.random_intercept(df, [model], response="lrr", group="site")
    out = regress.mixed_residuals(df, fits, model, response="lrr", group="site")
    return _rounded(out.select("sample", "site", "fixed", "effect", "fitted", "resid"), 5)


@query("residual_quantiles", "L11", RESID + """,
k AS (SELECT sample, resid, row_number() OVER (ORDER BY resid, sample) AS rank, count(*) OVER () AS n FROM res),
q AS (SELECT sample, resid, rank, (rank - 0.5) / n AS p FROM k)
SELECT sample, round(resid, 5) AS value, rank, round(p, 6) AS prob, round(""" + normal_quantile("p") + ", 5) AS normal FROM q")
def residual_quantiles(spark, folder):
    df = _lm_rows(spark, folder)
    rows = regress.residuals(df, regress.ols(df, "lrr", QUADRATIC))
    return _rounded(_rounded(regress.quantile_pairs(rows, "resid", "sample"), 5, ["prob"]), 6, ["value", "normal"])


@query("correlation_test", "L12", LINE + """CAST(count(*) AS BIGINT) AS n, round(corr(qty, n_lines), 6) AS r,
  round(corr(qty, n_lines) * sqrt((count(*) - 2) / (1 - power(corr(qty, n_lines), 2))), 5) AS t,
  round(tanh(atanh(corr(qty, n_lines)) - 1.959963984540054 / sqrt(count(*) - 3)), 6) AS ci_lb,
  round(tanh(atanh(corr(qty, n_lines)) + 1.959963984540054 / sqrt(count(*) - 3)), 6) AS ci_ub,
  round(""" + t_tail("corr(qty, n_lines) * sqrt((count(*) - 2) / (1 - power(corr(qty, n_lines), 2)))", "count(*) - 2")
       + """, 6) AS p FROM covariates""")
def correlation_test(spark, folder):
    out = regress.correlation_test(b.covariates(spark, folder), "qty", "n_lines")
    return out.select("n", tidy("r").alias("r"), tidy("t", 5).alias("t"), tidy("ci_lb").alias("ci_lb"),
                      tidy("ci_ub").alias("ci_ub"), tidy("p").alias("p"))


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("correlation_matrix", "L13 M2", " UNION ALL ".join(
    f"SELECT '{x}' AS x, '{y}' AS y, round(corr({x}, {y}), 6) AS r FROM lineitem"
    for i, x in enumerate(_CORR) for y in _CORR[i + 1:]))
def correlation_matrix(spark, folder):
    return _rounded(regress.correlation_matrix(b.table(spark, folder, "lineitem"), _CORR))


@query("line_per_group", "L14", """
SELECT l_returnflag, l_linenumber, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept,
       round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, count(*) AS n FROM lineitem GROUP BY ALL""")
def line_per_group(spark, folder):
    out = regress.line_per_group(b.table(spark, folder, "lineitem"), ["l_returnflag", "l_linenumber"],
                                 "l_quantity", "l_extendedprice")
    return out.select("l_returnflag", "l_linenumber", tidy("slope", 3).alias("slope"),
                      tidy("intercept", 2).alias("intercept"), tidy("r2").alias("r2"), "n")


@query("box_cox_profile", "L15", """
WITH g AS (SELECT exp(avg(ln(o_totalprice))) AS g FROM orders),
z AS (SELECT o_orderpriority, i / 10.0 - 2 AS p,
  CASE WHEN i = 20 THEN ln(o_totalprice / g) ELSE (pow(o_totalprice / g, i / 10.0 - 2) - 1) / (i / 10.0 - 2) END AS t
  FROM orders, g, range(41) r(i)),
w AS (SELECT p, o_orderpriority, var_pop(t) * count(*) AS ss, count(*) AS n FROM z GROUP BY ALL)
SELECT round(p, 1)::DOUBLE AS power, round(-sum(n) / 2 * ln(sum(ss)), 3) AS loglik FROM w GROUP BY p""")
def box_cox_profile(spark, folder):
    df = b.table(spark, folder, "orders").select("o_orderpriority", "o_totalprice")
    out = regress.box_cox_profile(df, ["o_orderpriority"], "o_totalprice")
    return out.select(tidy("power", 1).alias("power"), tidy("loglik", 3).alias("loglik"))


BOX_COX = """
WITH g AS (SELECT exp(avg(ln(o_totalprice))) AS g FROM orders),
z AS (SELECT o_orderpriority, i / 10.0 - 2 AS p,
  CASE WHEN i = 20 THEN ln(o_totalprice / g) ELSE (pow(o_totalprice / g, i / 10.0 - 2) - 1) / (i / 10.0 - 2) END AS t
  FROM orders, g, range(41) r(i)),
w AS (SELECT p, o_orderpriority, var_pop(t) * count(*) AS ss, count(*) AS n FROM z GROUP BY ALL),
l AS (SELECT p, -sum(n) / 2 * ln(sum(ss)) AS loglik FROM w GROUP BY p),
best AS (SELECT arg_max(p, loglik) AS p FROM l)"""


@query("transformed_boxes", "L15 A14", BOX_COX + """,
tv AS (SELECT o_orderpriority, variant, value FROM orders, best, LATERAL (VALUES ('raw', o_totalprice),
  ('log', ln(o_totalprice)), ('sqrt', sqrt(o_totalprice)), ('power(1/3)', pow(o_totalprice, 1.0 / 3)),
  ('inverse', 1 / o_totalprice), ('Box Cox', pow(o_totalprice, p))) AS x(variant, value)),
q AS (SELECT variant, o_orderpriority, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
             quantile_cont(value, 0.75) AS q3 FROM tv GROUP BY ALL)
SELECT variant, o_orderpriority, round(q1, 5) AS q1, round(median, 5) AS median, round(q3, 5) AS q3, count(*) AS n,
  count(*) FILTER (value NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM tv JOIN q USING (variant, o_orderpriority) GROUP BY ALL""")
def transformed_boxes(spark, folder):
    df = b.table(spark, folder, "orders").select("o_orderpriority", "o_totalprice")
    best = regress.best_power(regress.box_cox_profile(df, ["o_orderpriority"], "o_totalprice")).first()["power"]
    long = regress.transformed_variants(df, "o_totalprice", best, keep=["o_orderpriority"])
    out = aggregate.box_statistics(long, ["variant", "o_orderpriority"], "value")
    return _rounded(out.drop("lower_whisker", "upper_whisker"), 5)
