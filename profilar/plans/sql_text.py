"""SQL texts for comparison that are long enough to be put together from parts."""

from __future__ import annotations

from collections.abc import Sequence

from profilar.functions.distributions import _A, _B, _C, _D, _TAIL


def orthogonal_steps(source: str, y: str, xs: Sequence[str], key: str | None = None) -> str:
    """CTEs that regress ``y`` on columns one after the other.

    Each column is cleared of the earlier ones (Gram-Schmidt), so its sum of
    squares is the sequential one. Gives CTE ``o`` with columns y, r1, r2 …
    (cleared columns) and CTE ``ss`` with n, tss, b1 … and s1 ….
    """
    keep = f"{key} AS key, " if key else ""
    first = ", ".join(f"{x} - avg({x}) OVER () AS c{i}" for i, x in enumerate(xs, 1))
    out = [f"o0 AS (SELECT {keep}{y} AS raw, avg({y}) OVER () AS mean, {y} - avg({y}) OVER () AS y, {first} FROM {source})"]
    columns = [f"c{i}" for i in range(1, len(xs) + 1)]
    for i in range(1, len(xs) + 1):
        rest = []
        for j in range(i + 1, len(xs) + 1):
            rest.append(f"c{j} - c{i} * (sum(c{j} * c{i}) OVER ()) / (sum(c{i} * c{i}) OVER ()) AS c{j}")
        done = ", ".join([*(["key"] if key else []), "raw", "mean", "y", *[f"r{k}" for k in range(1, i)], f"c{i} AS r{i}", *rest])
        out.append(f"o{i} AS (SELECT {done} FROM o{i - 1})")
    k = len(xs)
    sums = ", ".join(f"sum(r{i} * y) / sum(r{i} * r{i}) AS b{i}, power(sum(r{i} * y), 2) / sum(r{i} * r{i}) AS s{i}"
                     for i in range(1, k + 1))
    out.append(f"o AS (SELECT * FROM o{k})")
    out.append(f"ss AS (SELECT count(*) AS n, sum(y * y) AS tss, {sums} FROM o)")
    return ",\n".join(out)


def normal_quantile(p: str) -> str:
    """The published rational approximation as SQL text."""
    def poly(coefficients, x):
        text = repr(coefficients[0])
        for c in coefficients[1:]:
            text = f"({text} * {x} + ({c!r}))"
        return text

    r, low, high = f"(({p} - 0.5) * ({p} - 0.5))", f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    return (f"CASE WHEN {p} < {_TAIL} THEN {poly(_C, low)} / {poly(_D, low)} "
            f"WHEN {p} > {1 - _TAIL} THEN -({poly(_C, high)}) / {poly(_D, high)} "
            f"ELSE ({p} - 0.5) * {poly(_A, r)} / {poly(_B, r)} END")


def variance_search(source: str, random: str, by: str = "'all'", rounds: int = 6, points: int = 40) -> str:
    """CTEs that maximise the restricted likelihood of an intercept-only model over one variance.

    An even number of points keeps the middle of a refined grid off the best
    point so far, which stays in the grid itself.

    ``source`` has yi, vi and site. Gives CTE ``reml``: key, s (the variance),
    a (inverse variance of the mean), estimate, ll, n.
    """
    text = [f"e AS (SELECT {by} AS key, site, yi, vi FROM {source} WHERE vi > 0 AND yi IS NOT NULL)"]
    text.append("n AS (SELECT key, count(*) AS n, avg(vi) AS unit FROM e GROUP BY 1)")
    if random == "group":
        text.append("g AS (SELECT key, site, sum(1 / vi) AS w, sum(yi / vi) AS wy, sum(yi * yi / vi) AS wyy, "
                    "sum(ln(vi)) AS lnv FROM e GROUP BY ALL)")
        sums = ("sum(w - s / (1 + s * w) * w * w) AS a, sum(wy - s / (1 + s * w) * w * wy) AS c, "
                "sum(wyy - s / (1 + s * w) * wy * wy) AS q, sum(lnv + ln(1 + s * w)) AS d")
        base = "g"
    else:
        sums = ("sum(1 / (vi + s)) AS a, sum(yi / (vi + s)) AS c, sum(yi * yi / (vi + s)) AS q, "
                "sum(ln(vi + s)) AS d")
        base = "e"
    text.append("grid0 AS (SELECT key, 0.0::DOUBLE AS s FROM n UNION ALL "
                f"SELECT key, unit * exp(-14 + 25.0 * i / {points - 1}) FROM n, range({points}) t(i))")
    for r in range(rounds + 1):
        text.append(f"sum{r} AS (SELECT key, s, {sums} FROM {base} JOIN grid{r} USING (key) GROUP BY ALL)")
        text.append(f"ll{r} AS (SELECT key, s, a, c / a AS estimate, n, -0.5 * ((n - 1) * ln(2 * pi()) + d + q - c * c / a) "
                    f"+ 0.5 * ln(n) - 0.5 * ln(a) AS ll FROM sum{r} JOIN n USING (key))")
        # A single effect has a flat likelihood: its extra variance is zero by definition.
        text.append(f"top{r} AS (SELECT key, CASE WHEN any_value(n) = 1 THEN 0 ELSE arg_max(s, ll) END AS best "
                    f"FROM ll{r} GROUP BY 1)")
        if r < rounds:
            text.append(
                f"span{r} AS (SELECT key, any_value(best) AS best, coalesce(max(s) FILTER (s < best), any_value(best)) AS lo, "
                f"coalesce(min(s) FILTER (s > best), any_value(best)) AS hi FROM ll{r} JOIN top{r} USING (key) GROUP BY 1)")
            text.append(
                f"grid{r + 1} AS (SELECT key, best AS s FROM span{r} UNION "
                f"SELECT key, CASE WHEN lo > 0 THEN lo * pow(hi / lo, i / {points - 1}.0) ELSE lo + (hi - lo) * i / {points - 1}.0 END "
                f"FROM span{r}, range({points}) t(i))")
    text.append(f"reml AS (SELECT key, s, a, estimate, ll, n FROM ll{rounds} JOIN top{rounds} USING (key) WHERE s = best)")
    return ",\n".join(text)


def _cell(i: int, j: int) -> str:
    return f"m{min(i, j)}{max(i, j)}"


def _upper(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def covariance(name: str, source: str, columns: Sequence[str], key: str | None = None) -> str:
    """CTE with the upper triangle of a covariance matrix, per key if one is given."""
    cells = ", ".join(f"covar_samp({columns[i]}, {columns[j]}) AS {_cell(i, j)}" for i, j in _upper(len(columns)))
    lead, tail = (f"{key} AS key, ", f" GROUP BY {key}") if key else ("0 AS key, ", "")
    return f"{name} AS (SELECT {lead}{cells} FROM {source}{tail})"


def eigenpairs(prefix: str, matrix: str, k: int, count: int, steps: int = 40) -> str:
    """CTEs ``{prefix}1`` …: greatest eigenpairs by repeated squaring, each removed before the next.

    Columns key, value, v1 … vk; the greatest entry of a vector is positive. Needs WITH RECURSIVE.
    """
    pairs = _upper(k)
    names = ", ".join(_cell(i, j) for i, j in pairs)
    trace = " + ".join(_cell(i, i) for i in range(k))
    squared = ", ".join(
        "(" + " + ".join(f"{_cell(i, t)} * {_cell(t, j)}" for t in range(k)) + f") / power({trace}, 2) AS {_cell(i, j)}"
        for i, j in pairs)
    diag = f"greatest({', '.join(_cell(i, i) for i in range(k))})"
    # The limit is v v' up to scale: take the row of its greatest diagonal entry.
    entries = ", ".join(
        "CASE " + " ".join(f"WHEN {_cell(i, i)} = {diag} THEN {_cell(i, j)}" for i in range(k))
        + f" END / sqrt({diag} * ({trace})) AS v{j + 1}" for j in range(k))
    vs = ", ".join(f"v{i + 1}" for i in range(k))
    value = " + ".join(f"{'2 * ' if i != j else ''}v{i + 1} * v{j + 1} * {_cell(i, j)}" for i, j in pairs)
    out, current = [], matrix
    for r in range(1, count + 1):
        out.append(f"{prefix}p{r} AS (SELECT 0 AS step, key, {names} FROM {current} UNION ALL "
                   f"SELECT step + 1, key, {squared} FROM {prefix}p{r} WHERE step < {steps})")
        out.append(f"{prefix}v{r} AS (SELECT key, {entries} FROM {prefix}p{r} WHERE step = {steps})")
        out.append(f"{prefix}{r} AS (SELECT key, {value} AS value, {vs} FROM {prefix}v{r} JOIN {current} USING (key))")
        if r < count:
            left = ", ".join(f"{_cell(i, j)} - value * v{i + 1} * v{j + 1} AS {_cell(i, j)}" for i, j in pairs)
            out.append(f"{prefix}d{r} AS (SELECT key, {left} FROM {current} JOIN {prefix}{r} USING (key))")
            current = f"{prefix}d{r}"
    return ",\n".join(out)


def multi_fit(source: str, key: str, ys: Sequence[str], xs: Sequence[str], within: str | None) -> str:
    """CTEs that regress several responses on several covariates, all centred within ``within``.

    CTE ``mf``: key, w_{y} centred responses, c_{x} centred covariates, r1 … cleared covariates,
    f_{y} fitted and e_{y} residual responses.
    """
    over = f"OVER (PARTITION BY {within})" if within else "OVER ()"
    cols = ", ".join([f"{y} - avg({y}) {over} AS w_{y}" for y in ys] + [f"{x} - avg({x}) {over} AS c_{x}" for x in xs]
                     + [f"{x} - avg({x}) OVER () AS g_{x}" for x in xs])
    out = [f"mf0 AS (SELECT {key} AS key, {cols} FROM {source})"]
    for i, x in enumerate(xs, 1):
        cleared = f"c_{x}" + "".join(
            f" - r{j} * (sum(c_{x} * r{j}) OVER ()) / (sum(r{j} * r{j}) OVER ())" for j in range(1, i))
        out.append(f"mf{i} AS (SELECT *, {cleared} AS r{i} FROM mf{i - 1})")
    k = len(xs)
    fits = {y: " + ".join(f"r{i} * (sum(r{i} * w_{y}) OVER ()) / (sum(r{i} * r{i}) OVER ())" for i in range(1, k + 1)) for y in ys}
    out.append("mf AS (SELECT *, " + ", ".join(f"{f} AS f_{y}, w_{y} - ({f}) AS e_{y}" for y, f in fits.items()) + f" FROM mf{k})")
    return ",\n".join(out)


def sweep(prefix: str, source: str, p: int, carry: Sequence[str]) -> str:
    """CTE ``{prefix}``: least squares from cross products by sweeping one pivot after the other.

    ``source`` has a{i}_{j} (i ≤ j), c{i} and q. Result: b{i}, inverse entries
    v{i}_{j}, rss and lndet. All-zero columns are passed over.
    """
    def z(i: int, j: int) -> str:
        return f"z{min(i, j)}_{max(i, j)}"

    places = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    keep = ", ".join(carry)
    first = [f"a{i}_{j}" if j < p else (f"c{i}" if i < p else "q") for i, j in places]
    out = [f"{prefix}_0 AS (SELECT {keep}, 0.0::DOUBLE AS lndet, "
           + ", ".join(f"{f} AS {z(i, j)}" for f, (i, j) in zip(first, places)) + f" FROM {source})"]
    for k in range(p):
        ok = f"{z(k, k)} > 0"
        cells = []
        for i, j in places:
            if i == k and j == k:
                e = f"CASE WHEN {ok} THEN -1 / {z(k, k)} ELSE 0 END"
            elif k in (i, j):
                e = f"CASE WHEN {ok} THEN {z(i, j)} / {z(k, k)} ELSE 0 END"
            else:
                e = f"CASE WHEN {ok} THEN {z(i, j)} - {z(i, k)} * {z(k, j)} / {z(k, k)} ELSE {z(i, j)} END"
            cells.append(f"{e} AS {z(i, j)}")
        out.append(f"{prefix}_{k + 1} AS (SELECT {keep}, lndet + CASE WHEN {ok} THEN ln({z(k, k)}) ELSE 0 END AS lndet, "
                   + ", ".join(cells) + f" FROM {prefix}_{k})")
    result = [f"{z(i, p)} AS b{i}" for i in range(p)]
    result += [f"-{z(i, j)} AS v{i}_{j}" for i in range(p) for j in range(i, p)]
    out.append(f"{prefix} AS MATERIALIZED (SELECT {keep}, lndet, {z(p, p)} AS rss, {', '.join(result)} FROM {prefix}_{p})")
    return ",\n".join(out)


def cross_products(name: str, source: str, p: int, y: str, key: str = "key", w: str = "1.0") -> str:
    """CTE of the cross products :func:`sweep` reads, per key."""
    cells = [f"sum({w} * x{i} * x{j}) AS a{i}_{j}" for i in range(p) for j in range(i, p)]
    cells += [f"sum({w} * x{i} * {y}) AS c{i}" for i in range(p)] + [f"sum({w} * {y} * {y}) AS q"]
    return f"{name} AS (SELECT {key}, count(*) AS n, {', '.join(cells)} FROM {source} GROUP BY {key})"


def restricted_search(source: str, p: int, rounds: int = 6, points: int = 40, estimated: bool = False) -> str:
    """CTE ``fit``: random intercept per site, several coefficients, by restricted likelihood.

    ``source`` has key, site, yi, vi, x0 … and p (coefficients in use; the
    others are zero columns). With ``estimated`` vi is ignored and a common
    error variance is profiled out. Result: key, n, p, s, ll, b{i}, v{i}_{j}, rss, scale.
    """
    v = "1.0" if estimated else "vi"
    text = [cross_products("xx", source, p, "yi")]
    text.append(sweep("xs", "xx", p, ["key"]))
    text.append(f"nn AS MATERIALIZED (SELECT key, any_value(p) AS p, count(*)::DOUBLE AS n, avg({v}) AS unit FROM {source} GROUP BY 1)")
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    cells = [f"sum(1 / {v}) AS w", f"sum(yi / {v}) AS wy", f"sum(yi * yi / {v}) AS wyy", f"sum(ln({v})) AS lnv"]
    cells += [f"sum(x{i} / {v}) AS wx{i}" for i in range(p)] + [f"sum(x{i} * yi / {v}) AS wxy{i}" for i in range(p)]
    cells += [f"sum(x{i} * x{j} / {v}) AS wxx{i}_{j}" for i, j in pairs]
    text.append(f"gs AS MATERIALIZED (SELECT key, site, {', '.join(cells)} FROM {source} GROUP BY ALL)")
    g = "s / (1 + s * w)"
    sums = [f"sum(wxx{i}_{j} - {g} * wx{i} * wx{j}) AS a{i}_{j}" for i, j in pairs]
    sums += [f"sum(wxy{i} - {g} * wx{i} * wy) AS c{i}" for i in range(p)]
    sums += [f"sum(wyy - {g} * wy * wy) AS q", "sum(lnv + ln(1 + s * w)) AS d"]
    text.append("gr0 AS MATERIALIZED (SELECT key, 0.0::DOUBLE AS s FROM nn UNION ALL "
                f"SELECT key, unit * exp(-14 + 25.0 * i / {points - 1}) FROM nn, range({points}) t(i))")
    for r in range(rounds + 1):
        text.append(f"su{r} AS MATERIALIZED (SELECT key, s, {', '.join(sums)} FROM gs JOIN gr{r} USING (key) GROUP BY ALL)")
        text.append(sweep(f"sw{r}", f"su{r}", p, ["key", "s", "d"]))
        if estimated:
            ll = "-0.5 * ((n - p) * (ln(2 * pi() * f.rss / (n - p)) + 1) + d + f.lndet)"
            scale = "f.rss / (n - p)"
        else:
            ll = "-0.5 * ((n - p) * ln(2 * pi()) + d + f.rss) + 0.5 * xs.lndet - 0.5 * f.lndet"
            scale = "1.0"
        text.append(f"li{r} AS MATERIALIZED (SELECT f.*, nn.n, p, {ll} AS ll, {scale} AS scale FROM sw{r} f "
                    f"JOIN nn USING (key) JOIN xs USING (key))")
        text.append(f"to{r} AS MATERIALIZED (SELECT key, CASE WHEN any_value(n) <= any_value(p) THEN 0 "
                    f"ELSE arg_max(s, ll) END AS best FROM li{r} GROUP BY 1)")
        if r < rounds:
            text.append(
                f"sp{r} AS (SELECT key, any_value(best) AS best, coalesce(max(s) FILTER (s < best), any_value(best)) AS lo, "
                f"coalesce(min(s) FILTER (s > best), any_value(best)) AS hi FROM li{r} JOIN to{r} USING (key) GROUP BY 1)")
            text.append(
                f"gr{r + 1} AS MATERIALIZED (SELECT key, best AS s FROM sp{r} UNION "
                f"SELECT key, CASE WHEN lo > 0 THEN lo * pow(hi / lo, i / {points - 1}.0) ELSE lo + (hi - lo) * i / {points - 1}.0 END "
                f"FROM sp{r}, range({points}) t(i))")
    text.append(f"fit AS (SELECT li.* FROM li{rounds} li JOIN to{rounds} USING (key) WHERE s = best)")
    return ",\n".join(text)


def stacked_models(models: dict[str, tuple[str, Sequence[str], str]], width: int, y: str, v: str) -> str:
    """UNION ALL of one SELECT per model: name → (source, column expressions, row filter)."""
    parts = []
    for name, (source, columns, where) in models.items():
        xs = [*columns, *["0.0"] * (width - len(columns))]
        present = " AND ".join(f"({c}) IS NOT NULL" for c in columns)
        parts.append(f"SELECT '{name}' AS key, {len(columns)} AS p, site, {y} AS yi, {v} AS vi, "
                     + ", ".join(f"({x})::DOUBLE AS x{i}" for i, x in enumerate(xs))
                     + f" FROM {source} WHERE {y} IS NOT NULL AND {v} > 0 AND {present} AND ({where})")
    return "\nUNION ALL ".join(parts)


def coefficient_rows(names: dict[str, Sequence[str]], digits: int = 5) -> str:
    """SELECT model, term, estimate and se from CTE ``fit``."""
    parts = []
    for key, terms in names.items():
        for i, t in enumerate(terms):
            parts.append(f"SELECT '{key}' AS model, '{t}' AS term, round(b{i}, {digits}) AS estimate, "
                         f"round(sqrt(v{i}_{i} * scale), {digits}) AS se FROM fit WHERE key = '{key}'")
    return "\nUNION ALL ".join(parts)


def nested_search(source: str, p: int, rounds: int = 8, points: int = 12) -> str:
    """As :func:`restricted_search` with a second variance ``t`` on every row. Result CTE ``fit``."""
    text = [cross_products("xx", source, p, "yi"), sweep("xs", "xx", p, ["key"])]
    text.append(f"nn AS MATERIALIZED (SELECT key, any_value(p) AS p, count(*)::DOUBLE AS n, avg(vi) AS unit FROM {source} GROUP BY 1)")
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    w = "1 / (vi + t)"
    cells = [f"sum({w}) AS w", f"sum({w} * yi) AS wy", f"sum({w} * yi * yi) AS wyy", "sum(ln(vi + t)) AS lnv"]
    cells += [f"sum({w} * x{i}) AS wx{i}" for i in range(p)] + [f"sum({w} * x{i} * yi) AS wxy{i}" for i in range(p)]
    cells += [f"sum({w} * x{i} * x{j}) AS wxx{i}_{j}" for i, j in pairs]
    g = "s / (1 + s * w)"
    sums = [f"sum(wxx{i}_{j} - {g} * wx{i} * wx{j}) AS a{i}_{j}" for i, j in pairs]
    sums += [f"sum(wxy{i} - {g} * wx{i} * wy) AS c{i}" for i in range(p)]
    sums += [f"sum(wyy - {g} * wy * wy) AS q", "sum(lnv + ln(1 + s * w)) AS d"]
    text.append("ax0 AS (SELECT key, 0.0::DOUBLE AS x FROM nn UNION ALL "
                f"SELECT key, unit * exp(-14 + 25.0 * i / {points - 1}) FROM nn, range({points}) r(i))")
    text.append("gr0 AS MATERIALIZED (SELECT a.key, a.x AS t, b.x AS s FROM ax0 a JOIN ax0 b USING (key))")
    for r in range(rounds + 1):
        text.append(f"gs{r} AS MATERIALIZED (SELECT key, site, t, {', '.join(cells)} FROM {source} "
                    f"JOIN (SELECT DISTINCT key, t FROM gr{r}) USING (key) GROUP BY key, site, t)")
        text.append(f"su{r} AS MATERIALIZED (SELECT key, t, s, {', '.join(sums)} FROM gs{r} JOIN gr{r} USING (key, t) GROUP BY key, t, s)")
        text.append(sweep(f"sw{r}", f"su{r}", p, ["key", "t", "s", "d"]))
        text.append(f"li{r} AS MATERIALIZED (SELECT f.*, nn.n, p, 1.0 AS scale, -0.5 * ((n - p) * ln(2 * pi()) + d + f.rss) "
                    f"+ 0.5 * xs.lndet - 0.5 * f.lndet AS ll FROM sw{r} f JOIN nn USING (key) JOIN xs USING (key))")
        text.append(f"to{r} AS MATERIALIZED (SELECT key, arg_max(t, ll) AS bt, arg_max(s, ll) AS bs FROM li{r} GROUP BY 1)")
        if r < rounds:
            for x, best in (("t", "bt"), ("s", "bs")):
                text.append(
                    f"n{x}{r} AS (SELECT key, any_value({best}) AS best, max({x}) FILTER ({x} < {best}) AS prev, "
                    f"min({x}) FILTER ({x} > {best}) AS next FROM li{r} JOIN to{r} USING (key) GROUP BY 1)")
                text.append(
                    f"b{x}{r} AS (SELECT key, best, coalesce(prev, CASE WHEN best > 0 THEN best * best / next ELSE 0 END) AS lo, "
                    f"coalesce(next, CASE WHEN prev > 0 THEN best * best / prev ELSE 2 * best END) AS hi FROM n{x}{r})")
                text.append(
                    f"v{x}{r} AS (SELECT key, best AS {x} FROM b{x}{r} UNION SELECT key, CASE WHEN lo > 0 "
                    f"THEN lo * pow(hi / lo, i / {points - 1}.0) ELSE lo + (hi - lo) * i / {points - 1}.0 END "
                    f"FROM b{x}{r}, range({points}) r(i))")
            text.append(f"gr{r + 1} AS MATERIALIZED (SELECT key, t, s FROM vt{r} JOIN vs{r} USING (key))")
    text.append(f"fit AS (SELECT li.* FROM li{rounds} li JOIN to{rounds} USING (key) WHERE t = bt AND s = bs)")
    return ",\n".join(text)


_SIMPSON = "CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"


def _simpson(integrand: str, width: str) -> str:
    """Integral over [0, width] of an expression in ``u``, in 2,000 steps."""
    step = f"(({width}) / 2000.0)"
    body = integrand.replace("<u>", f"({step} * i)")
    return f"(list_sum(list_transform(range(2001), lambda i: ({_SIMPSON}) * {body})) * {step} / 3)"


def f_tail(f: str, df1: str, df2: str) -> str:
    """P(F > f): an incomplete beta integral over the angle whose squared sine is df2 / (df2 + df1 f)."""
    body = f"pow(sin(<u>), ({df2}) - 1) * pow(cos(<u>), ({df1}) - 1)"
    angle = f"asin(sqrt(({df2}) / (({df2}) + ({df1}) * ({f}))))"
    return f"({_simpson(body, angle)} / {_simpson(body, 'pi() / 2')})"


def t_tail(t: str, df: str) -> str:
    """P(|T| > |t|)."""
    return f_tail(f"({t}) * ({t})", "1", df)


def chi2_tail(x: str, df: str) -> str:
    """P(X > x): the density of the square root, from there on."""
    above = f"pow(sqrt({x}) + <u>, ({df}) - 1) * exp(-pow(sqrt({x}) + <u>, 2) / 2)"
    whole = f"pow(<u>, ({df}) - 1) * exp(-pow(<u>, 2) / 2)"
    return f"({_simpson(above, f'sqrt({df}) + 14')} / {_simpson(whole, f'sqrt({df}) + 14')})"


def z_tail(z: str) -> str:
    """P(|Z| > |z|)."""
    return chi2_tail(f"({z}) * ({z})", "1")


def rising_pools(source: str, x: str, y: str) -> str:
    """CTE ``pools`` (w, s): pools of the rising fit of ``y`` on ``x``, the pieces of the convex minorant of running sums.

    A piece is split at the point farthest below its chord until none lies below. Needs WITH RECURSIVE.
    """
    return f"""
rp_levels AS (SELECT {x} AS x, count(*)::DOUBLE AS w, sum({y}) AS s FROM {source} GROUP BY 1),
rp_points AS MATERIALIZED (SELECT row_number() OVER o AS k, sum(w) OVER o AS w, sum(s) OVER o AS s FROM rp_levels
              WINDOW o AS (ORDER BY x) UNION ALL SELECT 0, 0, 0),
rp_ends AS (SELECT max(k) AS n, max(w) AS w, max_by(s, k) AS s FROM rp_points),
rp_cut AS (
  SELECT 0::BIGINT AS i, 0::DOUBLE AS iw, 0::DOUBLE AS is_, n AS j, w AS jw, s AS js, false AS final FROM rp_ends
  UNION ALL
  SELECT unnest(CASE WHEN k IS NULL THEN [struct_pack(i := i, iw := iw, is_ := is_, j := j, jw := jw, js := js, final := true)]
                ELSE [struct_pack(i := i, iw := iw, is_ := is_, j := k.k, jw := k.w, js := k.s, final := false),
                      struct_pack(i := k.k, iw := k.w, is_ := k.s, j := j, jw := jw, js := js, final := false)] END, recursive := true)
  FROM (SELECT i, iw, is_, j, jw, js, arg_min(struct_pack(k := p.k, w := p.w, s := p.s),
                 p.s - is_ - (js - is_) * (p.w - iw) / (jw - iw))
                 FILTER (p.s - is_ - (js - is_) * (p.w - iw) / (jw - iw) < -1e-9) AS k
        FROM rp_cut LEFT JOIN rp_points p ON p.k > i AND p.k < j WHERE NOT final GROUP BY ALL)),
pools AS (SELECT jw - iw AS w, js - is_ AS s FROM rp_cut WHERE final)"""
