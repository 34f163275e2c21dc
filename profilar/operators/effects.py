"""Effect sizes between treated cells and their site's control."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilar.functions.nulls import col_of, ratio
from profilar.functions.scalar import log_ratio
from profilar.operators.aggregate import summarise
from profilar.operators.joins import control_baseline, match
from profilar.operators.ordered import quantile_bin, sequence_in_group
from profilar.operators.shares import equal_weight, min_max
from profilar.session import save_and_reload

NORMAL_95 = 1.96


def cell_statistics(df: DataFrame, cell: Sequence[str], value: str, *, log_scale: bool = False,
                    na: str = "propagate") -> DataFrame:
    """M, N and SD of one value per cell; ``log_scale`` takes them of the logarithm."""
    source = df.withColumn(value, F.ln(value)) if log_scale else df
    return summarise(source, cell, [value], ["M", "N", "SD"], na)


def pair_with_control(cells: DataFrame, *, site: str = "site", treatment: str = "treatment",
                      control: str) -> DataFrame:
    """Treated cells as f_M, f_N, f_SD beside the control's c_M, c_N, c_SD."""
    treated = control_baseline(cells, by=[site], treatment=treatment, control=control,
                               values={"M": "c_M", "N": "c_N", "SD": "c_SD"})
    return treated.withColumnsRenamed({"M": "f_M", "N": "f_N", "SD": "f_SD"})


def mean_difference(m1, m2) -> Column:
    return col_of(m1) - col_of(m2)


def mean_difference_variance(sd1, n1, sd2, n2) -> Column:
    return ratio(col_of(sd1) ** 2, n1) + ratio(col_of(sd2) ** 2, n2)


def log_ratio_variance(m1, sd1, n1, m2, sd2, n2) -> Column:
    return (ratio(col_of(sd1) ** 2, col_of(n1) * col_of(m1) ** 2)
            + ratio(col_of(sd2) ** 2, col_of(n2) * col_of(m2) ** 2))


def effect_size(paired: DataFrame, measure: str) -> DataFrame:
    """Add yi and vi. ``ROM``: log ratio of means; ``MD``: difference of means."""
    if measure == "ROM":
        yi = log_ratio("f_M", "c_M")
        vi = log_ratio_variance("f_M", "f_SD", "f_N", "c_M", "c_SD", "c_N")
    elif measure == "MD":
        yi = mean_difference("f_M", "c_M")
        vi = mean_difference_variance("f_SD", "f_N", "c_SD", "c_N")
    else:
        raise ValueError("measure must be 'ROM' or 'MD'")
    return paired.withColumns({"yi": yi, "vi": vi})


def with_limits(effects: DataFrame) -> DataFrame:
    half = F.lit(NORMAL_95) * F.sqrt("vi")
    return effects.withColumns({
        "lci": F.col("yi") - half,
        "uci": F.col("yi") + half,
        "wi": ratio(F.lit(1.0), F.sqrt("vi")),
    })


def effect_table(paired: DataFrame, covariates: DataFrame, *, measure: str, key: str = "trt_id",
                 site: str = "site", bins: Mapping[str, tuple[str, int]] | None = None) -> DataFrame:
    """Effect sizes with covariates, limits, plot size, bins, site weight and a row number.

    ``bins`` maps an output to (covariate, number of equal-frequency bins).
    """
    # One row per cell from here on: store it once, for the passes over it that follow.
    table = save_and_reload(match(effect_size(paired, measure), covariates, [key], "left"), "effects")
    for out, (column, n) in (bins or {}).items():
        table = quantile_bin(table, column, n, out)
    table = sequence_in_group(table, [], [key], out="sdn")
    table = min_max(with_limits(table), "wi", "size")
    return equal_weight(table, [site], "wi2")


def sample_log_ratio(df: DataFrame, *, site: str, treatment: str, control: str, value: str,
                     baseline: Mapping[str, str]) -> DataFrame:
    """Log ratio of each treated sample to its site's mean control value.

    ``baseline`` maps columns averaged over control samples to their names.
    """
    means = (
        df.where(F.col(treatment) == control)
        .groupBy(site)
        .agg(*[F.avg(c).alias(out) for c, out in baseline.items()])
    )
    treated = match(df.where(F.col(treatment) != control), means, [site], "left")
    return treated.withColumn("lrr", log_ratio(value, baseline[value]))


def cell_log_ratio(df: DataFrame, *, keys: Sequence[str], value: str, baseline: str,
                   means: Sequence[str] = ()) -> DataFrame:
    """Average the replicates of a cell, then take the log ratio."""
    cells = df.groupBy(*keys, baseline).agg(F.avg(value).alias(value), *[F.avg(c).alias(c) for c in means])
    return cells.withColumn("lrr", log_ratio(value, baseline))
