"""Profile preparation: from a long spectrum to one row of group shares per sample."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilar.functions.nulls import not_in, ratio, summary
from profilar.functions.scalar import dashes_to_underscores, normalise_id, roll_up
from profilar.operators import reshape
from profilar.operators.joins import annotate
from profilar.operators.shares import row_shares, share_of_total

# Group labels of the compound lists.
BY_PRODUCTS = ("CO2", "sulfur_comp", "unk")
ROLL_UP = {
    "Long_chain_aliphatic": ("n-diketone", "n-ketone", "n-alkane", "n-alkene", "n-alkanal", "n-FA"),
    "Others": ("chlorophyll", "steroid", "vitamin"),
}


def spectrum_to_long(wide: DataFrame, *, prefix: str, ids: Sequence[str] = ("site", "Window")) -> DataFrame:
    """One row per window and sample column."""
    return reshape.to_long(wide, ids, reshape.starting_with(wide, prefix))


def group_totals(fact: DataFrame, annotation: DataFrame, *, site: str = "site", window: str = "window",
                 sample: str = "variable", group: str = "grp", value: str = "value",
                 id_pattern: str | None = "X|_.", id_name: str = "fileid") -> DataFrame:
    """Annotate windows and sum values per (site, sample, group); unannotated windows form a NULL group."""
    joined = annotate(fact, annotation.select(site, window, group), [site, window])
    totals = joined.groupBy(site, sample, group).agg(summary(F.sum, value).alias(value))
    if id_pattern is None:
        return totals
    return totals.withColumn(id_name, normalise_id(sample, id_pattern))


def shares_long(totals: DataFrame, *, ids: Sequence[str], group: str = "grp", value: str = "value",
                drop: Sequence[str] = BY_PRODUCTS, classes: Mapping[str, Sequence[str]] = ROLL_UP) -> DataFrame:
    """Drop by-products, roll labels up, take shares within the sample, sum per class."""
    kept = totals.where(not_in(group, drop)).withColumn(
        group, dashes_to_underscores(roll_up(group, classes))
    )
    merged = kept.groupBy(*ids, group).agg(summary(F.sum, value).alias(value))
    return share_of_total(merged, ids, value).select(*ids, group, "prop")


def shares_wide(shares: DataFrame, *, ids: Sequence[str], groups: Sequence[str], group: str = "grp",
                fill: float | None = 0.0) -> DataFrame:
    return reshape.to_wide(shares, ids, group, "prop", groups, fill=fill, agg=F.sum)


def append_ready_made(shares: DataFrame, extra: DataFrame, groups: Sequence[str],
                      renormalise: bool = False) -> DataFrame:
    """Add rows that already hold shares; ``renormalise`` re-divides each by its own total."""
    rows = row_shares(extra, groups) if renormalise else extra
    return shares.unionByName(rows, allowMissingColumns=True)


def profile_table(df: DataFrame, *, ids: Sequence[str], groups: Sequence[str], group: str = "grp",
                  value: str = "value", drop: Sequence[str] = BY_PRODUCTS,
                  classes: Mapping[str, Sequence[str]] = ROLL_UP, missing: str | None = None,
                  other: str | None = None, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Drop, roll up, share and widen in one aggregation.

    Conditional sums per group and one total share a single shuffle, summed
    map-side first. ``missing`` names a column for the share of the NULL group,
    ``other`` one for the share of groups not listed: with both, shares sum to 1.
    ``extra`` adds aggregates over all rows, by-products included, to the same pass.
    """
    kept = not_in(group, drop)
    if not extra:
        df = df.where(kept)
    rows = df.withColumns({"__kept": kept, group: dashes_to_underscores(roll_up(group, classes))})
    sums = {g: F.col(group) == F.lit(g) for g in groups}
    if missing:
        sums[missing] = F.col(group).isNull()
    if other:
        sums[other] = F.col(group).isNotNull() & ~F.col(group).isin(list(groups))
    total = F.when(F.col("__kept"), F.col(value))
    wide = rows.groupBy(*ids).agg(
        *[F.coalesce(F.sum(F.when(F.col("__kept") & test, F.col(value))), F.lit(0.0)).alias(g)
          for g, test in sums.items()],
        F.when(F.count(total) == F.count(F.when(F.col("__kept"), 1)), F.sum(total)).alias("__total"),
        F.count(F.when(F.col("__kept"), 1)).alias("__rows"),
        *[e.alias(name) for name, e in (extra or {}).items()])
    return wide.where("__rows > 0").select(*ids, *[ratio(g, "__total").alias(g) for g in sums], *(extra or {}))


def across_samples(df: DataFrame, *, component: str, sample: str, value: str) -> DataFrame:
    """Transform raw spectra by component: each value over its component's total across samples, then
    the square root of the share within the sample. Long in, long out (component, sample, area, h)."""
    sums = df.groupBy(component, sample).agg(summary(F.sum, value).alias(value))
    area = share_of_total(sums, [component], value, "area")
    within = share_of_total(area, [sample], "area", "__prop")
    return within.select(component, sample, "area", F.sqrt("__prop").alias("h"))
