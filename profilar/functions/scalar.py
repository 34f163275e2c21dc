"""Row functions. All are built-in column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from profilar.functions.nulls import col_of, is_in, ratio

MAX_INLINE_MAP = 200


def normalise_id(c: str | Column, pattern: str) -> Column:
    """Strip a pattern, read the rest as a number, write it without leading zeros.

    Text that is not a number after stripping becomes NULL.
    """
    stripped = F.regexp_replace(col_of(c), pattern, "")
    return stripped.try_cast("bigint").cast("string")


def to_number(c: str | Column) -> Column:
    return col_of(c).try_cast("double")


def dashes_to_underscores(c: str | Column) -> Column:
    return F.translate(col_of(c), "-", "_")


def name_part(c: str | Column, position: int, pattern: str = "_|[.]") -> Column:
    """One-based piece of a name split on a pattern; NULL beyond the last piece."""
    return F.get(F.split(col_of(c), pattern), position - 1)


def map_values(c: str | Column, mapping: Mapping) -> Column:
    """Replace listed values; others pass through. For small fixed maps."""
    if len(mapping) > MAX_INLINE_MAP:
        raise ValueError("join with a lookup table for maps of this size")
    c = col_of(c)
    if not mapping:
        return c
    out = None
    for old, new in mapping.items():
        out = F.when(c == F.lit(old), F.lit(new)) if out is None else out.when(c == F.lit(old), F.lit(new))
    return out.otherwise(c)


def map_values_by_table(df: DataFrame, column: str, lookup: DataFrame, source: str, target: str) -> DataFrame:
    """Replace values through a lookup table with one row per source value."""
    right = lookup.select(F.col(source).alias("__from"), F.col(target).alias("__to"))
    return (
        df.join(right, F.col(column) == F.col("__from"), "left")
        .withColumn(column, F.coalesce("__to", column))
        .drop("__from", "__to")
    )


def roll_up(c: str | Column, classes: Mapping[str, Sequence[str]]) -> Column:
    """Many labels to one class; labels in no class, and missing labels, are kept."""
    if sum(len(v) for v in classes.values()) > MAX_INLINE_MAP:
        raise ValueError("join with a roll-up table for maps of this size")
    c = col_of(c)
    out = None
    for name, members in classes.items():
        test = is_in(c, members)
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return c if out is None else out.otherwise(c)


def roll_up_table(spark: SparkSession, classes: Mapping[str, Sequence[str]]) -> DataFrame:
    rows = [(m, name) for name, members in classes.items() for m in members]
    return spark.createDataFrame(rows, "label string, class string")


def log_ratio(a: str | Column, b: str | Column) -> Column:
    return F.ln(ratio(a, b))


def log_ratio_to_percent(c: str | Column) -> Column:
    return (F.exp(col_of(c)) - 1) * 100


def cube_root(c: str | Column) -> Column:
    return F.pow(col_of(c), F.lit(1.0 / 3.0))


def inverse(c: str | Column) -> Column:
    return ratio(F.lit(1.0), c)


def round_half_even(c: str | Column, digits: int = 0) -> Column:
    return F.bround(col_of(c), digits)


def significance_mark(p: str | Column, dagger: bool = True, ns: str = "") -> Column:
    """Left-closed classes of a probability; exactly 1, and values outside [0, 1], give NULL."""
    p = col_of(p)
    # Upper class limits and their marks.
    # 0.001 ***   0.01 **   0.05 *   0.1 dagger or point   1 not significant
    return (
        F.when((p < 0) | (p >= 1), None)
        .when(p < 0.001, "***")
        .when(p < 0.01, "**")
        .when(p < 0.05, "*")
        .when(p < 0.1, "†" if dagger else ".")
        .when(p < 1, ns)
    )


def capitalise_words(c: str | Column, strict: bool = False) -> Column:
    """Upper-case the first letter of each blank-separated word; ``strict`` lowers the rest."""

    def one(word: Column) -> Column:
        rest = F.substr(word, F.lit(2))
        return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(rest) if strict else rest)

    return F.array_join(F.transform(F.split(col_of(c), " "), one), " ")


def blank_if_missing(c: str | Column) -> Column:
    return F.coalesce(col_of(c).cast("string"), F.lit(""))


def number_grid(spark: SparkSession, start: float, stop: float, *, step: float | None = None,
                length: int | None = None, name: str = "x") -> DataFrame:
    """Evenly spaced values, by step or by length."""
    if (step is None) == (length is None):
        raise ValueError("give either step or length")
    if step is not None:
        length = int((stop - start) / step + 1e-10) + 1
    elif length > 1:
        step = (stop - start) / (length - 1)
    else:
        step = 0.0
    return spark.range(length).select((F.lit(start) + F.col("id") * F.lit(step)).alias(name))
