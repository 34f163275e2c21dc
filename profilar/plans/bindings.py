"""The engine's generic tables, bound to the given test tables.

site = nation, treatment = market segment (BUILDING is the control), sample =
customer, window = part, component = part name, group = part type, value =
extended price.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilar.functions.nulls import ratio
from profilar.operators.profiles import profile_table

CONTROL = "BUILDING"
TREATMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
GROUPS_RAW = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
DROP = ["PROMO"]
CLASSES = {"SMALL_MEDIUM": ["SMALL", "MEDIUM"]}
GROUPS = ["ECONOMY", "LARGE", "SMALL_MEDIUM", "STANDARD"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
SITES = [f"NATION_{i}" for i in range(25)]
IDS = ["sample", "site", "treatment", "trt_id"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """sample, site, treatment, trt_id, acctbal"""
    c, n = table(spark, folder, "customer"), table(spark, folder, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("sample"),
        F.col("n_name").alias("site"),
        F.col("c_mktsegment").alias("treatment"),
        F.concat_ws("_", "n_name", "c_mktsegment").alias("trt_id"),
        F.col("c_acctbal").alias("acctbal"),
    )


def purchases(spark: SparkSession, folder: str) -> DataFrame:
    """sample, window, value and the line measures."""
    l, o = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    return l.join(o, l.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("sample"),
        F.col("l_partkey").alias("window"),
        F.col("l_extendedprice").alias("value"),
        "l_quantity", "l_discount", "l_tax", "l_orderkey", "l_linenumber", "o_orderdate",
    )


def annotation(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("window"), F.col("p_name").alias("comp"),
        F.col("p_type").alias("grp"), F.col("p_brand").alias("brand"),
    )


def group_sums(spark: SparkSession, folder: str) -> DataFrame:
    """sample keys, grp and the summed value: one row per sample and group."""
    sums = _lines(spark, folder).groupBy("sample", "grp").agg(F.sum("value").alias("value"))
    return sums.join(samples(spark, folder), "sample").select(*IDS, "grp", "value")


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return purchases(spark, folder).join(annotation(spark, folder), "window", "left")


def _with_ratios(wide: DataFrame) -> DataFrame:
    return wide.withColumns({
        "lcratio": ratio(F.col("SMALL_MEDIUM") + F.col("LARGE"), "ECONOMY"),
        "gsratio": ratio("SMALL_MEDIUM", "LARGE"),
    })


def _measures() -> dict:
    return {
        "qty": F.avg("l_quantity"), "disc": F.avg("l_discount") * 100, "tax": F.avg("l_tax") * 100,
        "n_lines": F.count(F.lit(1)).cast("double"),
        # The set is bounded by the calendar, so no second aggregation for distinct values.
        "n_year": F.size(F.collect_set(F.year("o_orderdate"))).cast("double"),
    }


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """One row per sample: group shares and ratios.

    Lines are reduced to one row per sample before the sample dimension is joined.
    """
    wide = profile_table(_lines(spark, folder), ids=["sample"], groups=GROUPS, drop=DROP, classes=CLASSES)
    dims = samples(spark, folder).drop("acctbal")
    return _with_ratios(wide.join(dims, "sample").select(*IDS, *GROUPS))


def covariates(spark: SparkSession, folder: str) -> DataFrame:
    """One row per sample: continuous covariates."""
    per = purchases(spark, folder).groupBy("sample").agg(*[e.alias(n) for n, e in _measures().items()])
    return per.withColumn("cn", ratio("qty", "disc"))


def sample_table(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles with covariates, from one pass over the lines: the table the models use."""
    wide = profile_table(_lines(spark, folder), ids=["sample"], groups=GROUPS, drop=DROP, classes=CLASSES,
                         extra=_measures())
    joined = wide.join(samples(spark, folder), "sample").withColumn("cn", ratio("qty", "disc"))
    return _with_ratios(joined)


# SQL text of the same tables, for the comparison queries.

SQL_SAMPLES = """
samples AS (
  SELECT c_custkey AS sample, n_name AS site, c_mktsegment AS treatment,
         n_name || '_' || c_mktsegment AS trt_id, c_acctbal AS acctbal
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

SQL_LONG = SQL_SAMPLES + """,
long AS (
  SELECT s.sample, site, treatment, trt_id, p_type AS grp, p_name AS comp, p_brand AS brand,
         l_partkey AS "window", l_extendedprice AS value, o_orderdate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN samples s ON s.sample = o_custkey LEFT JOIN part ON l_partkey = p_partkey)"""

SQL_PROFILES = SQL_LONG + """,
kept AS (
  SELECT sample, site, treatment, trt_id, value,
         CASE WHEN grp IN ('SMALL', 'MEDIUM') THEN 'SMALL_MEDIUM' ELSE grp END AS grp
  FROM long WHERE grp IS NULL OR grp NOT IN ('PROMO')),
wide AS (
  SELECT sample, site, treatment, trt_id,
         coalesce(sum(value) FILTER (grp = 'ECONOMY'), 0) / sum(value) AS "ECONOMY",
         coalesce(sum(value) FILTER (grp = 'LARGE'), 0) / sum(value) AS "LARGE",
         coalesce(sum(value) FILTER (grp = 'SMALL_MEDIUM'), 0) / sum(value) AS "SMALL_MEDIUM",
         coalesce(sum(value) FILTER (grp = 'STANDARD'), 0) / sum(value) AS "STANDARD"
  FROM kept GROUP BY ALL),
profiles AS (
  SELECT *, ("SMALL_MEDIUM" + "LARGE") / nullif("ECONOMY", 0) AS lcratio,
         "SMALL_MEDIUM" / nullif("LARGE", 0) AS gsratio
  FROM wide)"""

SQL_COVARIATES = """
covariates AS (
  SELECT o_custkey AS sample, avg(l_quantity) AS qty, avg(l_discount) * 100 AS disc,
         avg(l_tax) * 100 AS tax, count(*)::DOUBLE AS n_lines,
         count(DISTINCT year(o_orderdate))::DOUBLE AS n_year,
         avg(l_quantity) / nullif(avg(l_discount) * 100, 0) AS cn
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)"""

SQL_TABLE = SQL_PROFILES + "," + SQL_COVARIATES + """,
tab AS (SELECT p.*, c.qty, c.disc, c.tax, c.n_lines, c.n_year, c.cn, s.acctbal
        FROM profiles p JOIN covariates c USING (sample) JOIN samples s USING (sample))"""


def sql(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)
