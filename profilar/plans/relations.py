"""Queries on joins, unions, grouped statistics, windows and effect sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from profilar.functions import nulls, scalar
from profilar.functions.nulls import tidy
from profilar.operators import aggregate, effects, joins, ordered, profiles, reconcile, reshape, shares
from profilar.plans import bindings as b
from profilar.plans.registry import query

L = b.sql(b.SQL_LONG)
P = b.sql(b.SQL_PROFILES)
T = b.sql(b.SQL_TABLE)
BRANDS = [f"Brand#{i}" for i in range(25)]


@query("natural_left_join", "J1 N9 N10", """
SELECT c_custkey, c_mktsegment, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def natural_left_join(spark, folder):
    c = reshape.rename(b.table(spark, folder, "customer").drop("c_name"), nation="c_nationkey")
    n = reshape.rename(b.table(spark, folder, "nation").drop("n_regionkey"), nation="n_nationkey")
    return joins.natural_left(c, n, ["nation"]).select("c_custkey", "c_mktsegment", "n_name")


@query("annotated_spectrum", "J2 A1 N1", """
WITH f AS (SELECT n_name AS site, o_custkey AS sample, l_partkey, sum(l_extendedprice) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT site, p_type AS grp, count(*) AS n, round(sum(value), 2) AS value
FROM f LEFT JOIN (SELECT p_partkey, CASE WHEN p_size < 48 THEN p_type END AS p_type FROM part) ON l_partkey = p_partkey
GROUP BY ALL""")
def annotated_spectrum(spark, folder):
    # Large parts have no label: their lines are the unannotated windows.
    dim = b.table(spark, folder, "part").select(
        F.col("p_partkey").alias("window"), F.when(F.col("p_size") < 48, F.col("p_type")).alias("grp"))
    facts = b.purchases(spark, folder).groupBy("sample", "window").agg(F.sum("value").alias("value"))
    sites = b.samples(spark, folder).select("sample", "site")
    joined = joins.annotate(facts.join(sites, "sample"), dim, ["window"])
    return joined.groupBy("site", "grp").agg(
        F.count(F.lit(1)).alias("n"), tidy(F.sum("value"), 2).alias("value"))


CELLS = P + """,
cells AS (SELECT site, treatment, trt_id, avg(lcratio) AS m, count(lcratio) AS n, stddev_samp(lcratio) AS sd,
          count(*) AS rows FROM profiles GROUP BY ALL)"""


@query("control_baseline", "J3 W9 E5", P + """,
c AS (SELECT site, avg(lcratio) AS control, avg(gsratio) AS gs_cnt FROM profiles WHERE treatment = 'BUILDING' GROUP BY 1)
SELECT p.sample, trt_id, round(lcratio, 5) AS lcratio, round(control, 5) AS control,
       CASE WHEN lcratio > 0 AND control > 0 THEN round(ln(lcratio / control), 5) END AS lrr,
       round(gsratio / nullif(gs_cnt, 0), 5) AS gs_rr
FROM profiles p LEFT JOIN c USING (site) WHERE treatment <> 'BUILDING'""")
def control_baseline(spark, folder):
    out = effects.sample_log_ratio(
        b.profiles(spark, folder), site="site", treatment="treatment", control=b.CONTROL, value="lcratio",
        baseline={"lcratio": "control", "gsratio": "gs_cnt"})
    return out.select("sample", "trt_id", tidy("lcratio", 5).alias("lcratio"), tidy("control", 5).alias("control"),
                      tidy("lrr", 5).alias("lrr"), tidy(nulls.ratio("gsratio", "gs_cnt"), 5).alias("gs_rr"))


@query("cell_log_ratio", "E5 A5 F9", P + """,
c AS (SELECT site, avg(lcratio) AS control FROM profiles WHERE treatment = 'BUILDING' GROUP BY 1),
m AS (SELECT site, treatment, trt_id, control, avg(lcratio) AS lcratio, avg(gsratio) AS gsratio
      FROM profiles LEFT JOIN c USING (site) WHERE treatment <> 'BUILDING' GROUP BY ALL)
SELECT trt_id, round(gsratio, 5) AS gsratio, round(ln(lcratio / control), 5) AS lrr,
       round((exp(ln(lcratio / control)) - 1) * 100, 3) AS pct FROM m""")
def cell_log_ratio(spark, folder):
    rows = effects.sample_log_ratio(
        b.profiles(spark, folder), site="site", treatment="treatment", control=b.CONTROL, value="lcratio",
        baseline={"lcratio": "control"})
    cells = effects.cell_log_ratio(rows, keys=["site", "treatment", "trt_id"], value="lcratio",
                                   baseline="control", means=["gsratio"])
    return cells.select("trt_id", tidy("gsratio", 5).alias("gsratio"), tidy("lrr", 5).alias("lrr"),
                        tidy(scalar.log_ratio_to_percent("lrr"), 3).alias("pct"))


def _label_cell(source):
    return (f"coalesce(string_agg(DISTINCT p_type, '|' ORDER BY p_type) FILTER (p_brand = '{source}'), '') "
            f'AS "{source}"')


@query("outer_label_merge", "J4 D4", "SELECT p_name AS comp, " + ", ".join(map(_label_cell, BRANDS))
       + " FROM part WHERE p_type <> 'PROMO' GROUP BY 1")
def outer_label_merge(spark, folder):
    part = b.table(spark, folder, "part").select(
        F.col("p_brand").alias("source"), F.col("p_name").alias("comp"), F.col("p_type").alias("grp"))
    return reconcile.label_matrix(part, BRANDS, skip=["PROMO"]).fillna("", subset=BRANDS)


@query("outer_join_chain", "J4 Q7", """
SELECT coalesce(a.k, s.k, c.k) AS k, a.n AS a_n, s.n AS s_n, c.n AS c_n
FROM (SELECT p_name AS k, p_partkey AS n FROM part WHERE p_brand = 'Brand#1') a
FULL JOIN (SELECT p_name AS k, p_partkey AS n FROM part WHERE p_brand = 'Brand#2') s ON a.k = s.k
FULL JOIN (SELECT p_name AS k, count(*) AS n FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2') GROUP BY 1) c
  ON coalesce(a.k, s.k) = c.k""")
def outer_join_chain(spark, folder):
    part = b.table(spark, folder, "part")

    def rows(brand, name):  # names repeat within a brand: every pair of matches is a row
        return part.where(F.col("p_brand") == brand).select(F.col("p_name").alias("k"), F.col("p_partkey").alias(name))

    rest = part.where(~F.col("p_brand").isin("Brand#1", "Brand#2")).groupBy(F.col("p_name").alias("k")).agg(
        F.count(F.lit(1)).alias("c_n"))
    return joins.outer_chain([rows("Brand#1", "a_n"), rows("Brand#2", "s_n"), rest], ["k"])


def _window_cell(source):
    return f"coalesce(max(CAST(p_partkey AS VARCHAR)) FILTER (p_brand = '{source}'), '') AS \"{source}_window\""


@query("time_alignment", "J5 W5 F11 F14 N11", """
WITH n AS (SELECT p_brand, p_partkey, round_even(p_retailprice, 0) AS rt,
  row_number() OVER (PARTITION BY p_brand, round_even(p_retailprice, 0) ORDER BY p_partkey) AS rep FROM part)
SELECT rt, rep, """ + ", ".join(map(_window_cell, BRANDS)) + " FROM n GROUP BY ALL")
def time_alignment(spark, folder):
    part = b.table(spark, folder, "part").select(
        F.col("p_brand").alias("source"), F.col("p_partkey").alias("window"), F.col("p_retailprice").alias("rt_s"))
    return reconcile.align_by_time(part, BRANDS, source="source", time="rt_s", order="window", values=["window"])


@query("nonempty_counts", "A11 N14", "SELECT " + ", ".join(
    f"count(CASE WHEN p_brand = '{s}' THEN 1 END) AS \"{s}_window\"" for s in BRANDS) + " FROM part")
def nonempty_counts(spark, folder):
    return aggregate.nonempty_counts(time_alignment(spark, folder), [f"{s}_window" for s in BRANDS])


@query("replicated_control", "J6", b.sql(b.SQL_SAMPLES) + """,
lv AS (SELECT DISTINCT site, site || '_' || treatment AS site_trt FROM samples WHERE treatment <> 'BUILDING')
SELECT sample, treatment, site_trt FROM samples JOIN lv USING (site) WHERE treatment = 'BUILDING'
UNION ALL SELECT sample, treatment, site || '_' || treatment FROM samples WHERE treatment <> 'BUILDING'""")
def replicated_control(spark, folder):
    out = joins.replicate_control(b.samples(spark, folder), site="site", treatment="treatment",
                                  control=b.CONTROL, label="treatment", out="site_trt")
    return out.select("sample", "treatment", "site_trt")


@query("listed_samples", "J7", """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def listed_samples(spark, folder):
    keys = b.table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'").select(
        F.col("o_orderkey").alias("l_orderkey"))
    lines = b.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return joins.keep_listed(lines, keys, ["l_orderkey"])


@query("bound_columns", "J8 N16", P + """
SELECT p.sample, round("ECONOMY", 6) AS "ECONOMY", acctbal FROM profiles p JOIN samples USING (sample)""")
def bound_columns(spark, folder):
    left = b.profiles(spark, folder).select("sample", "ECONOMY")
    out = joins.match(left, b.samples(spark, folder).select("sample", "acctbal"), ["sample"], "left")
    return out.withColumn("ECONOMY", tidy("ECONOMY"))


@query("label_disagreement", "A12 J9 D3", """
SELECT p_name AS comp, count(DISTINCT p_type) AS n_labels FROM part WHERE p_type <> 'PROMO'
GROUP BY 1 HAVING count(DISTINCT p_type) > 1""")
def label_disagreement(spark, folder):
    part = b.table(spark, folder, "part").select(
        F.col("p_brand").alias("source"), F.col("p_name").alias("comp"), F.col("p_type").alias("grp"))
    return reconcile.disagreement_report(part, BRANDS, skip=["PROMO"]).select("comp", "n_labels")


@query("strict_union", "U2", """
SELECT src, count(*) AS n, round(sum(acctbal), 2) AS acctbal FROM (
  SELECT 'c' AS src, c_acctbal AS acctbal FROM customer UNION ALL SELECT 's', s_acctbal FROM supplier) GROUP BY 1""")
def strict_union(spark, folder):
    c = b.table(spark, folder, "customer").select(F.lit("c").alias("src"), F.col("c_acctbal").alias("acctbal"))
    s = b.table(spark, folder, "supplier").select(F.col("s_acctbal").alias("acctbal"), F.lit("s").alias("src"))
    return joins.union_strict(c, s).groupBy("src").agg(
        F.count(F.lit(1)).alias("n"), tidy(F.sum("acctbal"), 2).alias("acctbal"))


@query("cell_statistics", "A3 N5 N6 N7 DM6", P + """
SELECT site, treatment, trt_id, round(avg(ln(lcratio)), 6) AS "M", count(ln(lcratio)) AS "N",
       round(stddev_samp(ln(lcratio)), 6) AS "SD" FROM profiles WHERE lcratio > 0 GROUP BY ALL""")
def cell_statistics(spark, folder):
    df = b.profiles(spark, folder).where("lcratio > 0")
    out = effects.cell_statistics(df, ["site", "treatment", "trt_id"], "lcratio", log_scale=True)
    return reshape.map_columns(out, tidy, columns=["M", "SD"])


@query("missing_value_rules", "N5 N6 A3", P + """
SELECT trt_id, round(CASE WHEN count(*) = count(lcratio) THEN avg(lcratio) END, 5) AS strict_mean,
       round(avg(lcratio), 5) AS loose_mean, count(lcratio) AS n_value, count(*) AS n_row FROM profiles GROUP BY 1""")
def missing_value_rules(spark, folder):
    return b.profiles(spark, folder).groupBy("trt_id").agg(
        tidy(nulls.summary(F.avg, "lcratio"), 5).alias("strict_mean"),
        tidy(nulls.summary(F.avg, "lcratio", "skip"), 5).alias("loose_mean"),
        F.count("lcratio").alias("n_value"), F.count(F.lit(1)).alias("n_row"))


@query("mean_and_error", "A4 D2", T + """
SELECT site, treatment, round(avg("LARGE"), 6) AS "LARGE_M",
       round(stddev_samp("LARGE") / sqrt(count("LARGE")), 6) AS "LARGE_SE",
       round(avg(qty), 6) AS "qty_M", round(stddev_samp(qty) / sqrt(count(qty)), 6) AS "qty_SE"
FROM tab GROUP BY ALL""")
def mean_and_error(spark, folder):
    out = aggregate.summarise(b.sample_table(spark, folder), ["site", "treatment"], ["LARGE", "qty"], ["M", "SE"])
    return reshape.map_columns(out, tidy, columns=["LARGE_M", "LARGE_SE", "qty_M", "qty_SE"])


@query("grouped_means", "A5", T + """
SELECT site, treatment, trt_id, round(avg(cn), 5) AS cn, round(avg(qty), 5) AS qty FROM tab GROUP BY ALL""")
def grouped_means(spark, folder):
    return b.sample_table(spark, folder).groupBy("site", "treatment", "trt_id").agg(
        tidy(F.avg("cn"), 5).alias("cn"), tidy(F.avg("qty"), 5).alias("qty"))


@query("group_counts", "A6", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def group_counts(spark, folder):
    return aggregate.count_rows(b.table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("contingency_table", "A7", b.sql(b.SQL_SAMPLES) + "SELECT site, " + ", ".join(
    f"count(*) FILTER (treatment = '{t}') AS \"{t}\"" for t in b.TREATMENTS) + " FROM samples GROUP BY 1")
def contingency_table(spark, folder):
    return aggregate.contingency(b.samples(spark, folder), "site", "treatment", b.TREATMENTS)


@query("distinct_rows", "A8", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_rows(spark, folder):
    return b.table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("key_uniqueness", "A9", """
SELECT 'orders' AS tbl, CAST(count(*) AS BIGINT) AS n_rows, count(DISTINCT o_orderkey) AS n_keys,
       count(*) = count(DISTINCT o_orderkey) AS is_unique FROM orders
UNION ALL SELECT 'lineitem', count(*), count(DISTINCT l_orderkey), count(*) = count(DISTINCT l_orderkey)
FROM lineitem""")
def key_uniqueness(spark, folder):
    parts = [
        aggregate.uniqueness(b.table(spark, folder, t), [k]).withColumn("tbl", F.lit(t))
        for t, k in (("orders", "o_orderkey"), ("lineitem", "l_orderkey"))
    ]
    return joins.union_strict(*parts)


@query("scalar_ranges", "A10 A13", """
SELECT min(l_discount) AS lo, max(l_discount) AS hi, round(avg(l_discount), 6) AS mean,
       min(CASE WHEN l_discount <> 0 THEN l_discount END) AS lo_nonzero FROM lineitem""")
def scalar_ranges(spark, folder):
    return b.table(spark, folder, "lineitem").agg(
        F.min("l_discount").alias("lo"), F.max("l_discount").alias("hi"),
        tidy(F.avg("l_discount")).alias("mean"), aggregate.least_nonzero("l_discount").alias("lo_nonzero"))


BOX = """,
q AS (SELECT site, quantile_cont(qty, 0.25) AS q1, quantile_cont(qty, 0.5) AS median,
             quantile_cont(qty, 0.75) AS q3 FROM tab GROUP BY 1)"""


@query("box_statistics", "A14", T + BOX + """
SELECT site, round(q1, 5) AS q1, round(median, 5) AS median, round(q3, 5) AS q3, count(*) AS n,
  round(min(qty) FILTER (qty BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 5) AS lower_whisker,
  round(max(qty) FILTER (qty BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 5) AS upper_whisker,
  count(*) FILTER (qty NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM tab JOIN q USING (site) GROUP BY ALL""")
def box_statistics(spark, folder):
    df = b.covariates(spark, folder).join(b.samples(spark, folder).select("sample", "site"), "sample")
    out = aggregate.box_statistics(df, ["site"], "qty")
    return reshape.map_columns(out, lambda c: tidy(c, 5),
                               columns=["q1", "median", "q3", "lower_whisker", "upper_whisker"])


@query("box_outliers", "A14", """
WITH q AS (SELECT l_linenumber, quantile_cont(l_extendedprice, 0.25) AS q1,
                  quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem JOIN q USING (l_linenumber)
WHERE l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1)""")
def box_outliers(spark, folder):
    df = b.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return aggregate.box_outliers(df, ["l_linenumber"], "l_extendedprice")


@query("compound_dictionary", "A15 O1", """
SELECT DISTINCT comp, grp FROM (SELECT p_name AS comp, p_type AS grp FROM part
  UNION ALL SELECT p_brand, p_type FROM part)""")
def compound_dictionary(spark, folder):
    part = b.table(spark, folder, "part")
    names = part.select(F.col("p_name").alias("comp"), F.col("p_type").alias("grp"))
    brands = part.select(F.col("p_brand").alias("comp"), F.col("p_type").alias("grp"))
    return aggregate.dictionary({"names": names, "brands": brands}, "comp", "grp")


HISTORY = b.sql(b.SQL_LONG) + """,
hist AS (SELECT trt_id, site, year(o_orderdate) AS yr, sum(value) AS rate FROM long GROUP BY ALL)"""


def _history(spark, folder):
    lines = b.purchases(spark, folder).groupBy("sample", F.year("o_orderdate").cast("bigint").alias("yr")).agg(
        F.sum("value").alias("rate"))
    joined = lines.join(b.samples(spark, folder), "sample")
    return joined.groupBy("trt_id", "site", "yr").agg(F.sum("rate").alias("rate"))


@query("running_total", "W3 DM8", HISTORY + """
SELECT trt_id, yr, round(sum(rate) OVER (PARTITION BY trt_id ORDER BY yr), 2) AS added FROM hist""")
def running_total(spark, folder):
    out = ordered.running_total(_history(spark, folder), ["trt_id"], ["yr"], {"added": "rate"})
    return out.select("trt_id", "yr", tidy("added", 2).alias("added"))


@query("running_total_missing", "W3 N5", """
SELECT l_orderkey, l_linenumber, l_partkey,
  round(sum(CASE WHEN l_quantity > 10 THEN l_extendedprice END) OVER w, 2) AS skipped,
  CASE WHEN count(*) FILTER (l_quantity IS NULL OR l_orderkey > 900 AND l_quantity <= 10) OVER w = 0
       THEN round(sum(l_extendedprice) OVER w, 2) END AS propagated
FROM lineitem WINDOW w AS (PARTITION BY l_returnflag
  ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING)""")
def running_total_missing(spark, folder):
    """Running sums over a column with missing values, under both rules."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    df = b.table(spark, folder, "lineitem").select(
        "l_returnflag", *order, F.when(F.col("l_quantity") > 10, F.col("l_extendedprice")).alias("some"),
        F.when(~((F.col("l_orderkey") > 900) & (F.col("l_quantity") <= 10)), F.col("l_extendedprice")).alias("most"))
    out = ordered.running_total(df, ["l_returnflag"], order, {"skipped": "some"}, range_rows=10_000)
    out = ordered.running_total(out, ["l_returnflag"], order, {"propagated": "most"}, na="propagate", range_rows=10_000)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", tidy("skipped", 2).alias("skipped"),
                      tidy("propagated", 2).alias("propagated"))


@query("complete_shares", "P3 R4 N1", b.sql(b.SQL_LONG) + """,
k AS (SELECT sample, CASE WHEN p_size < 45 THEN grp END AS grp, value FROM long JOIN part ON p_partkey = "window"
      WHERE p_size >= 45 OR grp <> 'PROMO')
SELECT sample, round(coalesce(sum(value) FILTER (grp = 'ECONOMY'), 0) / sum(value), 6) AS "ECONOMY",
       round(coalesce(sum(value) FILTER (grp IS NULL), 0) / sum(value), 6) AS unlabelled,
       round(coalesce(sum(value) FILTER (grp <> 'ECONOMY'), 0) / sum(value), 6) AS rest, 1.0::DOUBLE AS total
FROM k GROUP BY 1""")
def complete_shares(spark, folder):
    """Shares of one listed group, of the unlabelled and of all others: they sum to 1."""
    dim = b.table(spark, folder, "part").select(
        F.col("p_partkey").alias("window"), F.when(F.col("p_size") < 45, F.col("p_type")).alias("grp"))
    lines = joins.annotate(b.purchases(spark, folder), dim, ["window"])
    wide = profiles.profile_table(lines, ids=["sample"], groups=["ECONOMY"], drop=b.DROP, classes={},
                                  missing="unlabelled", other="rest")
    total = F.col("ECONOMY") + F.col("unlabelled") + F.col("rest")
    return wide.select("sample", *[tidy(c).alias(c) for c in ("ECONOMY", "unlabelled", "rest")], tidy(total, 9).alias("total"))


@query("running_total_lines", "W3", """
SELECT l_orderkey, l_linenumber, l_partkey, round(sum(l_extendedprice) OVER (PARTITION BY l_returnflag
  ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING), 2) AS running
FROM lineitem""")
def running_total_lines(spark, folder):
    """Three keys over the whole fact table: each key is a third of all rows."""
    df = b.table(spark, folder, "lineitem").select(
        "l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    out = ordered.running_total(
        df, ["l_returnflag"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"],
        {"running": "l_extendedprice"})
    return out.select("l_orderkey", "l_linenumber", "l_partkey", tidy("running", 2).alias("running"))


@query("first_and_last_rows", "W4 F7", HISTORY + """,
e AS (SELECT trt_id, min(yr) AS a, max(yr) AS z FROM hist GROUP BY 1)
SELECT trt_id, yr, round(rate, 2) AS rate, 'first' AS edge FROM hist JOIN e USING (trt_id) WHERE yr = a
UNION ALL SELECT trt_id, yr, round(rate, 2), 'last' FROM hist JOIN e USING (trt_id) WHERE yr = z""")
def first_and_last_rows(spark, folder):
    hist = _history(spark, folder).select("trt_id", "yr", tidy("rate", 2).alias("rate"))
    first = ordered.extreme_rows(hist, ["trt_id"], "yr", "min").withColumn("edge", F.lit("first"))
    last = ordered.extreme_rows(hist, ["trt_id"], "yr", "max").withColumn("edge", F.lit("last"))
    return first.unionByName(last)


@query("sequence_in_group", "W5", """
SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS seq FROM customer""")
def sequence_in_group(spark, folder):
    df = b.table(spark, folder, "customer").select("c_nationkey", "c_custkey")
    return ordered.sequence_in_group(df, ["c_nationkey"], ["c_custkey"]).select("c_custkey", "seq")


@query("sequence_over_table", "W6", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS obs FROM orders")
def sequence_over_table(spark, folder):
    df = b.table(spark, folder, "orders").select("o_orderkey")
    return ordered.sequence_in_group(df, [], ["o_orderkey"], out="obs")


@query("equal_site_weight", "W7", b.sql(b.SQL_SAMPLES) + """
SELECT sample, round(1.0 / count(*) OVER (PARTITION BY site), 8) AS wi2 FROM samples""")
def equal_site_weight(spark, folder):
    out = shares.equal_weight(b.samples(spark, folder), ["site"])
    return out.select("sample", tidy("wi2", 8).alias("wi2"))


@query("min_max_scaling", "W8", """
SELECT c_custkey, round(0.5 + 3 * (c_acctbal - min(c_acctbal) OVER ()) /
  (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS size FROM customer""")
def min_max_scaling(spark, folder):
    df = b.table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    return shares.min_max(df, "c_acctbal", "size").select("c_custkey", tidy("size").alias("size"))


@query("baseline_difference", "W9 A4", P + """,
c AS (SELECT site, avg("LARGE") AS base FROM profiles WHERE treatment = 'BUILDING' GROUP BY 1)
SELECT p.sample, round("LARGE" - base, 6) AS std FROM profiles p LEFT JOIN c USING (site)
WHERE treatment <> 'BUILDING'""")
def baseline_difference(spark, folder):
    out = shares.difference_from_control(b.profiles(spark, folder), by=["site"], treatment="treatment",
                                         control=b.CONTROL, value="LARGE", out="std")
    return out.select("sample", tidy("std").alias("std"))


@query("equal_frequency_bins", "W10 N19", """
WITH q AS (SELECT quantile_cont(l_extendedprice, 1.0 / 3) AS a, quantile_cont(l_extendedprice, 2.0 / 3) AS z
           FROM lineitem)
SELECT CASE WHEN l_extendedprice <= a THEN 1 WHEN l_extendedprice <= z THEN 2 ELSE 3 END AS bin,
       count(*) AS n, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem, q GROUP BY 1""")
def equal_frequency_bins(spark, folder):
    binned = ordered.quantile_bin(b.table(spark, folder, "lineitem"), "l_extendedprice", 3, "bin")
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("l_extendedprice").alias("lo"),
                                     F.max("l_extendedprice").alias("hi"))


@query("bin_labels", "W10", """
WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b,
  quantile_cont(o_totalprice, 0.75) AS c, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
l AS (SELECT [lo - (hi - lo) / 1000, a, b, c, hi + (hi - lo) / 1000] AS k FROM q),
x AS (SELECT CASE WHEN o_totalprice <= k[2] THEN 1 WHEN o_totalprice <= k[3] THEN 2 WHEN o_totalprice <= k[4] THEN 3
  ELSE 4 END AS f_tot, k FROM orders, l)
SELECT f_tot, printf('(%.3g,%.3g]', k[f_tot], k[f_tot + 1]) AS f_tot_label, count(*) AS n FROM x GROUP BY ALL""")
def bin_labels(spark, folder):
    df = b.table(spark, folder, "orders")
    binned = ordered.quantile_bin(df, "o_totalprice", 4, "f_tot")
    return aggregate.count_rows(binned, ["f_tot", "f_tot_label"]).orderBy("f_tot")


@query("sorted_history", "O1 W3", HISTORY + "SELECT site, trt_id, yr, round(rate, 2) AS rate FROM hist")
def sorted_history(spark, folder):
    return _history(spark, folder).orderBy("site", "trt_id", "yr").select(
        "site", "trt_id", "yr", tidy("rate", 2).alias("rate"))


@query("level_order", "O2", """
SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY') THEN c_mktsegment END AS seg
FROM customer""")
def level_order(spark, folder):
    df = b.table(spark, folder, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg"))
    return ordered.sort_by_levels(df, "seg", ["MACHINERY", "BUILDING", "AUTOMOBILE"], "c_custkey")


@query("significance_marks", "F12", """
SELECT l_orderkey, l_linenumber, l_tax, CASE WHEN l_tax < 0.001 THEN '***' WHEN l_tax < 0.01 THEN '**'
  WHEN l_tax < 0.05 THEN '*' WHEN l_tax < 0.1 THEN '†' ELSE 'n.s.' END AS mark FROM lineitem""")
def significance_marks(spark, folder):
    return b.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_tax", scalar.significance_mark("l_tax", ns="n.s.").alias("mark"))


@query("number_grid", "F15 A10 J9", """
WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
SELECT round(lo + (hi - lo) * i / 99, 2) AS x FROM r, range(100) t(i)""")
def number_grid(spark, folder):
    r = b.table(spark, folder, "orders").agg(F.min("o_totalprice"), F.max("o_totalprice")).first()
    return scalar.number_grid(spark, r[0], r[1], length=100).select(tidy("x", 2).alias("x"))


EFFECTS = P + """,
cell AS (SELECT site, treatment, trt_id, avg(v) AS m, count(v) AS n, stddev_samp(v) AS sd
         FROM (SELECT site, treatment, trt_id, %s AS v FROM profiles WHERE lcratio > 0) GROUP BY ALL),
pair AS (SELECT f.site, f.trt_id, f.m AS fm, f.n AS fn, f.sd AS fs, c.m AS cm, c.n AS cn, c.sd AS cs
         FROM (SELECT * FROM cell WHERE treatment <> 'BUILDING') f
         LEFT JOIN (SELECT * FROM cell WHERE treatment = 'BUILDING') c USING (site)),
es AS (SELECT site, trt_id, %s AS yi, %s AS vi FROM pair)"""
ROM = EFFECTS % ("lcratio", "ln(fm / cm)", "fs * fs / (fn * fm * fm) + cs * cs / (cn * cm * cm)")
MD = EFFECTS % ("ln(lcratio)", "fm - cm", "fs * fs / fn + cs * cs / cn")


def paired_cells(spark, folder, log_scale):
    df = b.profiles(spark, folder).where("lcratio > 0")
    cells = effects.cell_statistics(df, ["site", "treatment", "trt_id"], "lcratio", log_scale=log_scale)
    return effects.pair_with_control(cells, control=b.CONTROL)


@query("log_ratio_of_means", "E1 J3 A3", ROM + """
SELECT trt_id, round(yi, 6) AS yi, round(vi, 6) AS vi FROM es""")
def log_ratio_of_means(spark, folder):
    out = effects.effect_size(paired_cells(spark, folder, False), "ROM")
    return out.select("trt_id", tidy("yi").alias("yi"), tidy("vi").alias("vi"))


@query("mean_difference", "E2 E3 F10", MD + """
SELECT trt_id, round(yi, 6) AS yi, round(vi, 6) AS vi, round(yi - 1.96 * sqrt(vi), 6) AS lci,
       round(yi + 1.96 * sqrt(vi), 6) AS uci, round((exp(yi) - 1) * 100, 4) AS pct FROM es""")
def mean_difference(spark, folder):
    out = effects.with_limits(effects.effect_size(paired_cells(spark, folder, True), "MD"))
    return out.select("trt_id", *[tidy(c).alias(c) for c in ("yi", "vi", "lci", "uci")],
                      tidy(scalar.log_ratio_to_percent("yi"), 4).alias("pct"))


CELL_COVARIATES = "," + b.SQL_COVARIATES + """,
cov AS (SELECT trt_id, avg(n_lines) AS n_added, avg(tax) AS n_rate, avg(cn) AS cnratio
        FROM covariates JOIN samples USING (sample) GROUP BY 1)"""


def cell_covariates(spark, folder):
    """trt_id with the cell means the meta-analysis uses as moderators."""
    df = b.covariates(spark, folder).join(b.samples(spark, folder), "sample")
    return df.groupBy("trt_id").agg(
        F.avg("n_lines").alias("n_added"), F.avg("tax").alias("n_rate"),
        F.avg("n_year").alias("n_year"), F.avg("cn").alias("cnratio"))


def rom_table(spark, folder, bins=None):
    return effects.effect_table(paired_cells(spark, folder, True), cell_covariates(spark, folder), measure="MD",
                                bins=bins)


@query("effect_table", "E4 E3 W6 W7 W8 W10 DM7", MD + CELL_COVARIATES + """,
j AS (SELECT * FROM es LEFT JOIN cov USING (trt_id)),
q AS (SELECT quantile_cont(n_added, 1.0 / 3) AS a, quantile_cont(n_added, 2.0 / 3) AS z FROM j)
SELECT trt_id, round(yi, 6) AS yi, round(vi, 6) AS vi, round(n_rate, 6) AS n_rate,
  CASE WHEN n_added <= a THEN 1 WHEN n_added <= z THEN 2 WHEN n_added IS NOT NULL THEN 3 END AS f_nad,
  round(1 / sqrt(vi), 5) AS wi, round(0.5 + 3 * (1 / sqrt(vi) - min(1 / sqrt(vi)) OVER ()) /
    (max(1 / sqrt(vi)) OVER () - min(1 / sqrt(vi)) OVER ()), 6) AS size,
  round(1.0 / count(*) OVER (PARTITION BY site), 6) AS wi2, row_number() OVER (ORDER BY trt_id) AS sdn
FROM j, q""")
def effect_table(spark, folder):
    out = rom_table(spark, folder, {"f_nad": ("n_added", 3)})
    return out.select("trt_id", tidy("yi").alias("yi"), tidy("vi").alias("vi"), tidy("n_rate").alias("n_rate"),
                      "f_nad", tidy("wi", 5).alias("wi"), tidy("size").alias("size"), tidy("wi2").alias("wi2"), "sdn")
