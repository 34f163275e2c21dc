"""Queries on sources, projection, reshaping, shares and the whole preparation chain."""

from __future__ import annotations

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilar.functions import nulls, scalar
from profilar.functions.nulls import tidy
from profilar.operators import aggregate, ordered, profiles, reshape, shares
from profilar.operators.joins import drop_listed, match, union_padded
from profilar.plans import bindings as b
from profilar.plans.registry import query
from profilar.session import shared_folder
from profilar.sources import files, sinks

L = b.sql(b.SQL_LONG)
P = b.sql(b.SQL_PROFILES)


@query("profile_preparation", "P5 P7 F6 F8 W1 A1 R3 N1 N14", P + """
SELECT sample, site, treatment, trt_id, round("ECONOMY", 6) AS "ECONOMY", round("LARGE", 6) AS "LARGE",
       round("SMALL_MEDIUM", 6) AS "SMALL_MEDIUM", round("STANDARD", 6) AS "STANDARD",
       round(lcratio, 5) AS lcratio, round(gsratio, 5) AS gsratio FROM profiles""")
def profile_preparation(spark, folder):
    df = b.profiles(spark, folder)
    return df.select(*b.IDS, *[tidy(g).alias(g) for g in b.GROUPS],
                     tidy("lcratio", 5).alias("lcratio"), tidy("gsratio", 5).alias("gsratio"))


@query("csv_scan", "S1 S7 DM4", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_scan(spark, folder):
    path = os.path.join(shared_folder(spark), "customer")
    source = b.table(spark, folder, "customer")
    sinks.write_csv(source, path)
    return files.read_csv(spark, path, source.schema)


@query("tagged_scan", "S2", """
SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY 1""")
def tagged_scan(spark, folder):
    root = shared_folder(spark)
    source = b.table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    sinks.write_csv_per_key(source, root, "o_orderstatus")
    found = [r[0] for r in source.select("o_orderstatus").distinct().collect()]
    paths = {s: os.path.join(root, f"o_orderstatus={s}") for s in found}
    tagged = files.read_tagged(spark, paths, "o_orderkey bigint, o_totalprice double", "status")
    return tagged.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), tidy(F.sum("o_totalprice"), 2).alias("total"))


@query("folder_listing", "S3", """
SELECT 'lineitem' AS source, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem""")
def folder_listing(spark, folder):
    df = spark.read.option("pathGlobFilter", "lineitem*.parquet").parquet(folder)
    return (
        df.select("l_quantity", files.file_key(1).alias("source"))
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n"), tidy(F.sum("l_quantity"), 2).alias("qty"))
    )


@query("whitespace_scan", "S4", """
SELECT l_linenumber, count(*) AS n, round(sum(l_extendedprice), 2) AS total
FROM lineitem GROUP BY 1""")
def whitespace_scan(spark, folder):
    path = os.path.join(shared_folder(spark), "lines")
    fields = ["l_orderkey", "l_linenumber", "l_extendedprice"]
    lines = b.table(spark, folder, "lineitem").select(F.concat_ws("  ", *fields).alias("value"))
    head = spark.createDataFrame([("  ".join(fields),)], "value string")
    head.unionByName(lines).write.text(path)
    schema = T.StructType().add("l_orderkey", "long").add("l_linenumber", "integer").add("l_extendedprice", "double")
    return files.read_whitespace(spark, path, schema).groupBy("l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), tidy(F.sum("l_extendedprice"), 2).alias("total"))


@query("stacked_frames", "S5 U1", """
SELECT horizon, count(*) AS n, round(sum(value), 2) AS value FROM (
  SELECT 'Events' AS horizon, value FROM events
  UNION ALL SELECT 'Lines', l_extendedprice FROM lineitem) GROUP BY 1""")
def stacked_frames(spark, folder):
    stacked = files.stack_tagged({
        "Events": b.table(spark, folder, "events").select("value"),
        "Lines": b.table(spark, folder, "lineitem").select(F.col("l_extendedprice").alias("value")),
    }, "horizon")
    return stacked.groupBy("horizon").agg(F.count(F.lit(1)).alias("n"), tidy(F.sum("value"), 2).alias("value"))


@query("csv_per_key", "S6", """
SELECT c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS row,
       c_custkey, c_acctbal FROM customer""")
def csv_per_key(spark, folder):
    root = os.path.join(shared_folder(spark), "segments")
    source = b.table(spark, folder, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    sinks.write_csv_per_key(source, root, "c_mktsegment", row_names=["c_custkey"])
    return files.read_csv(spark, root, "row bigint, c_custkey bigint, c_acctbal double, c_mktsegment string")


@query("saved_results", "S8 S9", """
SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def saved_results(spark, folder):
    root = shared_folder(spark)
    sinks.write_results({"samples": b.samples(spark, folder)}, root)
    return (
        files.read_results(spark, root, "samples")
        .groupBy(F.col("site").alias("n_name"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query("column_selection", "P1 P2 P3 P4 DM3", """
SELECT l_extendedprice AS price, l_discount, l_tax, l_linestatus AS status, l_returnflag, l_shipdate IS NULL AS unsent,
       l_orderkey, l_linenumber FROM lineitem""")
def column_selection(spark, folder):
    df = b.table(spark, folder, "lineitem").drop("l_partkey", "l_suppkey")
    chosen = reshape.between(df, "l_extendedprice", "l_linestatus")
    df = df.select(*reshape.front_then_rest(df, *chosen))
    df = df.drop(*reshape.containing(df, "quantity")).withColumn("unsent", F.col("l_shipdate").isNull())
    df = df.drop(*reshape.starting_with(df, "l_ship"))
    return reshape.rename(df, price="l_extendedprice", status="l_linestatus")


@query("derived_columns", "P5 P6 F1 F11 F7 N3", """
SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS nation,
       round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END, 6) AS log_bal,
       round(exp(c_acctbal / 1000), 2) AS exp_bal,
       round(CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END, 6) AS sqrt_bal,
       round(CASE WHEN c_acctbal >= 0 THEN pow(c_acctbal, 1.0 / 3) END, 6) AS root3_bal,
       round(1 / nullif(c_acctbal, 0), 8) AS inv_bal, round_even(c_acctbal, 0) AS even_bal,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 1000.0::DOUBLE ELSE c_acctbal END AS total_n FROM customer""")
def derived_columns(spark, folder):
    bal = F.col("c_acctbal")
    df = b.table(spark, folder, "customer")
    text = reshape.map_columns(df, lambda c: F.col(c).cast("string"), dtype="int")
    return text.select(
        "c_custkey", F.col("c_nationkey").alias("nation"),
        tidy(nulls.log_of(bal)).alias("log_bal"), tidy(F.exp(bal / 1000), 2).alias("exp_bal"),
        tidy(F.when(bal >= 0, F.sqrt(bal))).alias("sqrt_bal"),
        tidy(F.when(bal >= 0, scalar.cube_root(bal))).alias("root3_bal"),
        tidy(scalar.inverse(bal), 8).alias("inv_bal"),
        (scalar.round_half_even(bal) + F.lit(0.0)).alias("even_bal"),
        nulls.if_else(F.col("c_mktsegment") == "BUILDING", F.lit(1000.0), bal).alias("total_n"),
    )


@query("text_functions", "F2 F3 F4 F13 F14 N12 N13", """
SELECT p_partkey, CAST(CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS VARCHAR) AS brand_id,
       replace(lower(p_type) || '-' || p_name, '-', '_') AS grp_name,
       upper(substr(p_name, 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' ||
         upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS words,
       substr(p_type, 1, 2) AS two, split_part(p_name, ' ', 2) AS second,
       p_brand || '_' || coalesce(CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) END, 'NA') AS pasted,
       coalesce(CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) END, '') AS blanked,
       CASE WHEN p_size <= 9 THEN CAST(p_size AS VARCHAR) END AS padded_id FROM part""")
def text_functions(spark, folder):
    part = b.table(spark, folder, "part")
    some = F.when(F.col("p_size") > 25, F.col("p_size"))
    raw = F.concat(F.lit("X00"), F.col("p_size"), F.when(F.col("p_size") > 9, F.lit("_1")).otherwise(F.lit("")))
    return part.select(
        "p_partkey", scalar.normalise_id("p_brand", "Brand#").alias("brand_id"),
        scalar.dashes_to_underscores(F.concat_ws("-", F.lower("p_type"), "p_name")).alias("grp_name"),
        scalar.capitalise_words("p_name").alias("words"),
        F.substring("p_type", 1, 2).alias("two"), scalar.name_part("p_name", 2, " ").alias("second"),
        nulls.paste("p_brand", some).alias("pasted"), scalar.blank_if_missing(some).alias("blanked"),
        scalar.normalise_id(raw, "X").alias("padded_id"),
    )


@query("label_recode", "F5 F6 N4 R4 DM9", """
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Control' ELSE c_mktsegment END AS treatment,
       CASE WHEN c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 'Home' ELSE c_mktsegment END AS class,
       CASE WHEN c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 'Home' ELSE c_mktsegment END AS class_by_table
FROM customer""")
def label_recode(spark, folder):
    classes = {"Home": ["FURNITURE", "HOUSEHOLD"]}
    df = b.table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    df = df.withColumns({
        "treatment": scalar.map_values("c_mktsegment", {"BUILDING": "Control"}),
        "class": scalar.roll_up("c_mktsegment", classes),
        "class_by_table": F.col("c_mktsegment"),
    })
    table = scalar.roll_up_table(spark, classes)
    return scalar.map_values_by_table(df, "class_by_table", table, "label", "class").drop("c_mktsegment")


@query("row_filters", "P7 N1 N2 N17", """
WITH a AS (SELECT l_partkey, p_type, l_extendedprice FROM lineitem
           LEFT JOIN (SELECT p_partkey, CASE WHEN p_size > 5 THEN p_type END AS p_type FROM part) ON l_partkey = p_partkey)
SELECT p_type AS grp, count(*) AS n, round(sum(l_extendedprice), 2) AS value FROM a
WHERE p_type IS NULL OR p_type NOT IN ('PROMO', 'promo', 'LARGE') GROUP BY 1""")
def row_filters(spark, folder):
    # Small parts have no group: their lines must stay.
    part = b.table(spark, folder, "part").select("p_partkey", F.when(F.col("p_size") > 5, F.col("p_type")).alias("p_type"))
    lines = b.table(spark, folder, "lineitem")
    joined = lines.join(part, lines.l_partkey == part.p_partkey, "left")
    return (
        joined.where(nulls.not_in("p_type", ["PROMO", "promo", "LARGE"]))
        .groupBy(F.col("p_type").alias("grp"))
        .agg(F.count(F.lit(1)).alias("n"), tidy(F.sum("l_extendedprice"), 2).alias("value"))
    )


@query("row_of_maximum", "P8", P + """
SELECT site, sample, trt_id, round(lcratio, 5) AS lcratio FROM profiles
QUALIFY row_number() OVER (PARTITION BY site ORDER BY lcratio DESC NULLS LAST, sample) = 1 AND lcratio IS NOT NULL""")
def row_of_maximum(spark, folder):
    df = b.profiles(spark, folder).select("site", "sample", "trt_id", "lcratio")
    best = aggregate.row_of_extreme(df, "lcratio", ["site"])
    return best.withColumn("lcratio", tidy("lcratio", 5))


@query("outliers_removed", "P9", P + """,
top AS (SELECT site, max(lcratio) AS m FROM profiles GROUP BY 1)
SELECT p.sample, round(lcratio, 5) AS lcratio FROM profiles p JOIN top USING (site)
WHERE lcratio IS NULL OR lcratio <> m""")
def outliers_removed(spark, folder):
    df = b.profiles(spark, folder).select("site", "sample", "lcratio")
    top = ordered.extreme_rows(df, ["site"], "lcratio", "max")
    return drop_listed(df, top, ["sample"]).select("sample", tidy("lcratio", 5).alias("lcratio"))


@query("row_peek", "P10", b.sql(b.SQL_SAMPLES) + "SELECT * FROM samples ORDER BY md5('7|' || sample), sample LIMIT 10")
def row_peek(spark, folder):
    return aggregate.peek(b.samples(spark, folder), "sample", 10, seed=7)


@query("row_totals", "P11 DM1", b.sql(b.SQL_LONG) + """
SELECT sample, round(sum(value) FILTER (grp IN ('ECONOMY', 'LARGE')), 2) AS part_total,
       round(sum(value), 2) AS total FROM long GROUP BY 1
HAVING count(DISTINCT grp) = 6""")
def row_totals(spark, folder):
    wide = reshape.to_wide(b.group_sums(spark, folder), ["sample"], "grp", "value", b.GROUPS_RAW)
    total = shares.row_total(b.GROUPS_RAW)
    return wide.where(total.isNotNull()).select(
        "sample", tidy(shares.row_total(["ECONOMY", "LARGE"]), 2).alias("part_total"),
        tidy(total, 2).alias("total"))


@query("row_shares", "P11 P3", b.sql(b.SQL_LONG) + """
SELECT sample, round(coalesce(sum(value) FILTER (grp = 'ECONOMY'), 0) / sum(value), 6) AS economy,
       round(coalesce(sum(value) FILTER (grp = 'STANDARD'), 0) / sum(value), 6) AS standard
FROM long GROUP BY 1""")
def row_shares(spark, folder):
    wide = reshape.to_wide(b.group_sums(spark, folder), ["sample"], "grp", "value", b.GROUPS_RAW, fill=0.0)
    out = shares.row_shares(wide, reshape.from_position(wide, 1))
    return out.select("sample", tidy("ECONOMY").alias("economy"), tidy("STANDARD").alias("standard"))


@query("used_levels", "P12", """
SELECT DISTINCT CASE WHEN c_mktsegment IN ('MACHINERY', 'FURNITURE', 'BUILDING') THEN c_mktsegment END AS treatment,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'BUILDING' THEN 3 END AS level
FROM customer""")
def used_levels(spark, folder):
    """Levels that occur are numbered anew; the others lose their label."""
    kept = F.when(F.col("c_mktsegment").isin("MACHINERY", "FURNITURE", "BUILDING"), F.col("c_mktsegment"))
    distinct = b.table(spark, folder, "customer").select(kept.alias("treatment")).distinct()
    levels = ["MACHINERY", "AUTOMOBILE", "FURNITURE", "BUILDING", "HOUSEHOLD"]
    return ordered.renumbered(distinct, "treatment", levels, "level")


@query("wide_to_long", "R1 DM2", """
SELECT l_orderkey, l_linenumber, 'l_quantity' AS variable, l_quantity AS value FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem""")
def wide_to_long(spark, folder):
    df = b.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return reshape.to_long(df, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


def _pivot_sql(levels, column, value, fill=None):
    parts = []
    for level in levels:
        body = f"round(sum({value}) FILTER ({column} = '{level}'), 2)"
        parts.append(f'coalesce({body}, {fill}) AS "{level}"' if fill is not None else f'{body} AS "{level}"')
    return ", ".join(parts)


@query("long_to_wide_null", "R2 N14", "SELECT user_id, " + _pivot_sql(b.EVENT_TYPES, "event_type", "value")
       + " FROM events GROUP BY 1")
def long_to_wide_null(spark, folder):
    sums = b.table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("value"))
    wide = reshape.to_wide(sums, ["user_id"], "event_type", "value", b.EVENT_TYPES)
    return reshape.map_columns(wide, lambda c: tidy(c, 2), columns=b.EVENT_TYPES)


@query("long_to_wide_zero", "R3 DM5", b.sql(b.SQL_LONG) + "SELECT sample, "
       + _pivot_sql(b.GROUPS_RAW, "grp", "value", 0) + " FROM long GROUP BY 1")
def long_to_wide_zero(spark, folder):
    wide = reshape.to_wide(b.group_sums(spark, folder), ["sample"], "grp", "value", b.GROUPS_RAW, fill=0.0)
    return reshape.map_columns(wide, lambda c: tidy(c, 2), columns=b.GROUPS_RAW)


@query("merged_groups", "R4 F6", b.sql(b.SQL_LONG) + """
SELECT sample, round(coalesce(sum(value) FILTER (grp IN ('SMALL', 'MEDIUM')), 0), 2) AS "SMALL_MEDIUM",
       round(coalesce(sum(value) FILTER (grp = 'LARGE'), 0), 2) AS "LARGE" FROM long GROUP BY 1""")
def merged_groups(spark, folder):
    merged = b.group_sums(spark, folder).withColumn("grp", scalar.roll_up("grp", b.CLASSES))
    wide = reshape.to_wide(merged, ["sample"], "grp", "value", ["SMALL_MEDIUM", "LARGE"], 0.0, F.sum)
    return wide.select("sample", tidy("SMALL_MEDIUM", 2).alias("SMALL_MEDIUM"), tidy("LARGE", 2).alias("LARGE"))


@query("grouped_sum", "A1", L + """
SELECT site, sample, grp, round(sum(value), 2) AS value FROM long GROUP BY ALL""")
def grouped_sum(spark, folder):
    return b.group_sums(spark, folder).select("site", "sample", "grp", tidy("value", 2).alias("value"))


@query("share_of_sample", "W1", L + """,
g AS (SELECT sample, grp, sum(value) AS v FROM long GROUP BY ALL)
SELECT sample, grp, round(v / sum(v) OVER (PARTITION BY sample), 6) AS prop FROM g""")
def share_of_sample(spark, folder):
    out = shares.share_of_total(b.group_sums(spark, folder), ["sample"], "value")
    return out.select("sample", "grp", tidy("prop").alias("prop"))


@query("by_product_report", "A2 W1 F6", L + """,
g AS (SELECT site, sample, grp, sum(value) AS v FROM long GROUP BY ALL),
s AS (SELECT site, grp, v / sum(v) OVER (PARTITION BY sample) AS prop FROM g)
SELECT site, grp, round(avg(prop), 6) AS prop FROM s WHERE grp IN ('PROMO', 'SMALL') GROUP BY ALL""")
def by_product_report(spark, folder):
    report = shares.share_report(b.group_sums(spark, folder), within=["site", "sample"], by=["site", "grp"],
                                 value="value", labels=["PROMO", "SMALL"])
    return report.withColumn("prop", tidy("prop"))


@query("area_share_report", "W2 P11", """
WITH t AS (SELECT n_name AS site, p_type AS "window", sum(l_extendedprice) AS tot
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT site, "window", round(CASE WHEN "window" = 'PROMO' THEN 0 ELSE tot * 100 /
  sum(CASE WHEN "window" <> 'PROMO' THEN tot END) OVER (PARTITION BY site) END, 5) AS ave_area_prop FROM t""")
def area_share_report(spark, folder):
    sums = b.group_sums(spark, folder)
    out = shares.area_share(sums, file_key="site", window="grp", excluded="PROMO", value="value")
    return out.select("site", F.col("grp").alias("window"), tidy("ave_area_prop", 5).alias("ave_area_prop"))


@query("share_across_samples", "M21 W1", L + """,
g AS (SELECT comp, sample, sum(value) AS v FROM long GROUP BY ALL),
s AS (SELECT comp, sample, v / sum(v) OVER (PARTITION BY comp) AS a FROM g),
h AS (SELECT comp, sample, sqrt(a / sum(a) OVER (PARTITION BY sample)) AS h FROM s)
SELECT comp, sample, round(h, 6) AS h FROM h""")
def share_across_samples(spark, folder):
    lines = b.purchases(spark, folder).join(b.annotation(spark, folder), "window")
    out = profiles.across_samples(lines, component="comp", sample="sample", value="value")
    return out.select("comp", "sample", tidy("h").alias("h"))


@query("hellinger_profiles", "M1 W1", P + """
SELECT sample, round(sqrt("ECONOMY"), 6) AS "ECONOMY", round(sqrt("LARGE"), 6) AS "LARGE",
       round(sqrt("SMALL_MEDIUM"), 6) AS "SMALL_MEDIUM", round(sqrt("STANDARD"), 6) AS "STANDARD" FROM profiles""")
def hellinger_profiles(spark, folder):
    out = shares.hellinger(b.profiles(spark, folder), b.GROUPS)
    return out.select("sample", *[tidy(g).alias(g) for g in b.GROUPS])


@query("share_chain_long", "W1 A1 P7 F6 R1 U1", P + """
SELECT sample, grp, round(prop, 6) AS prop FROM (
  UNPIVOT profiles ON "ECONOMY", "LARGE", "SMALL_MEDIUM", "STANDARD" INTO NAME grp VALUE prop)
WHERE prop > 0""")
def share_chain_long(spark, folder):
    out = profiles.shares_long(b.group_sums(spark, folder), ids=["sample"], drop=b.DROP, classes=b.CLASSES)
    return out.select("sample", "grp", tidy("prop").alias("prop"))


@query("ready_made_rows", "U1 N15", P + """
SELECT sample, site, round("ECONOMY", 6) AS "ECONOMY", round("LARGE", 6) AS "LARGE" FROM profiles
UNION ALL SELECT sample, NULL, round(e / (e + l), 6), round(l / (e + l), 6) FROM (
  SELECT user_id AS sample, sum(value) FILTER (event_type = 'click') AS e,
         sum(value) FILTER (event_type = 'view') AS l FROM events GROUP BY 1)""")
def ready_made_rows(spark, folder):
    ev = b.table(spark, folder, "events").groupBy(F.col("user_id").alias("sample")).agg(
        F.sum(F.when(F.col("event_type") == "click", F.col("value"))).alias("ECONOMY"),
        F.sum(F.when(F.col("event_type") == "view", F.col("value"))).alias("LARGE"))
    base = b.profiles(spark, folder).select("sample", "site", "ECONOMY", "LARGE")
    out = profiles.append_ready_made(base, ev, ["ECONOMY", "LARGE"], renormalise=True)
    return reshape.map_columns(out, tidy, columns=["ECONOMY", "LARGE"])


@query("metadata_merge", "J1 U1 F8 O2 P4", """
WITH env AS (SELECT c_custkey AS sample, c_nationkey AS nation, c_acctbal AS wc, NULL AS origin FROM customer
  UNION ALL SELECT s_suppkey, s_nationkey, s_acctbal, 'supplier' FROM supplier)
SELECT sample, origin, n_name AS site, r_name AS biome, round(wc / (n_regionkey + 1), 6) AS cn
FROM env LEFT JOIN nation ON nation = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def metadata_merge(spark, folder):
    c = b.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("sample"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("wc"))
    s = b.table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("sample"), F.col("s_nationkey").alias("nation"),
        F.col("s_acctbal").alias("wc"), F.lit("supplier").alias("origin"))
    n = reshape.rename(b.table(spark, folder, "nation"), nation="n_nationkey", site="n_name", region="n_regionkey")
    r = reshape.rename(b.table(spark, folder, "region"), region="r_regionkey", biome="r_name")
    env = union_padded(c, s)
    full = match(match(env, n, ["nation"]), r, ["region"])
    return full.select("sample", "origin", "site", "biome",
                       tidy(nulls.ratio("wc", F.col("region") + 1)).alias("cn"))
