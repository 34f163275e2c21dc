"""Missing-value rules, scalar functions and file readers on hand-made rows."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilar.functions import nulls, scalar
from profilar.sources import files, sinks


def one(df):
    return df.first()[0]


def values(spark, column, *rows):
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    return [r[0] for r in df.select(column).collect()]


def test_membership_and_missing(spark):
    assert values(spark, nulls.not_in("x", ["a"]), "a", "b", None) == [False, True, True]
    assert values(spark, nulls.is_in("x", ["a"]), "a", "b", None) == [True, False, False]
    assert values(spark, nulls.if_else(F.col("x") == "a", F.lit(1), F.lit(2)), "a", "b", None) == [1, 2, None]
    assert values(spark, nulls.paste(F.lit("p"), "x"), "a", None) == ["p_a", "p_NA"]
    assert values(spark, scalar.blank_if_missing("x"), "a", None) == ["a", ""]


def test_ids_and_text(spark):
    assert values(spark, scalar.normalise_id("x", "X|_."), "X273_1", "X007", "Xab", None) == ["273", "7", None, None]
    assert values(spark, scalar.normalise_id("x", "X"), "X268_1", "X001") == [None, "1"]
    assert values(spark, scalar.capitalise_words("x"), "abc dEF", "a") == ["Abc DEF", "A"]
    assert values(spark, scalar.capitalise_words("x", strict=True), "abc dEF") == ["Abc Def"]
    assert values(spark, scalar.name_part("x", 3), "Peaks_east_AA.csv", "short") == ["AA", None]
    assert values(spark, scalar.roll_up("x", {"C": ["a", "b"]}), "a", "z", None) == ["C", "z", None]
    assert values(spark, scalar.map_values("x", {"a": "A"}), "a", "z", None) == ["A", "z", None]


def test_numbers(spark):
    df = spark.createDataFrame([(2.5, 0.0, -1.0)], "a double, b double, c double")
    row = df.select(nulls.ratio("a", "b"), nulls.log_of("b"), nulls.log_of("c"), scalar.round_half_even("a"),
                    scalar.log_ratio_to_percent(F.lit(0.0)), scalar.cube_root(F.lit(27.0))).first()
    assert row[:3] == (None, None, None) and row[3] == 2.0 and row[4] == 0.0 and row[5] == pytest.approx(3.0)
    grid = [r[0] for r in scalar.number_grid(spark, 0, 1, step=0.1).orderBy("x").collect()]
    assert len(grid) == 11 and grid[-1] == pytest.approx(1.0)


def test_marks(spark):
    df = spark.createDataFrame([(p,) for p in (0.0, 0.001, 0.0099, 0.01, 0.05, 0.1, 1.0, None)], "p double")
    got = [r[0] for r in df.select(scalar.significance_mark("p", dagger=False, ns="ns")).collect()]
    assert got == ["***", "**", "**", "*", ".", "ns", None, None]


def test_na_rule_in_summaries(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0)], "k string, v double")
    got = {r["k"]: (r["s"], r["l"]) for r in df.groupBy("k").agg(
        nulls.summary(F.sum, "v").alias("s"), nulls.summary(F.sum, "v", "skip").alias("l")).collect()}
    assert got == {"a": (None, 1.0), "b": (2.0, 2.0)}
    with pytest.raises(ValueError):
        nulls.shared_keys(df, df.withColumnRenamed("v", "w"), ["v"])


def test_csv_traits(spark, tmp_path):
    text = "﻿id,Window,Comp,Group\r\n1,W1,\"a, b\",α-x\r\n2,W2,,\r\n"
    path = tmp_path / "Peaks_east_AA.csv"
    path.write_bytes(text.encode("utf-8"))
    df = files.read_csv(spark, str(path), "id int, Window string, Comp string, Group string")
    rows = {r["Window"]: (r["Comp"], r["Group"]) for r in df.collect()}
    assert rows == {"W1": ("a, b", "α-x"), "W2": (None, None)}
    tagged = files.read_folder(spark, str(tmp_path), "Peaks_east*", df.schema, {"kind": 2, "site": 3})
    assert {(r["kind"], r["site"]) for r in tagged.collect()} == {("east", "AA")}


def test_whitespace_table(spark, tmp_path):
    path = tmp_path / "spectra.txt"
    path.write_text('"Window"  "RT_s" X1\nW1 10.5   7\n  "W 2"\t11 NA\n')
    schema = T.StructType().add("Window", "string").add("RT_s", "double").add("X1", "long")
    assert files.whitespace_header(spark, str(path)) == ["Window", "RT_s", "X1"]
    rows = sorted(tuple(r) for r in files.read_whitespace(spark, str(path), schema).collect())
    assert rows == [("W 2", 11.0, None), ("W1", 10.5, 7)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5)], "k string, v int")
    sinks.write_csv_per_key(df, str(tmp_path / "out"), "k", row_names=["v"])
    back = files.read_csv(spark, str(tmp_path / "out"), "row int, v int, k string")
    assert sorted(map(tuple, back.collect())) == [(1, 1, "a"), (1, 5, "b"), (2, 2, "a")]
    sinks.write_results({"t": df}, str(tmp_path / "res"))
    assert files.read_results(spark, str(tmp_path / "res"), "t").count() == 3
    assert os.path.isdir(tmp_path / "out" / "k=a")
