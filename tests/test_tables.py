"""Joins, ordered kernels, shares, aggregates and reconciliation on edge rows and skewed keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from profilar.operators import aggregate, effects, joins, ordered, profiles, reconcile, reshape, shares


@pytest.fixture(scope="module")
def skewed(spark):
    """6000 rows; one key holds most of them, one order value repeats heavily, keys may be missing."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(6000):
        key = "hot" if i % 3 else [None, "a", "b"][i % 9 // 3]
        rows.append((i, key, int(rng.integers(0, 40)) if i % 2 else 7, float(rng.integers(0, 500))))
    return spark.createDataFrame(rows, "id bigint, k string, t int, v double").cache()


def test_running_total_and_sequence(skewed):
    pdf = skewed.toPandas().sort_values(["t", "id"])
    pdf["k"] = pdf["k"].fillna("-")
    want = dict(zip(pdf["id"], pdf.groupby("k")["v"].cumsum()))
    got = ordered.running_total(skewed, ["k"], ["t", "id"], {"s": "v"}, range_rows=400)
    assert {r["id"]: r["s"] for r in got.collect()} == want
    seq = ordered.sequence_in_group(skewed, [], ["t", "id"], range_rows=700)
    ranks = {r["id"]: r["seq"] for r in seq.collect()}
    assert [ranks[i] for i in pdf["id"]] == list(range(1, 6001))


@pytest.mark.parametrize("na,want", [("skip", [None, 2.0, 2.0, 3.0]), ("propagate", [None] * 4)])
def test_running_total_of_few_rows(spark, na, want):
    df = spark.createDataFrame([("a", 0, None), ("a", 1, 2.0), ("a", 2, None), ("a", 3, 1.0)], "k string, t int, v double")
    got = [r["s"] for r in ordered.running_total(df, ["k"], ["t"], {"s": "v"}, na=na).orderBy("t").collect()]
    assert got == want


@pytest.mark.parametrize("na", ["skip", "propagate"])
@pytest.mark.parametrize("range_rows", [100, 5000])
def test_running_total_with_missing_values(spark, na, range_rows):
    rows = [("ab"[i % 2], i, None if i % 3 == 0 and i > 600 else float(i % 7)) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    got = {r["t"]: r["s"] for r in ordered.running_total(df, ["k"], ["t"], {"s": "v"}, na=na, range_rows=range_rows).collect()}
    totals, gone, want = {"a": 0.0, "b": 0.0}, set(), {}
    for k, t, v in rows:
        totals[k] += v or 0.0
        gone |= {k} if v is None else set()
        want[t] = None if na == "propagate" and k in gone else totals[k]
    assert got == want


def test_ranges_are_bounded_in_number(skewed, monkeypatch):
    """What reaches the driver grows with the ranges, so that larger tables get larger ones."""
    monkeypatch.setattr(ordered, "MAX_RANGES", 20, raising=False)
    pdf = skewed.toPandas().sort_values(["t", "id"])
    pdf["k"] = pdf["k"].fillna("-")
    tagged = ordered._in_ranges(skewed, ["t", "id"], 10)
    assert 10 < tagged.select("__block").distinct().count() <= 20 and tagged.count() == 6000
    got = ordered.running_total(skewed, ["k"], ["t", "id"], {"s": "v"}, range_rows=10)
    assert {r["id"]: r["s"] for r in got.collect()} == dict(zip(pdf["id"], pdf.groupby("k")["v"].cumsum()))


def test_quantiles_match_numpy(skewed):
    probs = [0.0, 0.1, 1 / 3, 0.5, 0.77, 1.0]
    names = [f"q{i}" for i in range(6)]
    got = ordered.quantiles(skewed, ["k"], "v", probs, names).collect()
    pdf = skewed.toPandas()
    for r in got:
        part = pdf[pdf["k"].isna() if r["k"] is None else pdf["k"] == r["k"]]["v"]
        assert [r[n] for n in names] == pytest.approx(list(np.quantile(part, probs)))
    sketch = ordered.quantiles(skewed, ["k"], "v", [0.5], ["m"], exact=False)
    assert sketch.count() == len(got)


def test_bins(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 10)], "x double")
    got = ordered.quantile_bin(df, "x", 3, "b").orderBy("x").collect()
    assert [r["b"] for r in got] == [1, 1, 1, 2, 2, 2, 3, 3, 3]
    assert got[0]["b_label"] == "(0.992,3.67]"
    same = spark.createDataFrame([(1.0,)] * 5 + [(2.0,)], "x double")
    with pytest.raises(ValueError):
        ordered.quantile_breaks(same, "x", 3)


def test_edges_and_levels(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), (None, 5)], "k string, t int")
    assert sorted(map(tuple, ordered.extreme_rows(df, ["k"], "t").collect()), key=str) == [("a", 1), ("a", 1), (None, 5)]
    lev = ordered.at_level_order(df, "k", ["z", "a"], order_name="o").where("t = 2 or t = 5").orderBy("t").collect()
    assert [(r["k"], r["o"]) for r in lev] == [("a", 2), (None, None)]
    assert ordered.used_levels(df, "k", ["z", "a"]) == ["a"]


def test_joins(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "k string, v int")
    right = spark.createDataFrame([("a", 10), (None, 20)], "k string, w int")
    got = {r["v"]: r["w"] for r in joins.natural_left(left, right, ["k"]).collect()}
    assert got == {1: 10, 2: 20, 3: None}
    with pytest.raises(ValueError):
        joins.natural_left(left, right.withColumn("v", F.lit(1)), ["k"])
    cells = spark.createDataFrame([("s1", "ctl", 1.0), ("s1", "n", 2.0), ("s2", "n", 3.0)], "site string, trt string, m double")
    base = joins.control_baseline(cells, by=["site"], treatment="trt", control="ctl", values={"m": "c"})
    assert sorted(map(tuple, base.select("site", "c").collect()), key=str) == [("s1", 1.0), ("s2", None)]
    many = spark.createDataFrame([("s", "ctl", 1), ("s", "n1", 2), ("s", "n2", 3), ("u", "ctl", 4)], "site string, trt string, id int")
    rep = joins.replicate_control(many, site="site", treatment="trt", control="ctl", label="trt", out="g")
    assert sorted((r["id"], r["g"]) for r in rep.collect()) == [(1, "s_n1"), (1, "s_n2"), (2, "s_n1"), (3, "s_n2")]
    with pytest.raises(ValueError):
        joins.union_strict(left, right)


def test_outer_merges(spark):
    a = spark.createDataFrame([(1, 1, "x"), (2, 1, "y")], "rt int, rep int, comp string")
    b = spark.createDataFrame([(2, 1, "z"), (3, 1, "w")], "rt int, rep int, comp string")
    wide = joins.outer_by_source({"A": a, "B": b}, ["rt", "rep"], "comp")
    chain = joins.outer_chain([a.withColumnRenamed("comp", "A"), b.withColumnRenamed("comp", "B")], ["rt", "rep"])
    assert sorted(map(tuple, wide.collect()), key=str) == sorted(map(tuple, chain.collect()), key=str)


def test_reconciliation(spark):
    lists = spark.createDataFrame(
        [("A", "p", "g1"), ("A", "p", "g1"), ("B", "p", "g2"), ("A", "q", "g1"), ("B", "q", "g1"), ("A", "r", "unk")],
        "source string, comp string, grp string")
    got = reconcile.disagreement_report(lists, ["A", "B"]).collect()
    assert [(r["comp"], r["A"], r["B"], r["n_labels"]) for r in got] == [("p", "g1", "g2", 2)]
    times = spark.createDataFrame([("A", "W1", 10.5), ("A", "W2", 9.6), ("B", "W9", 10.4), ("B", "W8", 11.5)],
                                  "source string, w string, rt double")
    wide = reconcile.align_by_time(times, ["A", "B"], source="source", time="rt", order="w", values=["w"])
    assert sorted(map(tuple, wide.collect())) == [(10.0, 1, "W1", "W9"), (10.0, 2, "W2", ""), (12.0, 1, "", "W8")]


def test_shares_rules(spark):
    df = spark.createDataFrame(
        [("s", None, 2.0), ("s", "g", 2.0), ("s", "unk", 6.0), ("z", "g", 0.0), ("m", "g", None)],
        "sample string, grp string, value double")
    long = profiles.shares_long(df, ids=["sample"])
    assert sorted(map(tuple, long.collect()), key=str) == [
        ("m", "g", None), ("s", "g", 0.5), ("s", None, 0.5), ("z", "g", None)]
    table = {r["sample"]: (r["g"], r["rest"]) for r in profiles.profile_table(
        df, ids=["sample"], groups=["g"], missing="rest").collect()}
    assert table == {"s": (0.5, 0.5), "z": (None, None), "m": (None, None)}
    extra = profiles.profile_table(df, ids=["sample"], groups=["g"], extra={"n": F.count(F.lit(1))})
    assert {r["sample"]: (r["g"], r["n"]) for r in extra.collect()} == {"s": (0.5, 3), "z": (None, 1), "m": (None, 1)}


def test_shares_sum_to_one(spark, skewed):
    merged = skewed.groupBy("k", "t").agg(F.sum("v").alias("v"))
    for r in shares.share_of_total(merged, ["k"], "v").groupBy("k").agg(F.sum("prop").alias("p")).collect():
        assert r["p"] == pytest.approx(1.0)


def test_statistics(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("c", None), ("c", 1.0)], "k string, v double")
    got = {r["k"]: (r["M"], r["N"], r["SD"]) for r in aggregate.summarise(df, ["k"], ["v"], ["M", "N", "SD"]).collect()}
    assert got == {"a": (2.0, 2, pytest.approx(2 ** 0.5)), "b": (2.0, 1, None), "c": (None, 1, None)}
    assert aggregate.uniqueness(df, ["k"]).first()["is_unique"] is False
    with pytest.raises(ValueError):
        aggregate.assert_unique(df, ["k"])
    best = aggregate.row_of_extreme(df, "v").first()
    assert (best["k"], best["v"]) == ("a", 3.0)


def test_box_statistics(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 100)], "k string, v double")
    r = aggregate.box_statistics(df, ["k"], "v").first()
    assert (r["q1"], r["median"], r["q3"], r["lower_whisker"], r["upper_whisker"], r["n_outliers"]) == (2, 3, 4, 1, 4, 1)
    assert aggregate.box_outliers(df, ["k"], "v").first()["v"] == 100


def test_effect_sizes(spark):
    cells = spark.createDataFrame(
        [("s", "ctl", "s_ctl", 2.0, 4, 1.0), ("s", "n", "s_n", 3.0, 5, 1.5), ("u", "n", "u_n", 3.0, 5, 1.5)],
        "site string, treatment string, trt_id string, M double, N bigint, SD double")
    pair = effects.pair_with_control(cells, control="ctl")
    rom = {r["trt_id"]: r for r in effects.effect_size(pair, "ROM").collect()}
    assert rom["s_n"]["yi"] == pytest.approx(np.log(1.5))
    assert rom["s_n"]["vi"] == pytest.approx(2.25 / 45 + 1 / 16)
    assert rom["u_n"]["yi"] is None
    md = {r["trt_id"]: r for r in effects.effect_size(pair, "MD").collect()}
    assert md["s_n"]["vi"] == pytest.approx(2.25 / 5 + 1 / 4)


def test_area_share(spark):
    wide = spark.createDataFrame(
        [("s", "W1", 1.0, 50, 70), ("s", "W2", 2.0, 10, 20), ("s", "W3", 3.0, 30, 40), ("t", "W2", 2.0, 5, 5)],
        "site string, Window string, RT_s double, X1 bigint, X1_1 bigint")
    long = reshape.to_long(wide, ["site", "Window", "RT_s"], reshape.starting_with(wide, "X"))
    got = shares.area_share(long, file_key="site", window="Window", excluded="W1", value="value", carry=["RT_s"])
    assert sorted(map(tuple, got.collect())) == [
        ("s", "W1", 1.0, 0.0), ("s", "W2", 2.0, 30.0), ("s", "W3", 3.0, 70.0), ("t", "W2", 2.0, 100.0)]
