"""Inverted multi-index: traversal order, recall against brute force, edge rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from profilar.llm import vector_index as vi


def brute(rows, k):
    """Nearest other ids of the queries, ties to the smaller id."""
    x = np.array([v for _, v in rows], dtype=float)
    out = {}
    for i, v in rows:
        if i % 100 == 0:
            d = np.sqrt(((x - np.array(v)) ** 2).sum(axis=1))
            out[i] = sorted((s, j) for s, (j, _) in zip(d, rows) if j != i)[:k]
    return out


def test_cells_come_in_ascending_order():
    rng = np.random.default_rng(3)
    a, b, sizes = rng.random(7), rng.random(5), rng.integers(0, 4, (7, 5))
    order = vi.visit(a, b, sizes, sizes.sum())
    sums = [a[i] + b[j] for i, j in order]
    assert sums == sorted(sums) and sorted(order) == sorted(zip(*map(list, np.nonzero(sizes))))
    half = vi.visit(a, b, sizes, sizes.sum() / 2)
    assert order[:len(half)] == half and sum(sizes[c] for c in half) >= sizes.sum() / 2 > sum(sizes[c] for c in half[:-1])


def test_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    want = brute(rows, 10)
    found = vi.nearest(vectors, F.col("vec_id") % 100 == 0, block=64).collect()
    assert len(found) == 10 * len(want)
    hits = 0
    by_query = {}
    for r in found:
        by_query.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q, near in by_query.items():
        near.sort()
        assert [n[0] for n in near] == list(range(1, 11)) and [n[2] for n in near] == sorted(n[2] for n in near)
        hits += len({n[1] for n in near} & {j for _, j in want[q]})
        exact = dict((j, s) for s, j in brute(rows, len(rows))[q])
        assert all(n[2] == pytest.approx(exact[n[1]], abs=1e-12) for n in near)
    assert hits / len(found) >= 0.9


def test_copies_ties_and_unusable_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.normal(size=5)]) for k in range(80)]
    same = [1.0, 2.0, 3.0, 4.0, 5.0]
    rows += [(k, same) for k in range(100, 160)] + [(300, same), (400, rows[3][1])]
    odd = [(500, None), (501, [0.0] * 5), (502, [1.0, None, 2.0, 3.0, 4.0]), (503, [float("nan")] * 5), (None, same), (600, []),
           (700, [1.0, 2.0]), (800, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows + odd + rows[:3], "vec_id long, embedding array<double>").withColumn("point", F.lit("clash"))
    found = vi.nearest(df, F.col("vec_id") % 100 == 0, k=10, target=1.0).collect()
    want = brute(rows, 10)
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(got) == set(want)
    assert got[100] == [101, 102, 103, 104, 105, 106, 107, 108, 109, 110] and got[300] == list(range(100, 110))
    assert got[400][0] == 3
    few = vi.nearest(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 100 == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2]
    assert vi.nearest(df.where("vec_id = 0"), F.lit(True)).count() == 0
    assert vi.nearest(df.where("false"), F.lit(True)).count() == 0


def test_blocks_are_bounded_and_whole():
    sizes = np.array([[3, 0, 25, 1, 1], [0, 0, 0, 0, 0]])
    first, pieces = vi.dealt(sizes, 10)
    assert first.tolist() == [[0, 0, 0, 2, 2], [0] * 5] and pieces.tolist() == [[1, 1, 3, 1, 1], [1] * 5]
    assert [vi.centroid_count(n) for n in (0, 1000, 10 ** 6, 10 ** 12)] == [64, 64, 100, 1024]


@pytest.mark.parametrize("block", [32, 4096])
def test_clustered_vectors_are_pruned(spark, block):
    """Few entries are visited where vectors have clusters, whatever the size of blocks and parts."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16)) * 4
    x = centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 16))
    x[:2000] = centres[0] + rng.normal(size=(2000, 16)) * 0.2  # a dense cell
    df = spark.createDataFrame([(n, v) for n, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found = vi.nearest(df, F.col("vec_id") % 100 == 0, block=block).collect()
    want = brute(list(enumerate(x.tolist())), 10)
    assert len(found) == 600
    assert sum(r["vec_id"] in {j for _, j in want[r["query_id"]]} for r in found) / 600 >= 0.9
    assert np.mean([r["visited"] for r in found]) < 0.5
    assert len({(r["query_id"], r["rank"]) for r in found}) == 600
