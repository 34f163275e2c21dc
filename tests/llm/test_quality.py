"""Boosted trees: flat traversal against a walk, histograms against exact sums, held-out accuracy."""

import numpy as np
from pyspark.sql import functions as F

from profilar.llm import quality


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(quality.FEATURES)))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    model = quality.fit(x, y, trees=8)
    for row, score in zip(x[:50], model.score(x[:50])):
        total = model.start
        for t in range(8):
            at = 0
            for _ in range(model.depth):
                f = model.feature[t, at]
                at = 2 * at + 1 + int((model.edges[f] <= row[f]).sum() > model.cut[t, at])
            total += model.leaf[t, at - (1 << model.depth) + 1]
        assert abs(1 / (1 + np.exp(-total)) - score) < 1e-12
    assert ((quality.fit(x, y).score(x) > 0.5) == y).mean() > 0.97


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3))
    y = (x[:, 1] > 0.3).astype(float)
    model = quality.fit(x, y, trees=1, depth=1)
    binned, g, prior = model.bins(x), y.mean() - y, quality.PRIOR
    p = 1 / (1 + np.exp(-model.start))
    g, h = p - y, p * (1 - p)
    gains = {}
    for f in range(3):
        for c in range(quality.BINS):
            left = binned[:, f] <= c
            gains[f, c] = g[left].sum() ** 2 / (h * left.sum() + prior) + g[~left].sum() ** 2 / (h * (~left).sum() + prior)
    assert gains[model.feature[0, 0], model.cut[0, 0]] == max(gains.values())


def test_held_out_accuracy(docs, spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = quality.train(docs, labels.where(~held))
    rows = quality.score(docs, model).join(labels, "doc_id").where(held).collect()
    good = [r["score"] for r in rows if r["quality"] == 1]
    poor = [r["score"] for r in rows if r["quality"] == 0]
    area = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in poor])
    assert area > 0.9 and all(0 <= r["score"] <= 1 for r in rows)


def test_edges(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(3, 1), (3, 0), (5, 0), (None, 1), (9, None), (77, 1)], "doc_id long, quality int")
    model = quality.train(odd_docs, labels)
    rows = quality.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    none = quality.train(odd_docs, labels.where("false"))
    assert {r["score"] for r in quality.score(odd_docs, none).collect()} == {0.5}
    assert quality.score(no_docs, model).count() == 0
    assert len(quality.statistics(None)) == len(quality.FEATURES) and np.isfinite(quality.statistics("")).all()


def test_repeated_keys_train_as_one_row_each(spark, monkeypatch):
    docs = spark.range(4000).selectExpr("cast(id % 3 as bigint) AS doc_id", "concat('text ', id) AS text")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    fitted = []
    monkeypatch.setattr(quality, "fit", lambda x, y: fitted.append((x, y)))
    for _ in range(2):
        quality.train(docs.repartition(5), labels, sample=2)
    assert len(fitted[0][1]) == 2 and (fitted[0][0] == fitted[1][0]).all()
