"""Rendezvous shards: few moves, weights, gapless slots."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from profilar.llm import sharding


def shards(spark, n, weights):
    return [r[0] for r in spark.range(n).select(sharding.shard_for(F.col("id"), weights)).collect()]


def test_a_new_shard_only_takes(spark):
    before, after = (shards(spark, 20_000, dict.fromkeys(range(n), 1.0)) for n in (10, 11))
    moved = [(a, b) for a, b in zip(before, after) if a != b]
    assert {b for _, b in moved} == {10} and 0.07 < len(moved) / 20_000 < 0.11


def test_weights(spark):
    found = Counter(shards(spark, 40_000, {0: 1.0, 1: 2.0, 7: 5.0}))
    assert [round(found[s] / 5000) for s in (0, 1, 7)] == [1, 2, 5]
    heavier = shards(spark, 5_000, {0: 1.0, 1: 2.0, 7: 6.0})
    assert all(b == 7 for a, b in zip(shards(spark, 5_000, {0: 1.0, 1: 2.0, 7: 5.0}), heavier) if a != b)
    with pytest.raises(ValueError):
        sharding.shard_for(F.lit(1), {0: 0.0})


def test_slots_are_gapless_with_repeats_and_nulls(spark, odd_docs, no_docs):
    hot = spark.range(3000).select((F.col("id") % 3 * F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id"))).alias("doc_id"))
    for table in (odd_docs, hot):
        rows = sharding.assign(table, "doc_id", dict.fromkeys(range(5), 1.0)).collect()
        assert len(rows) == table.count()
        slots = defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(no_docs, "doc_id", {0: 1.0}).count() == 0
