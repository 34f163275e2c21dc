"""Large keys beside a NULL key in one batch: every operator returns them unchanged."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from profilar.llm import bpe, decontaminate, language, line_dedup, quality, sharding, simhash, token_counts
from profilar.llm.queries import VOCABULARY
from tests.llm.conftest import DOCS

BIG = 1 << 60
KEYS = [None, *range(BIG, BIG + 6)]
ITEM = "seven small words that make one item of a benchmark here"


@pytest.fixture(scope="module")
def keyed(spark):
    texts = ["a text without a key and nothing else to say", "one plain text about the weather of the day and the sea",
             f"before {ITEM} after", "a wholly different text about ships and harbours at night", None, "",
             "yet another text of some words that nobody wrote before"]
    return spark.createDataFrame([(k, t, "en", "s", 1) for k, t in zip(KEYS, texts)], DOCS).coalesce(1)


def vocabulary():
    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


@pytest.mark.parametrize("work", [
    lambda d: token_counts.section_tokens(d, *vocabulary()), lambda d: bpe.digests(d.select("doc_id", "text"), *vocabulary()),
    lambda d: simhash.groups(d).withColumnRenamed("key", "doc_id"), lambda d: line_dedup.remove_repeated_lines(d),
    lambda d: sharding.assign(d, "doc_id", {0: 1.0, 1: 1.0}), lambda d: language.identify(d, F.lit(True)),
    lambda d: quality.score(d, quality.train(d, d.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")))])
def test_keys_come_back(keyed, work):
    assert {r["doc_id"] for r in work(keyed).select("doc_id").collect()} == set(KEYS)


def test_components_keep_large_keys(spark, keyed):
    assert {r["doc_id"] for r in simhash.keep_one(keyed).collect()} == set(KEYS) - {BIG + 4}  # an empty text is a NULL's copy
    copies = keyed.union(spark.createDataFrame([(BIG + 9, "a wholly different text about ships and harbours at night", "en", "s", 1)], DOCS))
    found = {r["key"]: r["component"] for r in simhash.groups(copies.coalesce(1)).collect()}
    assert found[BIG + 9] == found[BIG + 2] == BIG + 2 and found[BIG + 1] == BIG + 1 and found[None] is None


def test_the_item_is_found_in_its_document(spark, keyed):
    bench = spark.createDataFrame([(BIG + 1, ITEM), (None, "something else entirely that no text here holds at all")], "item_id long, text string")
    assert [(r["key"], r["item"]) for r in decontaminate.matches(keyed, bench.coalesce(1)).collect()] == [(BIG + 1, BIG + 1)]
    assert {r["doc_id"] for r in decontaminate.remove_contaminated(keyed, bench).collect()} == set(KEYS) - {BIG + 1}


def test_every_stage_keeps_the_keys(spark, keyed):
    docs = keyed
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert {r["doc_id"] for r in docs.collect()} == set(KEYS) - {BIG + 3, BIG + 4}  # no letter


def test_links_through_a_fingerprint_without_keys(spark):
    """Two keyed fingerprints that meet only through a third one, whose rows have no key, are one group."""
    points = {0x0F: 3, 0xFF: None, 0xFFF: 1, 0xFFFF << 20: 2}
    rows = [(k, fp) for fp, k in points.items()]
    plain = simhash.fingerprints
    simhash.fingerprints = lambda docs, *a: docs
    try:
        found = simhash.groups(spark.createDataFrame(rows, "key long, fp long"))
        assert {(r["fp"], r["component"]) for r in found.collect()} == {(0x0F, 1), (0xFF, 1), (0xFFF, 1), (0xFFFF << 20, 2)}
    finally:
        simhash.fingerprints = plain
