"""Benchmark matches against a plain dynamic programme over all pairs."""

import random

import numpy as np
import pytest

from profilar.llm import decontaminate as dec


def least_distance(item, words):
    """Least edit distance of the item to any stretch of words."""
    row = [0] * (len(words) + 1)
    for k, w in enumerate(item, 1):
        new = [k]
        for j, x in enumerate(words, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edit(rnd, words, n):
    words = list(words)
    for _ in range(n):
        at, kind = rnd.randrange(len(words)), rnd.randrange(3)
        words[at:at + (kind != 1)] = [] if kind == 2 else [f"new{rnd.randrange(10 ** 6)}"]
    return words


@pytest.fixture(scope="module")
def planted():
    rnd = random.Random(11)
    vocabulary = [f"w{k}" for k in range(300)]
    prose = lambda n: [rnd.choice(vocabulary[:20] if rnd.random() < 0.5 else vocabulary) for _ in range(n)]
    items = {k: prose(rnd.choice([1, 3, 5, 9, 16, 25, 40, 59])) for k in range(40)}
    texts, edits = {}, {}
    for d in range(220):
        body = prose(rnd.randrange(0, 200))
        if d % 2:
            k = rnd.choice(list(items))
            n = rnd.randint(0, len(items[k]) // 5)
            at = rnd.randrange(len(body) + 1)
            body[at:at] = edit(rnd, items[k], n)
        texts[d] = body
    return items, texts


def test_matches_by_brute_force(spark, planted):
    items, texts = planted
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    want = {(d, k): x for d, words in texts.items() for k, item in items.items()
            if (x := least_distance(item, words)) <= int(0.2 * len(item) + 1e-9)}
    for block in (20_000, 15):  # one block and several
        rows = dec.matches(docs, bench, block_items=block).collect()
        found = {(r["key"], r["item"]): r for r in rows}
        assert len(found) == len(rows)
        assert set(found) <= set(want) and len(found) >= 0.99 * len(want)
        for (d, k), r in found.items():
            assert r["distance"] == want[d, k] and r["similarity"] == pytest.approx(1 - r["distance"] / len(items[k]))
            stretch = texts[d][r["start_word"]:r["end_word"]]
            row = dec.edit_row(np.array([hash(w) for w in items[k]]), np.array([hash(w) for w in stretch]))
            assert row[-1] <= r["distance"]
    left = {r["doc_id"] for r in dec.remove_contaminated(docs, bench).collect()}
    assert left == set(texts) - {d for d, _ in found}


def test_items_below_target_are_searched_whole(planted, monkeypatch):
    items, texts = planted
    monkeypatch.setattr(dec, "MAX_TABLES", 0)
    index = dec.Index(list(items.items()))
    assert set(index.recall.values()) == {0.0}
    keys = list(texts)
    found = {(keys[o], index.ids[k]): d for o, k, _, _, d in index.search([index.symbols_of(" ".join(texts[d])) for d in keys])}
    want = {(d, i): n for d, words in texts.items() for i, item in items.items() if (n := least_distance(item, words)) <= len(item) // 5}
    assert found == want


def test_words_in_bounded_lists(monkeypatch):
    text = "Ab c_d  é1, ä-ö\n" * 50
    whole = dec.all_words(text)
    for size in (1, 7, 30):
        monkeypatch.setattr(dec, "TEXT_CHUNK", size)
        assert dec.all_words(text) == whole
    assert whole[:5] == ["ab", "c_d", "é1", "ä", "ö"]


def test_edges(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "a b c d e f g h i"), (1, "a b c d e f g h i"), (2, None), (3, "!!"), (4, ""),
                                   (None, "THE text, of no key"), (5, "word " * 50)], "item_id long, text string")
    rows = {(r["key"], r["item"]) for r in dec.matches(odd_docs, bench).collect()}
    assert rows == {(3, 1), (None, None), (5, 5)}
    left = dec.remove_contaminated(odd_docs, bench)
    assert sorted(r["doc_id"] for r in left.collect() if r["doc_id"]) == [1, 2, 4, 6, 7, 8, 9]
    assert left.where("doc_id is null").count() == 1 and set(left.columns) == set(odd_docs.columns)
    assert dec.matches(no_docs, bench).count() == 0
    assert dec.matches(odd_docs, bench.where("false")).count() == 0
