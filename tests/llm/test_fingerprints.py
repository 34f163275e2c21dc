"""Fingerprints: levels, selection and comparison against plain versions; documents and the ones after them."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from profilar.llm import fingerprints as fp
from profilar.llm import queries
from tests.llm.conftest import DOCS

BIG = 1 << 60


def entropy(window):
    return -sum(n / len(window) * math.log2(n / len(window)) for n in Counter(window).values())


def plain_places(data, ranks):
    """Selected windows by looking at every stretch."""
    rank = [ranks[v] for v in fp.levels(np.frombuffer(data, dtype=np.uint8))]
    times = Counter(min(range(s, s + fp.SPAN), key=lambda p: (rank[p], p)) for s in range(len(rank) - fp.SPAN + 1))
    return sorted(p for p, n in times.items() if n >= fp.CHOSEN)


@pytest.fixture(scope="module")
def texts():
    random.seed(3)
    words = ["".join(random.choice("abcdefghijklmnopqrstuvwxyzäß é") for _ in range(random.randrange(2, 9))) for _ in range(400)]
    return [" ".join(random.choice(words) for _ in range(n)).encode() for n in (0, 1, 3, 8, 9, 20, 60, 200, 700)] + [b"a" * 500, b"ab" * 300, b""]


def test_levels_are_entropies(texts):
    for text in texts:
        got = fp.levels(np.frombuffer(text, dtype=np.uint8))
        want = [entropy(text[k:k + fp.WINDOW]) / math.log2(fp.WINDOW) * (fp.LEVELS - 1) for k in range(len(text) - fp.WINDOW + 1)]
        assert len(got) == len(want) and all(abs(g - w) <= 1.001 for g, w in zip(got, want))


def test_selection(texts, monkeypatch):
    ranks = fp.ranks_of(fp.level_counts(texts))
    whole = list(fp.features(texts, ranks))
    for text, found in zip(texts, whole):
        places = plain_places(text, ranks)
        windows = [text[p:p + fp.WINDOW] for p in places]
        if len(places) < fp.FEW:
            size = min(fp.SHORT, len(text))
            windows += [text[k:k + size] for k in range(len(text) - size + 1)] if text else []
        assert len(found) == len(set(windows)) == len(set(found.tolist()))
    assert all(np.array_equal(next(fp.features([t], ranks)), f) for t, f in zip(texts, whole))  # neighbours do not matter
    monkeypatch.setattr(fp, "BLOCK", 256)
    monkeypatch.setattr(fp, "BATCH_BYTES", 700)
    assert all(np.array_equal(a, b) for a, b in zip(fp.features(texts, ranks), whole))
    assert np.array_equal(fp.ranks_of(fp.level_counts(texts)), ranks)


def test_weak_levels_rank_last():
    ranks = fp.ranks_of(np.arange(fp.LEVELS)[::-1])
    weak = np.arange(fp.LEVELS) < fp.WEAK * (fp.LEVELS - 1)
    assert ranks[weak].min() > ranks[~weak].max() and ranks[fp.LEVELS - 1] == 0
    assert sorted(ranks) == list(range(fp.LEVELS))


def test_filters_hold_their_features():
    found = np.random.default_rng(1).integers(0, 1 << 63, size=500, dtype=np.uint64)
    made = fp.filters(found)
    assert made.shape == (4, fp.FILTER_BITS // 8) and np.array_equal(fp.read(fp.written(made)), made)
    bits = np.unpackbits(made, axis=1)
    for k, h in enumerate(found.tolist()):
        assert all(bits[k // fp.FILTER_FEATURES, (h >> (11 * j)) & 2047] for j in range(5))
    assert fp.filters(found[:0]).shape == (0, fp.FILTER_BITS // 8) and fp.written(fp.filters(found[:0])) == ""


def test_likeness(monkeypatch):
    random_hash = np.random.default_rng(2).integers(0, 1 << 63, size=2000, dtype=np.uint64)
    a, b, none = fp.filters(random_hash[:900]), fp.filters(random_hash[900:]), fp.filters(random_hash[:0])
    part = fp.filters(random_hash[:480])
    assert fp.likeness(a, a) == 1.0 == fp.likeness(none, none) and fp.likeness(a, none) == 0.0
    assert fp.likeness(part, a) == fp.likeness(a, part) == pytest.approx(1.0)
    assert fp.likeness(a, b) < 0.02 and fp.likeness(a, b) == fp.likeness(b, a)
    mixed = fp.filters(np.concatenate([random_hash[:450], random_hash[900:1350]]))
    whole = fp.likeness(a, mixed)
    assert 0.4 < whole < 0.7
    monkeypatch.setattr(fp, "FILTERS_AT_ONCE", 2)
    assert fp.likeness(a, mixed) == pytest.approx(whole)


def plain_rows(rows, ranks):
    """The query's rows, keys unique."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    print_ = lambda t: fp.filters(next(fp.features([t.encode()], ranks)))
    out = {}
    for (key, text), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        text, nxt = text or "", nxt or ""
        edited = text[:len(text) - len(text) // 4] + nxt[:len(text) // 4]
        out[key] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), fp.written(print_(text)), fp.written(print_(edited)),
                    fp.likeness(print_(text), print_(edited)), fp.likeness(print_(text), print_(nxt)))
    return out


def run(spark, rows, ranks):
    df = spark.createDataFrame([(k, t, None, "clash", 1) for k, t in rows], "doc_id long, text string, lang string, part string, key int")
    found = fp.with_next(df, "doc_id", "text", lambda texts: queries.edited_rows(texts, ranks), queries.EDITED)
    return [(r[0], tuple(r)[1:]) for r in found.collect()]


def test_query_equals_plain_version(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    ranks = fp.learn(docs)
    assert np.array_equal(ranks, fp.ranks_of(fp.level_counts([fp.encoded(t) for _, t in rows])))
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.fingerprints_query(spark, "/root/testdata/sf0.001").collect()}
    assert got == plain_rows(rows, ranks)


def test_odd_rows(spark, monkeypatch):
    ranks = fp.ranks_of(np.zeros(fp.LEVELS, dtype=np.int64))
    rows = [(None, "first of all by its NULL key"), (BIG + 1, "one text of a large key, a long one at that, with many words in it"), (BIG + 2, None),
            (3, ""), (4, "😀" * 9 + "é"), (-(1 << 63), "least"), (5, "word " * 60_000), (6, "x" * 20_000), (7, " \n\t ")]
    assert dict(run(spark, rows, ranks)) == plain_rows(rows, ranks)
    one = run(spark, [(1, "alone in its table")], ranks)
    assert len(one) == 1 and one[0][1][-1] == 1.0
    assert run(spark, [], ranks) == [] and len(fp.learn(spark.createDataFrame([], DOCS))) == fp.LEVELS
    same = run(spark, [(1, "the same row, many times over, in every range")] * 5000 + [(2, "another")], ranks)
    assert len(same) == 5001 and sum(r[1][-1] == 1.0 for r in same) == 4999


def test_near_copies_are_told_from_others(spark, docs):
    """An edited quarter leaves most of a text's likeness; the next document has little."""
    got = queries.fingerprints_query(spark, "/root/testdata/sf0.001").select("n_chars", "near_edited", "near_next", "fingerprint").collect()
    long = [r for r in got if r["n_chars"] >= 60]
    assert len(long) > 150 and np.quantile([r["near_edited"] for r in long], 0.02) > 0.5
    assert np.quantile([r["near_next"] for r in long], 0.95) < 0.2


def test_column_of_fingerprints(spark):
    ranks = fp.ranks_of(np.zeros(fp.LEVELS, dtype=np.int64))
    df = spark.createDataFrame([(1, "some text of some length, longer than one window"), (2, None), (3, "some text of some length, longer than one window")],
                               "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in fp.fingerprints(df, ranks).collect()}
    assert got[1] == got[3] != "" and got[2] == ""
