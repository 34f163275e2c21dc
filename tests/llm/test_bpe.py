"""BPE against the tiktoken library, joins against whole encodings, and round trips."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from profilar.llm import bpe, token_counts

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
OWN = bpe.Tokenizer(RANKS, public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks={
    base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab 1'!\n\té日😀st  \x1c=")), max_size=60))
def test_encodes_like_the_library(text):
    assert OWN.encode(text) == LIBRARY.encode_ordinary(text)
    assert OWN.decode(OWN.encode(text)).decode() == text


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=200), st.integers(0, 200))
def test_join_equals_encoding_of_the_whole(block, cut):
    cut %= len(block)
    whole = OWN._merge_by_heap(block)
    assert OWN._merge_by_scan(block) == whole
    assert OWN.join(OWN.merge(block[:cut]), OWN.merge(block[cut:])) == whole == OWN.encode_block(block)


def test_every_entry_of_the_vocabulary():
    for token in RANKS:
        assert OWN.encode_block(token) == OWN.merge(token)


@pytest.mark.parametrize("text", ["a" * 4001, "ab" * 2000 + "c", "=" * 3001, " " * 3000 + "x", "\n" * 999,
                                  "".join(random.Random(3).choices("abcdef", k=9000))])
def test_long_pieces(text):
    assert OWN.encode(text) == LIBRARY.encode_ordinary(text)


def test_memo_turns_over(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 3)
    small = bpe.Tokenizer(RANKS, public_tokenizers.PATTERN)
    for text in ["one two three four five six", "six five four three two one", "one two  three\nfour"] * 2:
        assert small.encode(text) == LIBRARY.encode_ordinary(text)


texts_of_words = st.lists(st.text(alphabet=st.sampled_from(list("ab 1'!\n\té日😀st  \x1c=\u3000")), max_size=40), max_size=12)


@settings(max_examples=300, deadline=None)
@given(texts_of_words, st.integers(1, 60))
def test_many_texts_encode_like_the_library(texts, gathered):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(bpe, "GATHERED_CHARS", gathered)
        assert [ids.tolist() for ids in OWN.encode_all(texts)] == [LIBRARY.encode_ordinary(t) for t in texts]


def test_words_that_recur_in_a_batch_are_cut_and_encoded_once(monkeypatch):
    """More different words than the memo holds, every one in each of twenty texts."""
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 50)
    small = bpe.Tokenizer(RANKS, public_tokenizers.PATTERN)
    words = ["".join(random.Random(k).choices("qxzjkvw", k=12)) for k in range(400)]
    texts = ["The " + " ".join(random.Random(k).sample(words, len(words))) for k in range(20)]
    cut, encoded = [], []

    class Pattern:
        def findall(self, text):
            cut.append(len(text))
            return OWN.pattern.findall(text)

    small.pattern = Pattern()
    monkeypatch.setattr(small, "encode_piece", lambda piece: encoded.append(piece) or bpe.Tokenizer.encode_piece(small, piece))
    assert [ids.tolist() for ids in small.encode_all(texts)] == [LIBRARY.encode_ordinary(t) for t in texts]
    assert sum(cut) <= 2 * len(texts[0])
    assert sum(len(p) > 4 for p in encoded) == len(words)


def test_columns_and_digests(spark, odd_docs, no_docs):
    rows = bpe.digests(odd_docs, PATH, public_tokenizers.PATTERN).collect()
    assert len(rows) == odd_docs.count() and rows[0]["key"] == "clash"
    for r in rows:
        ids = LIBRARY.encode_ordinary(r["text"] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    both = bpe.decode(bpe.encode(odd_docs, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in both.collect())
    assert bpe.digests(no_docs, PATH, public_tokenizers.PATTERN).count() == 0


def library_spans(text):
    ids, starts = LIBRARY.decode_with_offsets(LIBRARY.encode_ordinary(text))
    return starts


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_by_brute_force(spark, docs, odd_docs, rule):
    table = docs.selectExpr("doc_id + 1000 AS doc_id", "text").limit(60).union(odd_docs.select("doc_id", "text").where("doc_id not in (5)"))
    found = token_counts.section_tokens(table, PATH, public_tokenizers.PATTERN, rule=rule).toPandas()
    texts = {r["doc_id"]: r["text"] or "" for r in table.collect()}
    assert set(found["doc_id"].dropna()) == {k for k in texts if k is not None}
    for key, part in found.dropna(subset=["doc_id"]).groupby("doc_id"):
        text, part = texts[int(key)], part.drop_duplicates("section").sort_values("section")
        ids = LIBRARY.encode_ordinary(text)
        assert (part["doc_tokens"] == len(ids)).all()
        assert abs(part["n_tokens"].sum() - len(ids)) < 1e-6
        assert "".join(text[a:b] for a, b in zip(part["char_start"], part["char_end"])) == text
        # spans by decoding growing prefixes of the bytes
        sizes = [len(LIBRARY.decode_single_token_bytes(i)) for i in ids]
        of_byte = [k for k, c in enumerate(text) for _ in c.encode()]
        at, want = 0, [0.0] * len(part)
        bounds = list(zip(part["char_start"], part["char_end"]))
        for size in sizes:
            a, b = of_byte[at], of_byte[at + size - 1] + 1
            at += size
            for k, (low, high) in enumerate(bounds):
                if rule == "share":
                    want[k] += max(0, min(b, high) - max(a, low)) / (b - a)
                else:
                    want[k] += low <= (a if rule == "start" else b - 1) < high
        assert part["n_tokens"].tolist() == pytest.approx(want)


def test_token_counts_of_given_spans(spark, no_docs):
    df = spark.createDataFrame([(1, "one two three", [(4, 7), (0, 13), (5, 99), (9, 3), None]), (2, None, None)],
                               "doc_id long, text string, spans array<struct<start:int,end:int>>")
    found = token_counts.section_tokens(df, PATH, public_tokenizers.PATTERN, spans="spans", rule="end").toPandas()
    assert found["n_tokens"].tolist() == [1, 3, 2, 0]  # " two" ends in the first, overlapping spans count both
    assert token_counts.section_tokens(no_docs, PATH, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        token_counts.section_tokens(df, PATH, public_tokenizers.PATTERN, rule="most")
