"""The corpus pipeline against a brute-force version, and what each stage keeps."""

import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from profilar.llm import bpe, decontaminate
from tests.llm.conftest import DOCS
from tests.llm.test_dedup import brute_fingerprint, brute_lines, brute_roots
from tests.llm.test_decontaminate import least_distance

FOLDER = "/root/testdata/sf0.001"
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))


def brute(rows, items):
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    rows = brute_lines(rows)
    roots = brute_roots({k: brute_fingerprint(t, 5) for k, t in rows}, 4, dict(rows))
    rows = [r for r in rows if roots[r[0]] == r[0]]
    clean = []
    for key, text in rows:
        words = decontaminate.all_words(text)
        if all(len(set(item) & set(words)) < 0.8 * len(set(item)) - 1 or least_distance(item, words) > int(0.2 * len(item))
               for item in items):
            clean.append((key, text))
    ids = {key: LIBRARY.encode_ordinary(text) for key, text in clean}
    return {key: (len(ids[key]), hashlib.sha256(",".join(map(str, ids[key])).encode()).hexdigest(),
                  hashlib.sha256(text.encode()).hexdigest()) for key, text in clean}


def test_run_equals_brute_force(spark, docs):
    items = [decontaminate.all_words(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], items)
    found = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert found == want


def test_language_stage_with_nothing_learned(spark):
    rows = spark.createDataFrame([(1, "some words", None, "s", 10), (2, "12 !", None, "s", 4), (3, None, None, "s", None)], DOCS)
    assert [r["doc_id"] for r in corpus_pipeline.language_id(spark, rows, FOLDER).collect()] == [1]


def test_stages_take_odd_rows(spark, odd_docs, no_docs):
    for start in (odd_docs, no_docs):
        rows = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            columns, rows = rows.columns, stage(spark, rows, FOLDER)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert rows.columns == columns, name
        kept = sorted(r["doc_id"] or 0 for r in rows.collect())
        assert kept == ([0, 3, 5, 6, 9] if start is odd_docs else [])
