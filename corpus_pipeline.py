"""Training-data pipeline: each stage reads its predecessor's table and returns what it keeps.

All but the last stage return the columns of ``documents``. Stages drop the rows that they reject, and shorten texts
(``n_chars`` follows). ``run`` writes each stage's result to the shared folder before the next one reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from profilar.llm import bpe, decontaminate, language, line_dedup, simhash
from profilar.session import save_and_reload

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no known language: NULL texts and texts without a letter.

    Where nothing could be learned, texts with a letter stay.
    """
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    found = language.identify(docs, F.coalesce(~held, F.lit(True)), result="__language")
    unlearned = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))  # if not identified despite a letter
    return found.where((F.col("__language.lang_pred") != language.UNKNOWN) | unlearned).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shorten texts by the lines that repeat earlier three-line windows."""
    cut = line_dedup.remove_repeated_lines(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least id of each group; five-word shingles, a similarity of 0.8 or more."""
    return simhash.keep_one(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item up to a fifth of its words."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the texts that remain."""
    found = bpe.digests(docs.select("doc_id", "text"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language ID", language_id),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE encoding and decoding", tokenize),
]

#: Language models, fingerprint groups and byte pairs are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = save_and_reload(docs, f"stage{k}")
    return docs
