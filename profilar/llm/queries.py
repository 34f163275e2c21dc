"""One query per operator, over its whole table."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from profilar.llm import (bpe, conversation_repair, decontaminate, fingerprints, language, line_dedup, main_text, quality, sharding,
                          simhash, sql_text, token_counts, vector_index, whitening)
from profilar.llm.registry import query
from profilar.session import save_and_reload

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_token_counts")
def token_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return token_counts.section_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY),
                                       public_tokenizers.PATTERN)


@query("op2_sharding", sql_text.sharding(SHARDS, sharding.NUMBERING_BITS))
def sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        sharding.shard_for(F.col("doc_id"), dict.fromkeys(range(SHARDS + 1), 1.0)).alias("grown_shard"))
    placed = sharding.assign(sized, "doc_id", dict.fromkeys(range(SHARDS), 1.0), order=("text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query("op3_simhash")
def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), simhash.hex_digits(F.col("fp")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


@query("op4_line_dedup", sql_text.line_dedup(line_dedup.WINDOW))
def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = line_dedup.remove_repeated_lines(docs, spans="spans")
    removed = F.aggregate(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")), F.lit(0).cast("long"),
                          lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", "text", removed.alias("removed_lines"))


@query("op5_decontaminate")
def decontaminate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"key": "doc_id", "item": "item_id"})


@query("op6_main_text")
def main_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    read = main_text.extract(pages, main_text.learn(pages))
    return read.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op7_nearest")
def nearest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vector_index.nearest(vectors, F.col("vec_id") % 100 == 0)


@query("op8_language")
def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    found = language.identify(docs, ~held)
    return found.select("doc_id", held.alias("held_out"), "language.lang_pred", "language.score")


@query("op9_quality")
def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    scored = quality.score(docs, quality.train(docs, labels.where(~held)))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op10_bpe")
def bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = bpe.digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op11_whitening")
def whitening_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whitening.usable(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")
    points = vectors.select("vec_id", whitening.quantised("embedding", 256).alias("x"))
    model = whitening.fit(points, "x")
    if model is None:
        return spark.createDataFrame([], WHITENED)
    rows = whitening.whiten(points, model, "x").select("vec_id", "whitening.deviation", F.posexplode("whitening.whitened"))
    shares = F.array(*[F.lit(float(v)) for v in model.explained]).cast("array<double>")
    return rows.select("vec_id", (F.col("pos") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
                       F.col("col").alias("whitened"), shares[F.col("pos")].alias("explained"),
                       F.lit(model.identity_error).cast("double").alias("identity_error"))


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def edited(text: str, following: str) -> str:
    """A text whose last quarter is replaced by the start of the following one."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


EDITED = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def edited_rows(texts: list[str], ranks: np.ndarray) -> pd.DataFrame:
    """A row of ``EDITED`` for every text but the last, by the text after it."""
    own = [fingerprints.filters(f) for f in fingerprints.features([fingerprints.encoded(t) for t in texts], ranks)]
    data = [fingerprints.encoded(edited(a, b)) for a, b in zip(texts, texts[1:])]
    other = [fingerprints.filters(f) for f in fingerprints.features(data, ranks)]
    return pd.DataFrame({
        "n_chars": [len(t) for t in texts[:-1]], "edited_sha256": [hashlib.sha256(d).hexdigest() for d in data],
        "fingerprint": [fingerprints.written(f) for f in own[:-1]], "edited_fingerprint": [fingerprints.written(f) for f in other],
        "near_edited": [fingerprints.likeness(a, b) for a, b in zip(own, other)],
        "near_next": [fingerprints.likeness(a, b) for a, b in zip(own, own[1:])]})


@query("op12_fingerprints")
def fingerprints_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = fingerprints.learn(docs)
    return fingerprints.with_next(docs, "doc_id", "text", lambda texts: edited_rows(texts, ranks), EDITED)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults by the checksum of their place; ``there`` is false for dropped rows."""
    place = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = (F.crc32(place.cast("binary")) % 20).alias("kind")
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    marked = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind)
    copies = F.array_repeat(F.lit(True), F.when(F.col("kind") == 3, 2).otherwise(1))
    return marked.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") != 0).alias("there"), F.explode(copies)).drop("col")


@query("op13_conversation_repair", sql_text.conversation_repair())
def conversation_repair_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, there = damaged(table(spark, sf_dir, "conversations")), F.col("there")
    found = save_and_reload(conversation_repair.audits(rows, where=there), "repairs")
    hashed = conversation_repair.digests(rows, found, where=there)
    whole = found.join(hashed, found["key"].eqNullSafe(hashed["key"])).drop(hashed["key"])
    return whole.select(F.col("key").alias("conv_id"), *conversation_repair.COUNTS, "cost", "audit", "repaired_sha256")
