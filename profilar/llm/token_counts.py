"""Tokens per section of a document, from one encoding of the whole document.

A text is encoded once; each token's span of characters follows from the lengths of the tokens' bytes. Token spans are
interval-joined to the sections' spans with two binary searches per section. A token that crosses a section's edge is
allocated by an explicit rule:

* ``start``: to the sections that hold its first character,
* ``end``: to the sections that hold its last character,
* ``share``: to every section in proportion to the token's characters inside it.

A token inside a character (bytes of one character split over tokens) spans that character. Sections that cover a text
without overlap share out exactly its tokens. By default sections are the lines with their line ends; otherwise a column of
``start``/``end`` character offsets gives them (clipped to the text, in any order, overlapping or not, NULLs ignored). A NULL
or empty text has one empty line without tokens. Repeated rows give repeated counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from profilar.llm.bpe import Tokenizer, broadcast_ranks, shared_tokenizer

RULES = ("start", "end", "share")


def token_spans(tokenizer: Tokenizer, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character offsets [start, end) of each token of a text."""
    sizes = tokenizer.sizes[ids]
    stops = np.cumsum(sizes)
    data = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    if len(data) == len(text):
        return stops - sizes, stops
    of_byte = np.cumsum((data & 0xC0) != 0x80) - 1  # the character that each byte belongs to
    return of_byte[stops - sizes], of_byte[stops - 1] + 1


def line_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the lines, each with its line end."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    ends = np.flatnonzero(codes == 10) + 1
    ends = np.append(ends, len(codes))
    return np.concatenate([[0], ends[:-1]]), ends


def allocate(tokens: tuple[np.ndarray, np.ndarray], sections: tuple[np.ndarray, np.ndarray], rule: str) -> np.ndarray:
    """Tokens (a number, with fractions for ``share``) of every section. Token spans must be in text order."""
    (begin, stop), (low, high) = tokens, sections
    if rule == "start":
        return np.searchsorted(begin, np.maximum(low, high), "left") - np.searchsorted(begin, low, "left").astype(float)
    if rule == "end":
        return np.searchsorted(stop - 1, np.maximum(low, high), "left") - np.searchsorted(stop - 1, low, "left").astype(float)
    if rule != "share":
        raise ValueError(f"rule must be one of {RULES}")
    # each token spreads one unit evenly over its characters: the running total is linear inside a token
    if not len(begin):
        return np.zeros(len(low))
    spread = np.zeros(int(stop[-1]) + 1)
    width = stop - begin
    np.add.at(spread, begin, 1.0 / width)
    np.add.at(spread, stop, -1.0 / width)
    total = np.concatenate([[0.0], np.cumsum(np.cumsum(spread))])
    last = len(total) - 1
    return np.maximum(0.0, total[np.minimum(high, last)] - total[np.minimum(low, last)])


def section_tokens(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text",
                   rule: str = "start", spans: str | None = None) -> DataFrame:
    """A row per section: ``key``, its number, its offsets, its tokens, and the tokens of the whole text."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ranks, name = broadcast_ranks(docs, vocabulary, pattern)
    kind = "double" if rule == "share" else "long"

    @F.pandas_udf(f"char_start array<long>, char_end array<long>, n_tokens array<{kind}>, doc_tokens long")
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = shared_tokenizer(name, ranks, pattern)
        for batch in batches:
            parts = []
            texts = [t or "" for t in batch.iloc[:, 0]]
            for row, whole, ids in zip(batch.itertuples(index=False), texts, tokenizer.encode_all(texts)):
                if spans:
                    given = [s for s in (row[1] if row[1] is not None else [])
                             if s is not None and s["start"] is not None and s["end"] is not None]
                    low = np.clip(np.array([s["start"] for s in given], dtype=np.int64), 0, len(whole))
                    high = np.clip(np.array([s["end"] for s in given], dtype=np.int64), 0, len(whole))
                else:
                    low, high = line_spans(whole)
                tokens = token_spans(tokenizer, whole, ids)
                counts = allocate(tokens, (low, high), rule)
                parts.append((low.astype(np.int64), high.astype(np.int64), counts if rule == "share" else counts.astype(np.int64), len(tokens[0])))
            yield pd.DataFrame(parts, columns=["char_start", "char_end", "n_tokens", "doc_tokens"])

    # only texts and spans go to Python: a key beside a NULL would be rounded there
    read = F.struct(F.col(text).alias("text"), *([F.col(spans).alias("spans")] if spans else []))
    found = docs.select(F.col(key).alias("__key"), each(read).alias("__found"))
    fields = [F.col(f"__found.{c}").alias(c) for c in ("char_start", "char_end", "n_tokens")]
    dealt = found.select("__key", F.col("__found.doc_tokens").alias("__doc"), F.posexplode(F.arrays_zip(*fields)).alias("__section", "__at"))
    return dealt.select(F.col("__key").alias(key), F.col("__section").alias("section"), "__at.*", F.col("__doc").alias("doc_tokens"))
