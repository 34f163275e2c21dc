"""Language identification as inference of a mixture of languages per document.

Training counts hashed letter n-grams per language over all labelled rows. A text's n-grams are then explained as draws from
a mixture of those languages: expectation-maximisation estimates the proportions, first over all languages, then over the
one, two, three ... largest. The set with the greatest log-likelihood less half a logarithm of the n-gram count per further
language is selected. Each text's set grows for as long as that text gains, whatever else is in its batch.

Letters are compared in lower case, everything else counts as one space. NULL texts and texts without a letter are
``und`` with no proportions; so is every text if nothing could be learned. Ties go to the smaller language name. Texts are inferred in
groups of bounded size, short ones by the thousand, with memory for the n-grams that occur in them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

ORDER = 3
BITS = 16
SMOOTHING = 0.5
ROUNDS = 12
BATCH_CHARS = 1 << 21
BATCH_ROWS = 2_000
UNKNOWN = "und"
SPACE = 32

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def _buckets(codes: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Hash of each run of ``order`` characters."""
    n = len(codes) - order + 1
    mixed = np.zeros(max(n, 0), dtype=np.uint32)
    for k in range(order):
        mixed = (mixed ^ codes[k:k + len(mixed)]) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
    return mixed >> np.uint32(32 - bits)


def _part_counts(buckets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Different buckets in ascending order and their numbers."""
    if len(buckets) < 1 << (bits - 2):
        return np.unique(buckets, return_counts=True)
    counts = np.bincount(buckets, minlength=1 << bits)
    used = np.flatnonzero(counts)
    return used, counts[used]


def ngrams(text: str | None, order: int = ORDER, bits: int = BITS) -> tuple[np.ndarray, np.ndarray] | None:
    """Different buckets of a whole text's n-grams, ascending, and their counts; None if it has no letter."""
    if not text:
        return None
    letters, parts, seen = _letter_table(), [], False
    edge = np.full(order - 1, SPACE, dtype=np.uint32)
    before = edge
    for at in range(0, len(text), BATCH_CHARS):
        part = text[at:at + BATCH_CHARS].lower()
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        is_letter = letters[codes]
        seen = seen or bool(is_letter.any())
        codes = np.where(is_letter, codes, np.uint32(SPACE))
        # runs of other characters count as one space, across parts too
        keep = (codes != SPACE) | (np.concatenate([before[-1:], codes[:-1]]) != SPACE)
        codes = np.concatenate([before, codes[keep]])
        before = codes[len(codes) - order + 1:]
        if at + BATCH_CHARS >= len(text):
            codes = np.concatenate([codes, edge])
        parts.append(_part_counts(_buckets(codes, order, bits), bits))
    if not seen:
        return None
    if len(parts) == 1:
        return parts[0]
    used, place = np.unique(np.concatenate([u for u, _ in parts]), return_inverse=True)
    return used, np.bincount(place, np.concatenate([n for _, n in parts])).astype(np.int64)


def ngram_counts(text: str | None, order: int = ORDER, bits: int = BITS) -> np.ndarray | None:
    """Counts of a whole text's n-grams by bucket; None if it has no letter."""
    if (found := ngrams(text, order, bits)) is None:
        return None
    counts = np.zeros(1 << bits, dtype=np.int64)
    counts[found[0]] = found[1]
    return counts


@dataclass
class LanguageModel:
    """Languages in ascending order and, for each, the probability of every bucket."""

    languages: list[str]
    likelihood: np.ndarray
    order: int = ORDER
    bits: int = BITS

    def proportions(self, texts: list[str | None]) -> list[dict[str, float]]:
        """Selected languages and their proportions for each text; empty: unknown."""
        found = [ngrams(t, self.order, self.bits) if self.languages else None for t in texts]
        known = [k for k, counts in enumerate(found) if counts is not None]
        out: list[dict[str, float]] = [{} for _ in texts]
        if not known:
            return out
        used = [found[k][0] for k in known]
        starts = np.concatenate([[0], np.cumsum([len(u) for u in used])[:-1]])
        weight = np.concatenate([found[k][1] for k in known]).astype(float)
        owner = np.repeat(np.arange(len(known)), [len(u) for u in used])
        given = self.likelihood[:, np.concatenate(used)]
        total = np.add.reduceat(weight, starts)
        shares, _ = _fit(given, weight, owner, starts, total, np.ones((len(self.languages), len(known)), dtype=bool))
        rank = np.argsort(np.argsort(-shares, axis=0, kind="stable"), axis=0)
        best, best_value, open_ = None, None, np.ones(len(known), dtype=bool)
        for size in range(1, len(self.languages) + 1):
            shares, value = _fit(given, weight, owner, starts, total, rank < size)
            value = value - 0.5 * (size - 1) * np.log(np.maximum(total, 2.0))
            if best is None:
                best, best_value = shares, value
                continue
            gains = open_ = open_ & (value > best_value)
            if not gains.any():
                break
            best, best_value = np.where(gains, shares, best), np.where(gains, value, best_value)
        for j, k in enumerate(known):
            out[k] = {self.languages[i]: float(best[i, j]) for i in np.flatnonzero(best[:, j] > 0)}
        return out


def _fit(given, weight, owner, starts, total, allowed, rounds: int = ROUNDS):
    """Proportions by expectation-maximisation within the allowed languages, and the log-likelihood they reach."""
    shares = allowed / allowed.sum(axis=0)
    if (allowed.sum(axis=0) == 1).all():
        rounds = 0
    for _ in range(rounds):
        joint = shares[:, owner] * given
        joint *= weight / joint.sum(axis=0)
        shares = np.add.reduceat(joint, starts, axis=1) / total
    mixed = (shares[:, owner] * given).sum(axis=0)
    return shares, np.add.reduceat(weight * np.log(np.maximum(mixed, 1e-300)), starts)


def train(rows: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER, bits: int = BITS,
          smoothing: float = SMOOTHING) -> LanguageModel:
    """Learn from all rows with a text and a language. What reaches the driver is languages x buckets numbers at most."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, name in zip(batch["text"], batch["lang"]):
                if (found := ngrams(t, order, bits)) is not None:
                    sums.setdefault(name, np.zeros(1 << bits, dtype=np.int64))[found[0]] += found[1]
        for name, found in sums.items():
            used = np.flatnonzero(found)
            yield pd.DataFrame({"lang": name, "bucket": used.astype(np.int32), "n": found[used]})

    narrow = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    counted = narrow.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counted.toPandas()
    names = sorted(table["lang"].unique())
    counts = np.full((len(names), 1 << bits), smoothing)
    for i, name in enumerate(names):
        part = table[table["lang"] == name]
        counts[i, part["bucket"]] += part["n"]
    return LanguageModel(names, counts / counts.sum(axis=1, keepdims=True), order, bits)


RESULT = "lang_pred string, score double, languages array<struct<lang:string,share:double>>"


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", result: str = "language") -> DataFrame:
    """``docs`` with a struct column: the language of the largest share, that share (0 to 1), and the selected set."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x buckets, whatever the table's size

    def rows(texts: list[str | None]) -> list[tuple]:
        out = []
        for found in shared.value.proportions(texts):
            ordered = sorted(found.items(), key=lambda p: (-p[1], p[0]))
            lead = ordered[0] if ordered else (UNKNOWN, 0.0)
            out.append((lead[0], min(1.0, lead[1]), [{"lang": n, "share": s} for n, s in ordered]))
        return out

    @F.pandas_udf(RESULT)
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        chars = BATCH_CHARS // max(4, len(shared.value.languages))  # of texts inferred at once: a number for each n-gram and language
        for batch in batches:
            out, held, size = [], [], 0
            for t in batch:
                held.append(t)
                size += len(t or "")
                if size >= chars or len(held) >= BATCH_ROWS:
                    out += rows(held)
                    held, size = [], 0
            yield pd.DataFrame(out + rows(held), columns=["lang_pred", "score", "languages"])

    return docs.withColumn(result, each(F.col(text)))


def identify(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text", lang: str = "lang",
             result: str = "language") -> DataFrame:
    """Learn from the rows of ``docs`` that ``training`` marks and predict every row."""
    return predict(docs, train(docs.where(training), text, lang), text, result)
