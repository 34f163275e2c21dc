"""Quality scores from gradient-boosted trees over document statistics.

Statistics of whole texts are binned at quantiles; trees of fixed depth are grown level by level from histograms of gradients
and stored as flat arrays, so that a batch of rows walks all trees with array indexing. Trees are fitted on a bounded sample
of labelled rows (``sample`` rows of least key hash); statistics and scores cover every row. NULL counts as the empty text,
which is scored like any other. Without labels every score is 0.5; with one class it is that class's smoothed rate.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from profilar.llm.samples import least_hashed

#: Labelled rows fitted on, at most.
SAMPLE = 20_000
BINS = 64
TREES = 60
DEPTH = 4
RATE = 0.2
PRIOR = 5.0  # weight of a leaf's zero prior, in summed second derivatives

SYMBOLS = "#*$%&|!<>{}[]_=~@/\\^+-.,;:'\"()?"
FEATURES = ["chars", "words", "lines", "word_length", "longest_word", "words_per_line", "upper", "lower", "digit", "space",
            "high_byte", "control", "distinct_words", "top_word", "top_pair", "distinct_lines", "single_letters",
            "alpha_words", "capital_words", "letter_entropy", "punctuation_ends"] + [f"symbol_{c}" for c in SYMBOLS]


def statistics(text: str | None) -> list[float]:
    """``FEATURES`` of a whole text."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    counts = np.bincount(data, minlength=256).astype(float)
    size = max(1.0, float(len(data)))
    words = text.split()
    n = max(1, len(words))
    of = Counter(words)
    top = max(of.values(), default=0)
    pairs = Counter(zip(words, words[1:]))
    lines = text.split("\n")
    letters = counts[65:91] + counts[97:123]
    share = letters[letters > 0] / max(1.0, letters.sum())
    values = [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), sum(map(len, words)) / n,
        np.log1p(max(map(len, words), default=0)), np.log1p(len(words) / len(lines)), counts[65:91].sum() / size,
        counts[97:123].sum() / size, counts[48:58].sum() / size, (counts[32] + counts[9:14].sum()) / size,
        counts[128:].sum() / size, (counts[:9].sum() + counts[14:32].sum()) / size, len(of) / n, top / n,
        max(pairs.values(), default=0) / n, len(set(lines)) / len(lines), sum(1 for w in words if len(w) == 1) / n,
        sum(map(str.isalpha, words)) / n, sum(1 for w in words if w[0].isupper()) / n, float(-(share * np.log(share)).sum()),
        sum(1 for w in words if not w[-1].isalnum()) / n,
    ]
    return values + [counts[ord(c)] / size for c in SYMBOLS]


@dataclass
class Trees:
    """Complete trees in flat arrays: node ``k`` of a tree has children ``2k + 1`` and ``2k + 2``."""

    edges: np.ndarray  # features x (bins - 1), ascending
    start: float
    depth: int
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), dtype=np.int32))
    cut: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), dtype=np.int32))  # right if the bin exceeds it
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.edges[f], x[:, f], side="right") for f in range(x.shape[1])], axis=1)

    def margin(self, binned: np.ndarray) -> np.ndarray:
        rows = np.arange(len(binned))[:, None]
        trees = np.arange(len(self.feature))[None, :]
        at = np.zeros((len(binned), len(self.feature)), dtype=np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (binned[rows, self.feature[trees, at]] > self.cut[trees, at])
        first = (1 << self.depth) - 1
        return self.start + self.leaf[trees, at - first].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return 1.0 / (1.0 + np.exp(-self.margin(self.bins(x))))


def _grow(binned: np.ndarray, slope: np.ndarray, bend: np.ndarray, depth: int, bins: int, prior: float):
    """One tree's features, cuts and leaf values from histograms of first and second derivatives."""
    n, width = binned.shape
    feature = np.zeros((1 << depth) - 1, dtype=np.int32)
    cut = np.full((1 << depth) - 1, bins, dtype=np.int32)  # nothing exceeds it: all rows go left
    at = np.zeros(n, dtype=np.int64)
    column = np.arange(width) * bins
    for level in range(depth):
        nodes, base = 1 << level, (1 << level) - 1
        slot = ((at - base)[:, None] * (width * bins) + column + binned).ravel()
        g = np.bincount(slot, np.repeat(slope, width), nodes * width * bins).reshape(nodes, width, bins)
        h = np.bincount(slot, np.repeat(bend, width), nodes * width * bins).reshape(nodes, width, bins)
        left_g, left_h = g.cumsum(axis=2), h.cumsum(axis=2)
        all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
        gain = (left_g ** 2 / (left_h + prior) + (all_g - left_g) ** 2 / (all_h - left_h + prior)
                - all_g ** 2 / (all_h + prior)).reshape(nodes, -1)
        best = gain.argmax(axis=1)
        for k in np.flatnonzero(gain[np.arange(nodes), best] > 1e-9):
            feature[base + k], cut[base + k] = divmod(best[k], bins)
        at = 2 * at + 1 + (binned[np.arange(n), feature[at]] > cut[at])
    leaf_at = at - ((1 << depth) - 1)
    g, h = np.bincount(leaf_at, slope, 1 << depth), np.bincount(leaf_at, bend, 1 << depth)
    return feature, cut, -g / (h + prior), leaf_at


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE,
        prior: float = PRIOR) -> Trees:
    """Boost trees on the logistic loss."""
    width = x.shape[1] if len(x) else len(FEATURES)
    cuts = np.linspace(0, 1, bins + 1)[1:-1]
    edges = np.quantile(x, cuts, axis=0).T if len(x) else np.zeros((width, bins - 1))
    rate_of_ones = (y.sum() + 0.5) / (len(y) + 1.0)
    model = Trees(edges, float(np.log(rate_of_ones / (1 - rate_of_ones))), depth)
    if not len(x) or y.min() == y.max():
        model.feature = model.cut = np.zeros((0, (1 << depth) - 1), dtype=np.int32)
        model.leaf = np.zeros((0, 1 << depth))
        return model
    binned, margin, grown = model.bins(x), np.full(len(y), model.start), []
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        feature, cut, leaf, leaf_at = _grow(binned, p - y, p * (1 - p), depth, bins, prior)
        margin += rate * leaf[leaf_at]
        grown.append((feature, cut, rate * leaf))
    model.feature, model.cut, model.leaf = (np.stack(part) for part in zip(*grown))
    return model


def _matrix(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=float).reshape(-1, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          sample: int = SAMPLE) -> Trees:
    """Fit on at most ``sample`` labelled keys, a row each.

    Of several labels for a key the least counts, of several texts the one of least hash; NULL labels do not count.
    """
    labelled = (labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("__key"))
                .agg(F.min(label).alias("__label")))
    chosen = least_hashed(labelled, F.xxhash64("__key"), sample)
    texts = docs.join(F.broadcast(chosen), F.col(key) == F.col("__key")).select(  # ``sample`` rows at most
        F.col("__key").alias("key"), F.col("__label").cast("double").alias("label"),
        F.struct(F.xxhash64(text).alias("hash"), F.col(text).alias("text")).alias("held"))
    rows = texts.groupBy("key", "label").agg(F.min("held").alias("held")).select("key", "label", F.col("held.text").alias("text"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "label": batch["label"], "x": list(_matrix(batch["text"]))})

    table = rows.mapInPandas(each, "key long, label double, x array<double>").toPandas().sort_values("key", kind="stable")
    x = np.array(table["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    return fit(x, table["label"].to_numpy(dtype=float))


def score(docs: DataFrame, model: Trees, text: str = "text", result: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    @F.pandas_udf("double")
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(shared.value.score(_matrix(batch)))

    return docs.withColumn(result, each(F.col(text)))
