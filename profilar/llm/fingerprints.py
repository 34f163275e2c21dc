"""Fingerprints of improbable features, in chained Bloom filters.

Every window of ``WINDOW`` bytes of a text's UTF-8 is a candidate feature. Its entropy puts it on one of ``LEVELS`` levels, and levels
are ranked by how few windows of all documents lie there (``learn``: one pass, one count per level); windows below ``WEAK`` of the
greatest entropy (runs, rules, padding) rank last. A window is selected if it has the least rank, leftmost of equals, in at
least ``CHOSEN`` of the ``SPAN`` stretches of ``SPAN`` windows that hold it. A text with fewer than ``FEW`` selected windows also takes
every window of ``SHORT`` bytes (itself, if it is shorter). A text's different features, in order, enter Bloom filters of
``FILTER_BITS`` bits, ``FILTER_FEATURES`` to a filter, as many filters as it takes.

Two fingerprints are compared filter by filter: the overlap of set bits is normalised so that 1 is containment and 0 what chance gives
plus ``MARGIN`` of the way to containment; each filter of the shorter fingerprint takes its best partner, weighted by its bits. Equal
fingerprints have a likeness of 1, an empty and another one 0. Fingerprints depend on the text and the learned ranks only; NULL is
read as empty. Long texts are read in blocks of ``BLOCK`` bytes, without a limit; the comparison takes filters times filters.

``with_next`` pairs every document with the one after it: rows are dealt by ranges of the key (NULLs first, then by a hash of the
text), each range is a sorted stream, and only the first and last rows of ranges are joined.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from profilar.session import shared_folder

WINDOW = 32
LEVELS = 1024
WEAK = 0.4
SPAN = 32
CHOSEN = 8
FEW, SHORT = 8, 5
FILTER_BITS = 2048
FILTER_FEATURES = 160
HASH_BITS, HASHES = 11, 5
MARGIN = 0.1
BLOCK = 1 << 17
#: Bytes of texts worked on at once, and filters compared at once.
BATCH_BYTES = 1 << 21
FILTERS_AT_ONCE = 512

_steps = np.arange(WINDOW + 1)
#: Of k equal bytes: k log k, in millionths; what the k-th adds.
_ALL = np.round(np.where(_steps > 0, _steps * np.log2(np.maximum(_steps, 1)), 0) * 1e6).astype(np.int64)
_ADDED = np.concatenate([[0], np.diff(_ALL)])


def levels(data: np.ndarray) -> np.ndarray:
    """The entropy level of each window of a block of bytes: 0 for equal bytes, ``LEVELS - 1`` for all different ones."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, dtype=np.int64)
    behind, ahead = np.ones(n, dtype=np.uint8), np.ones(n, dtype=np.uint8)  # equal bytes in the window that ends, starts here
    for k in range(1, WINDOW):
        same = (data[k:] == data[:-k]).view(np.uint8)
        behind[k:] += same
        ahead[:-k] += same
    entered, left = np.cumsum(_ADDED[behind]), np.cumsum(_ADDED[ahead])
    equal = entered[WINDOW - 1:].copy()  # sum of k log k over a window's bytes
    equal[1:] -= left[:n - WINDOW]
    return (_ALL[WINDOW] - equal) * (LEVELS - 1) // _ALL[WINDOW]


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """Levels' ranks: few windows first, then low levels; weak levels last."""
    at = np.arange(LEVELS)
    order = np.lexsort((at, counts, at < WEAK * (LEVELS - 1)))
    ranks = np.empty(LEVELS, dtype=np.int64)
    ranks[order] = at
    return ranks


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([0] + [len(t) for t in texts])
    return np.frombuffer(b"".join(texts), dtype=np.uint8), ends


def _groups(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Texts in lists of bounded size; a longer text is a list by itself."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > BATCH_BYTES:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def level_counts(texts: list[bytes]) -> np.ndarray:
    """Windows on each level, over whole texts."""
    counts = np.zeros(LEVELS, dtype=np.int64)
    for group in _groups(texts):
        data, ends = _joined(group)
        inside = np.ones(len(data), dtype=bool)
        for end in ends[1:]:
            inside[max(0, end - WINDOW + 1):end] = False  # windows across two texts
        for at in range(0, len(data), BLOCK):
            found = levels(data[at:at + BLOCK + WINDOW - 1])
            counts += np.bincount(found[inside[at:at + len(found)]], minlength=LEVELS)
    return counts


def _selected(data: np.ndarray, whole: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Places of selected windows. ``whole``: where a stretch of ``SPAN`` windows lies in one text."""
    places, times = [], []
    for at in range(0, len(data), BLOCK):
        found = levels(data[at:at + BLOCK + SPAN + WINDOW - 2])
        if len(found) < SPAN:
            break
        key = (ranks[found] << 32) | np.arange(len(found))
        k = 1
        while k < SPAN:
            key = np.minimum(key[:-k], key[k:])
            k *= 2
        best = (key & 0xFFFFFFFF)[whole[at:at + len(key)]] + at
        if len(best):  # never falling
            starts = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
            places.append(best[starts])
            times.append(np.diff(np.append(starts, len(best))))
    if not places:
        return np.zeros(0, dtype=np.int64)
    place, n = np.concatenate(places), np.concatenate(times)
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))  # a place may be met from two blocks
    return place[starts][np.add.reduceat(n, starts) >= CHOSEN]


def _hashed(windows: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(windows).view(np.uint64)
    out = np.full(len(words), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for k in range(words.shape[1]):
        out = (out ^ words[:, k]) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(32))


def _short(text: bytes) -> np.ndarray:
    """Hashes of all windows of ``SHORT`` bytes; of the text if it is shorter."""
    data = np.frombuffer(text, dtype=np.uint8)
    size = min(SHORT, len(data))
    padded = np.zeros((len(data) - size + 1, WINDOW), dtype=np.uint8)
    padded[:, :size] = data[np.arange(len(padded))[:, None] + np.arange(size)]
    return _hashed(padded) ^ np.uint64(size)


def features(texts: list[bytes], ranks: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of each text's different features, in order."""
    for group in _groups(texts):
        data, ends = _joined(group)
        whole = np.zeros(len(data), dtype=bool)
        for begin, end in zip(ends[:-1], ends[1:]):
            whole[begin:max(begin, end - WINDOW - SPAN + 2)] = True
        places = _selected(data, whole, ranks)
        bounds = np.searchsorted(places, ends)
        offsets = np.arange(WINDOW)
        for k, text in enumerate(group):
            chosen = places[bounds[k]:bounds[k + 1]]
            found = _hashed(data[chosen[:, None] + offsets])
            if len(chosen) < FEW and text:
                found = np.concatenate([found, _short(text)])
            _, first = np.unique(found, return_index=True)
            yield found[np.sort(first)]


def filters(found: np.ndarray) -> np.ndarray:
    """The chained filters of features, a row of packed bits each."""
    n = -(-len(found) // FILTER_FEATURES)
    bits = np.zeros((n, FILTER_BITS), dtype=bool)
    of = np.arange(len(found)) // FILTER_FEATURES
    for k in range(HASHES):
        bits[of, (found >> np.uint64(k * HASH_BITS)).astype(np.int64) & (FILTER_BITS - 1)] = True
    return np.packbits(bits, axis=1)


def likeness(left: np.ndarray, right: np.ndarray) -> float:
    """Likeness of two fingerprints' filters, from 0 to 1; symmetric."""
    if left.shape == right.shape and np.array_equal(left, right):
        return 1.0
    if not len(left) or not len(right):
        return 0.0
    few, many = sorted((left, right), key=lambda f: (len(f), f.tobytes()))
    total = weights = 0.0
    for i in range(0, len(few), FILTERS_AT_ONCE):
        a = np.unpackbits(few[i:i + FILTERS_AT_ONCE], axis=1).astype(np.float32)
        na, best = a.sum(axis=1), np.zeros(len(a))
        for j in range(0, len(many), FILTERS_AT_ONCE):
            b = np.unpackbits(many[j:j + FILTERS_AT_ONCE], axis=1).astype(np.float32)
            nb = b.sum(axis=1)
            chance, most = np.outer(na, nb).astype(float) / FILTER_BITS, np.minimum.outer(na, nb).astype(float)
            low = chance + MARGIN * (most - chance)
            score = np.divide(a @ b.T - low, most - low, out=np.ones(low.shape), where=most > low)
            best = np.maximum(best, score.max(axis=1))
        total += float((np.clip(best, 0.0, 1.0) * na).sum())
        weights += float(na.sum())
    return total / weights


def written(found: np.ndarray) -> str:
    """Filters as text; empty for none."""
    return base64.b64encode(found.tobytes()).decode()


def read(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), dtype=np.uint8).reshape(-1, FILTER_BITS // 8)


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def learn(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Ranks of the levels by the windows of all texts."""
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(LEVELS, dtype=np.int64)
        for batch in batches:
            counts += level_counts([encoded(t) for t in batch["text"]])
        yield pd.DataFrame({"counts": [counts]})

    parts = docs.select(F.col(text).alias("text")).mapInPandas(each, "counts array<long>")
    rows = parts.select(F.posexplode("counts").alias("level", "n")).groupBy("level").agg(F.sum("n").alias("n")).collect()  # one for each level
    counts = np.zeros(LEVELS, dtype=np.int64)
    for r in rows:
        counts[r["level"]] = r["n"]
    return ranks_of(counts)


def fingerprints(docs: DataFrame, ranks: np.ndarray, text: str = "text", result: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each text."""
    @F.pandas_udf("string")
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([written(filters(f)) for f in features([encoded(t) for t in batch], ranks)], dtype=object)

    return docs.withColumn(result, each(F.col(text)))


Pair = Callable[[list[str], list[str]], pd.DataFrame]


def with_next(docs: DataFrame, key: str, text: str, work: Pair, schema: str) -> DataFrame:
    """``key`` and the columns of ``schema`` for every document and the one after it (after the last: the first).

    ``work`` takes a list of texts, the last of which only follows, and returns a row for each of the others. A table of one row
    follows itself. Equal keys are in the order of a hash of the text.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    order = [F.asc_nulls_first("key"), F.xxhash64("text"), F.monotonically_increasing_id()]  # the last splits equal rows
    marked = narrow.select("key", "text", *[o.alias(f"o{k}") for k, o in enumerate(order[1:])])
    dealt = marked.repartitionByRange(parts, order[0], "o0", "o1").sortWithinPartitions(order[0], "o0", "o1")
    stream = dealt.select(F.col("key").cast("string").alias("key"), "text", F.spark_partition_id().alias("part"))
    names = [f.split()[0] for f in schema.split(", ")]

    def edge(kind: str, part: int, k: str | None, t: str) -> pd.DataFrame:
        return pd.DataFrame({"part": [part], "kind": [kind], "key": pd.Series([k], dtype=object), "text": [t], **{n: [None] for n in names}})

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = part = None
        for batch in batches:
            if not len(batch):
                continue
            if part is None:
                part = int(batch["part"].iloc[0])
                yield edge("first", part, batch["key"].iloc[0], batch["text"].iloc[0])
            for keys, texts in _bounded(batch["key"], batch["text"]):
                if held is not None:
                    keys, texts = [held[0], *keys], [held[1], *texts]
                held = keys[-1], texts[-1]
                if len(texts) > 1:
                    done = work(texts)
                    done.insert(0, "part", part)
                    done.insert(1, "kind", "done")
                    done.insert(2, "key", pd.Series(keys[:-1], dtype=object))
                    done.insert(3, "text", None)
                    yield done
        if held is not None:
            yield edge("last", part, *held)

    rows, path = stream.mapInPandas(each, f"part int, kind string, key string, text string, {schema}"), f"{shared_folder(spark)}/ranges"
    rows.write.option("compression", "zstd").parquet(path)  # filters with few features are mostly zeros
    made = spark.read.schema(rows.schema).parquet(path)
    held_parts = sorted(r[0] for r in made.where("kind = 'first'").select("part").collect())  # a number for each range
    after = spark.createDataFrame(list(zip(held_parts, held_parts[1:] + held_parts[:1])), "part int, after int")
    first = made.where("kind = 'first'").select(F.col("part").alias("after"), F.col("text").alias("next"))
    last = made.where("kind = 'last'").select("part", "key", "text")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, t, following in zip(batch["key"], batch["text"], batch["next"]):
                done = work([t, following])
                done.insert(0, "key", pd.Series([k], dtype=object))
                yield done

    ends = last.join(after, "part").join(first, "after").select("key", "text", "next").mapInPandas(finish, f"key string, {schema}")
    out = made.where("kind = 'done'").select("key", *names).unionByName(ends)
    return out.withColumn("key", F.col("key").cast(dict(docs.dtypes)[key])).withColumnRenamed("key", key)


def _bounded(keys: pd.Series, texts: pd.Series) -> Iterator[tuple[list, list]]:
    """Rows in lists of bounded text."""
    held, size = ([], []), 0
    for k, t in zip(keys, texts):
        held[0].append(k)
        held[1].append(t)
        size += len(t)
        if size >= BATCH_BYTES:
            yield held
            held, size = ([], []), 0
    if held[0]:
        yield held
