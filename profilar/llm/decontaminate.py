"""Benchmark passages in documents, up to edits, by the CGK embedding and bit-sampling LSH.

Texts become words (``\\w+`` in lower case). A document matches an item if some stretch of its words is within
``floor((1 - similarity) * words of the item)`` word edits of the whole item.

The CGK walk of a window copies its current word to the output at every step and moves on by a random bit of (step, word).
Insertions and deletions are thereby absorbed after a few steps, so windows at a small edit distance have outputs at a small
Hamming distance. LSH samples a few output steps: windows that agree there are candidates. Item windows start at every word
of every item; document windows start at every word of every document. Each table has its own random walk and sample. Tables
are added until items altered by the largest allowed number of edits are found at the target rate (a simulation over the
items), and every candidate is verified by an exact edit distance between the whole item and the words around the window.
Windows are short seeds of at most ``STEPS`` steps, whatever the item's length. Items of a size class that ``MAX_TABLES``
tables leave below the target are compared with every document as a whole.

Items are held by every task in blocks of ``block_items``; a larger benchmark takes more passes. Items without words match
nothing, NULL texts contain nothing. Repeated documents and items give repeated matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

SIMILARITY = 0.8
TARGET_RECALL = 0.99
MIN_TABLES, MAX_TABLES = 3, 32
SAMPLED_STEPS = 4
STEPS = 16
#: Items compared in one pass over the documents.
BLOCK_ITEMS = 20_000
#: Items altered to measure recall.
TRIAL_ITEMS = 100
BATCH_WORDS = 1 << 20
TEXT_CHUNK = 1 << 21
SLOTS = 1 << 20

_words = re.compile(r"\w+").findall
_gap = re.compile(r"\W").search


def word_lists(text: str | None) -> Iterator[list[str]]:
    """All words of a text, in bounded lists."""
    text, at = text or "", 0
    while at < len(text):
        cut = _gap(text, at + TEXT_CHUNK) if at + TEXT_CHUNK < len(text) else None
        end = cut.start() if cut else len(text)
        yield _words(text[at:end].lower())
        at = end


def all_words(text: str | None) -> list[str]:
    return [w for part in word_lists(text) for w in part]


def edit_row(item: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Least edit distance between the item and any stretch of ``words`` that ends before each position."""
    reach = np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, dtype=np.int64)
    for k, symbol in enumerate(item):
        nxt = row + 1
        np.minimum(nxt[1:], row[:-1] + (words != symbol), out=nxt[1:])
        row = np.minimum.accumulate(nxt - reach) + reach
    return row


def best_stretch(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Distance, start and end of the stretch nearest to the item; the earliest end, then the latest start."""
    row = edit_row(item, words)
    end = int(row.argmin())
    # backwards from the fixed end: a stretch must start there, so skipping words costs
    back, reach = np.arange(end + 1), np.arange(end + 1)
    turned = words[:end][::-1]
    for symbol in item[::-1]:
        nxt = back + 1
        np.minimum(nxt[1:], back[:-1] + (turned != symbol), out=nxt[1:])
        back = np.minimum.accumulate(nxt - reach) + reach
    return int(row[end]), end - int(back.argmin()), end


class Index:
    """LSH tables over the windows of a block of items. ``items``: (id, words)."""

    def __init__(self, items: list[tuple[int, list[str]]], similarity: float = SIMILARITY,
                 target: float = TARGET_RECALL, seed: int = 1):
        items = [(i, w) for i, w in items if w]
        self.similarity = similarity
        self.symbols: dict[str, int] = {}  # 0: a word of no item
        for _, words in items:
            for w in words:
                self.symbols.setdefault(w, len(self.symbols) + 1)
        self.ids = [i for i, _ in items]
        self.items = [np.array([self.symbols[w] for w in words], dtype=np.int32) for _, words in items]
        self.members = [set(x.tolist()) for x in self.items]
        self.random = np.random.default_rng(seed)
        self.tables: list[dict] = []
        by_steps: dict[int, list[int]] = {}
        for k, x in enumerate(self.items):
            by_steps.setdefault(min(STEPS, 1 << (len(x).bit_length() - 1)), []).append(k)
        self.recall = {steps: self._build(steps, members, target) for steps, members in sorted(by_steps.items())}
        #: Items that tables find too seldom.
        self.exact = [k for steps, members in sorted(by_steps.items()) if self.recall[steps] < target for k in members]

    def edits(self, k: int) -> int:
        return int((1.0 - self.similarity) * len(self.items[k]) + 1e-9)

    # -- building ------------------------------------------------------------------------------------------------

    def _build(self, steps: int, members: list[int], target: float) -> float:
        """Tables for the items of one size class; the share of altered items that they find."""
        chosen = [members[i] for i in self.random.permutation(len(members))[:TRIAL_ITEMS]]
        trials = [(k, self._altered(k)) for k in chosen for _ in range(max(1, TRIAL_ITEMS // len(chosen)))]
        found = np.zeros(len(trials), dtype=bool)
        for made in range(1, MAX_TABLES + 1):
            table = self._table(steps, members)
            self.tables.append(table)
            for t in np.flatnonzero(~found):
                k, altered = trials[t]
                found[t] = any(self._entries(table, e, k) for e in self._walk(table, altered)[1])
            if made >= MIN_TABLES and found.mean() >= target:
                break
        return float(found.mean())

    @staticmethod
    def _entries(table: dict, entry: int, item: int) -> bool:
        return any(k == item for k, _ in table["entries"][entry])

    def _altered(self, k: int) -> np.ndarray:
        """An item with the largest allowed number of edits."""
        words = self.items[k].tolist()
        for _ in range(self.edits(k)):
            at, kind = int(self.random.integers(len(words))), int(self.random.integers(3))
            if kind == 0:
                words[at] = 0
            elif kind == 1:
                words.insert(at, 0)
            else:
                del words[at]
        return np.array(words + [0] * STEPS, dtype=np.int32)

    def _table(self, steps: int, members: list[int]) -> dict:
        """A random walk, a sample of its steps, and the keys of the items' windows."""
        later = 1 + self.random.permutation(steps - 1)[:SAMPLED_STEPS - 1] if steps > 1 else []
        table = {"sampled": [0, *sorted(int(j) for j in later)],
                 "bits": self.random.integers(0, 1 << 63, size=len(self.symbols) + 1, dtype=np.uint64),
                 "factor": np.uint64(self.random.integers(1 << 40, 1 << 62) | 1)}
        windows: dict[int, list[tuple[int, int]]] = {}
        prefixes = [np.zeros(SLOTS, dtype=bool) for _ in table["sampled"]]
        for k in members:
            item = self.items[k]
            padded = np.concatenate([item, np.zeros(steps + 1, dtype=np.int32)])
            starts, keys = np.arange(len(item)), []
            for _, key, at in self._steps(table, padded, starts):
                keys.append(key)
            inside = at < len(item)  # the last sampled word still belongs to the item
            for key, slots in zip(keys, prefixes):
                slots[self._slot(key[inside])] = True
            for o in np.flatnonzero(inside):
                windows.setdefault(int(keys[-1][o]), []).append((k, int(o)))
        table["keys"] = np.array(sorted(windows), dtype=np.uint64)
        table["entries"] = [windows[int(key)] for key in table["keys"]]
        table["prefixes"] = prefixes
        return table

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    @staticmethod
    def _steps(table: dict, symbols: np.ndarray, at: np.ndarray):
        """Walk from every start; at each sampled step: the rows left, their keys and places. ``send`` the rows to keep."""
        key = np.zeros(len(at), dtype=np.uint64)
        bits = table["bits"]
        sampled, last = set(table["sampled"]), table["sampled"][-1]
        for j in range(last + 1):
            now = symbols[at]
            if j in sampled:
                key = key * table["factor"] + now.astype(np.uint64)
                keep = yield j, key, at
                if keep is not None:
                    key, at, now = key[keep], at[keep], now[keep]
            if j < last:
                at = at + ((bits[now] >> np.uint64(j)) & np.uint64(1)).astype(np.int64)

    # -- searching -----------------------------------------------------------------------------------------------

    def _walk(self, table: dict, symbols: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Starts of windows whose key is in the table, and the number of that key. ``symbols`` ends with STEPS zeros."""
        if starts is None:
            starts = np.flatnonzero(symbols)
        rows, level = starts, 0
        steps = self._steps(table, symbols, starts)
        _, key, _ = next(steps)
        while True:
            keep = np.flatnonzero(table["prefixes"][level][self._slot(key)])
            rows, key = rows[keep], key[keep]
            level += 1
            if level == len(table["prefixes"]):
                break
            _, key, _ = steps.send(keep)
        entry = np.searchsorted(table["keys"], key)
        entry[entry == len(table["keys"])] = 0
        hit = table["keys"][entry] == key if len(table["keys"]) else np.zeros(len(key), dtype=bool)
        return rows[hit], entry[hit]

    def symbols_of(self, text: str | None) -> np.ndarray:
        look = self.symbols.get
        parts = [np.fromiter(map(look, words, repeat(0)), dtype=np.int32, count=len(words)) for words in word_lists(text)]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)

    def search(self, texts: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
        """Best match for each text (as symbols) and item: text, item, start and end word, distance."""
        if not self.items or not texts:
            return []
        gap = np.zeros(STEPS + 1, dtype=np.int32)
        joined = np.concatenate([p for x in texts for p in (x, gap)])
        begins = np.cumsum([0] + [len(x) + len(gap) for x in texts])
        starts = np.flatnonzero(joined)
        places: dict[tuple[int, int], set[int]] = {}
        for table in self.tables:
            rows, entries = self._walk(table, joined, starts)
            owners = np.searchsorted(begins, rows, side="right") - 1
            for row, owner, entry in zip(rows.tolist(), owners.tolist(), entries.tolist()):
                for k, offset in table["entries"][entry]:
                    places.setdefault((owner, k), set()).add(row - int(begins[owner]) - offset)
        for k in self.exact:
            for owner, words in enumerate(texts):
                places[owner, k] = set(range(0, len(words), len(self.items[k])))  # all in one region
        out = []
        for (owner, k), diagonals in places.items():
            if (best := self._verified(texts[owner], k, diagonals)) is not None:
                out.append((owner, k, best[1], best[2], best[0]))
        return out

    def _verified(self, words: np.ndarray, k: int, diagonals: set[int]) -> tuple[int, int, int] | None:
        item, edits, best = self.items[k], self.edits(k), None
        regions: list[list[int]] = []
        for d in sorted(diagonals):  # an item that starts near d; what overlaps is looked at once
            low, high = max(0, d - 2 * edits), min(len(words), d + len(item) + 2 * edits)
            if regions and low <= regions[-1][1]:
                regions[-1][1] = high
            else:
                regions.append([low, high])
        for low, high in regions:
            region = words[low:high]
            if sum(map(self.members[k].__contains__, region.tolist())) < len(item) - edits:
                continue  # too few of the item's words are there
            distance, start, end = best_stretch(item, region)
            if distance <= edits and (best is None or (distance, start + low) < best[:2]):
                best = (distance, start + low, end + low)
        return best


def item_blocks(benchmark: DataFrame, item_key: str, text: str, size: int = BLOCK_ITEMS) -> Iterator[list[tuple[int, list[str]]]]:
    """The items' words in blocks of about ``size``, one at a time."""
    rows = benchmark.select(F.col(item_key).cast("long").alias("item"), F.col(text).alias("text"))
    blocks = max(1, -(-rows.count() // size))
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        yield [(r["item"], all_words(r["text"])) for r in part.orderBy("item", "text").collect()]


FOUND = "array<struct<item: long, start_word: int, end_word: int, distance: int, similarity: double>>"


def _found_in(text: str, items: list[tuple[int, list[str]]], docs: DataFrame, similarity: float, target: float) -> Column:
    """Array of the items found in each text. Keys of documents stay with Spark: beside a NULL, pandas would round them."""
    index = docs.sparkSession.sparkContext.broadcast(Index(items, similarity, target))  # ``block_items`` at most

    @F.pandas_udf(FOUND)
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at = index.value
        for batch in batches:
            rows: list[list[tuple]] = [[] for _ in range(len(batch))]
            for places, texts in _bounded(range(len(batch)), map(at.symbols_of, batch)):
                for o, k, start, end, d in at.search(texts):
                    rows[places[o]].append((at.ids[k], start, end, d, 1.0 - d / len(at.items[k])))
            yield pd.Series(rows, dtype=object)

    return each(F.col(text))


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
            item_text: str = "text", similarity: float = SIMILARITY, target: float = TARGET_RECALL,
            block_items: int = BLOCK_ITEMS) -> DataFrame:
    """A row for each document and item found in it: key, item, its best stretch of words, distance and similarity."""
    narrow = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = [narrow.select("key", F.explode(_found_in("text", items, docs, similarity, target)).alias("m")).select("key", "m.*")
             for items in item_blocks(benchmark, item_key, item_text, block_items)]
    return reduce(DataFrame.unionByName, found)


def _bounded(places: Iterable[int], texts: Iterable[np.ndarray]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    held: tuple[list, list[np.ndarray]] = ([], [])
    size = 0
    for place, words in zip(places, texts):
        held[0].append(place)
        held[1].append(words)
        size += len(words)
        if size >= BATCH_WORDS:
            yield held
            held, size = ([], []), 0
    if held[0]:
        yield held


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                        item_text: str = "text", similarity: float = SIMILARITY, target: float = TARGET_RECALL,
                        block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``docs`` without the rows whose text contains an item, each judged by its own text. Rows without a key stay."""
    for items in item_blocks(benchmark, item_key, item_text, block_items):
        found = _found_in(text, items, docs, similarity, target)
        docs = docs.where(F.col(key).isNull() | (F.size(found) == 0))
    return docs
