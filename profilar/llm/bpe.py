"""Byte-level BPE as a tree reduction over token sequences.

A block of bytes is cut in half, the halves are encoded by themselves, and the two token sequences are joined. A join
re-encodes a window of tokens around the cut and widens it until its outermost tokens come out unchanged. That suffices:
a sequence of tokens is the encoding of its bytes if and only if every two neighbours are the encoding of theirs. (Merges run
by rank, so what happens on both sides of a boundary before a merge crosses it is the same for the pair alone and inside any
longer sequence.) After such a join every pair of neighbours lies in the left sequence, in the window or in the right one.
Joining is associative with the empty sequence as unit, and decoding is the homomorphism back to bytes: both run up a tree.

Texts are cut into pieces by the vocabulary's pattern and each piece is encoded separately, a piece that is itself a
vocabulary entry as that entry. NULL texts count as empty. Results equal those of the ``tiktoken`` library.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

#: Entries of one generation of a memo; a worker keeps two generations of each of its two memos.
MEMO_ENTRIES = 250_000
#: Blocks up to this length are merged by scanning, longer ones with a heap.
SCAN_BYTES = 64
#: Longest piece, in bytes, whose encoding is remembered.
MEMO_BYTES = 48
#: Longest part of a piece, in bytes, whose encoding is remembered; longer parts seldom recur.
PART_BYTES = 8
#: Characters of the texts whose words are gathered at a time; a longer text is gathered alone.
GATHERED_CHARS = 4_000_000
#: Tokens decoded at one leaf of the tree.
LEAF_TOKENS = 4096

Tokens = tuple[int, ...]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file of base64 tokens and numbers."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Memo:
    """Remembered results in two generations: what is used stays, what is not goes when the younger one is full."""

    def __init__(self):
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key, value):
        if len(self.young) >= MEMO_ENTRIES:
            self.old, self.young = self.young, {}
        self.young[key] = value
        return value


class Tokenizer:
    """Encoder and decoder for one vocabulary. ``ranks`` must hold all 256 single bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.sizes = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.digits = [str(i) for i in range(len(self.bytes_of))]
        self._blocks, self._pieces = Memo(), Memo()

    # -- one piece -------------------------------------------------------------------------------------------------

    def merge(self, block: bytes) -> Tokens:
        """Merge neighbours of least rank, leftmost first, until none can be merged: a window's encoding."""
        return self._merge_by_scan(block) if len(block) <= SCAN_BYTES else self._merge_by_heap(block)

    def _merge_by_scan(self, block: bytes) -> Tokens:
        rank, none = self.ranks.get, len(self.bytes_of)
        parts = [block[k:k + 1] for k in range(len(block))]
        pairs = [rank(block[k:k + 2], none) for k in range(len(block) - 1)]
        while pairs and (least := min(pairs)) < none:
            k = pairs.index(least)
            parts[k] += parts.pop(k + 1)
            del pairs[k]
            if k < len(pairs):
                pairs[k] = rank(parts[k] + parts[k + 1], none)
            if k:
                pairs[k - 1] = rank(parts[k - 1] + parts[k], none)
        return tuple(map(self.ranks.__getitem__, parts))

    def _merge_by_heap(self, block: bytes) -> Tokens:
        ranks, n = self.ranks, len(block)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at each byte

        def rank_at(i: int) -> int | None:
            j = end[i]
            return ranks.get(block[i:end[j]]) if j < n else None

        heap = [(r, i) for i in range(n) if (r := rank_at(i)) is not None]
        heapq.heapify(heap)
        live = [True] * n
        while heap:
            r, i = heapq.heappop(heap)
            if not live[i] or rank_at(i) != r:
                continue
            gone = end[i]
            live[gone], end[i] = False, end[gone]
            if end[i] < n:
                before[end[i]] = i
                if (q := rank_at(i)) is not None:
                    heapq.heappush(heap, (q, i))
            if before[i] >= 0 and (q := rank_at(before[i])) is not None:
                heapq.heappush(heap, (q, before[i]))
        out, i = [], 0
        while i < n:
            out.append(ranks[block[i:end[i]]])
            i = end[i]
        return tuple(out)

    def window(self, tokens: Tokens) -> Tokens:
        block = b"".join(map(self.bytes_of.__getitem__, tokens))
        if len(block) > PART_BYTES:
            return self.merge(block)
        known = self._blocks.get(block)
        if known is None:
            known = self._blocks.put(block, self.merge(block))
        return known

    def join(self, left: Tokens, right: Tokens) -> Tokens:
        """Encoding of the bytes of two encodings."""
        if not left or not right:
            return left + right
        i = j = 1
        while True:
            found = self.window(left[-i:] + right[:j])
            left_holds = i == len(left) or found[0] == left[-i]
            right_holds = j == len(right) or found[-1] == right[j - 1]
            if left_holds and right_holds:
                return left[:-i] + found + right[j:]
            if not left_holds:
                i = min(2 * i, len(left))
            if not right_holds:
                j = min(2 * j, len(right))

    def encode_block(self, block: bytes) -> Tokens:
        """Halve, encode, join."""
        if len(block) == 1:
            return (self.ranks[block],)
        known = self._blocks.get(block) if len(block) <= PART_BYTES else None
        if known is None:
            half = len(block) // 2
            known = self.join(self.encode_block(block[:half]), self.encode_block(block[half:]))
            if len(block) <= PART_BYTES:
                self._blocks.put(block, known)
        return known

    def encode_piece(self, piece: str) -> Tokens:
        known = self._pieces.get(piece)
        if known is None:
            block = piece.encode("utf-8")
            whole = self.ranks.get(block)
            known = self.encode_block(block) if whole is None else (whole,)
            if len(block) <= MEMO_BYTES:
                self._pieces.put(piece, known)
        return known

    # -- whole texts -----------------------------------------------------------------------------------------------

    def encode(self, text: str) -> list[int]:
        """Token ids of a whole text."""
        return next(self.encode_all([text])).tolist()

    def encode_all(self, texts: Sequence[str]) -> Iterator[np.ndarray]:
        """Token ids of each of many texts."""
        first = chars = 0
        for k, text in enumerate(texts):
            if chars and chars + len(text) > GATHERED_CHARS:
                yield from self._encode_gathered(texts[first:k])
                first, chars = k, 0
            chars += len(text)
        yield from self._encode_gathered(texts[first:])

    def _encode_gathered(self, texts: Sequence[str]) -> Iterator[np.ndarray]:
        """A space between two characters that are no white space always starts a piece. So a text is the sequence of the
        stretches between such spaces, and each different stretch of the texts is cut and encoded once; other texts are cut by
        the pattern as a whole."""
        spaced = np.array(["  " not in t for t in texts], dtype=bool)
        lists = pc.split_pattern(pa.array([t for t, s in zip(texts, spaced) if s], pa.large_string()), " ")
        stops, words = lists.offsets.to_numpy(), lists.values.dictionary_encode()
        del lists
        codes = words.indices.to_numpy()
        known = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        crossing = np.array([not w or w[-1].isspace() for w in known], dtype=bool)  # white space crosses the cut after it
        begin, size, ids = self._encode_words([w for w, c in zip(known, crossing) if not c])
        place = np.cumsum(~crossing) - 1
        k = 0
        for text, s in zip(texts, spaced):
            if s:
                own = codes[stops[k]:stops[k + 1]]
                k += 1
                if not crossing[own].any():
                    lead, own = self._encode_pieces(self.pattern.findall(known[own[0]])), place[own[1:]]
                    sizes = size[own]
                    past = np.cumsum(sizes)
                    inside = np.arange(past[-1] if len(past) else 0) + np.repeat(begin[own] - past + sizes, sizes)
                    yield np.concatenate([lead, ids[inside]])
                    continue
            yield self._encode_pieces(self.pattern.findall(text))

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the token ids of each word behind a space begin, how many they are, and all of them. No word ends in white space."""
        pieces = self.pattern.findall("".join([" " + w for w in words]))
        found = self._known_pieces(pieces)
        tokens = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        until = np.searchsorted(np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))), ends, "right")
        bounds = tokens[np.concatenate([[0], until])]
        return bounds[:-1], np.diff(bounds), np.fromiter(chain.from_iterable(found), np.int64, int(tokens[-1]))

    def _known_pieces(self, pieces: list[str]) -> list[Tokens]:
        found = list(map(self._pieces.young.get, pieces))
        for k, known in enumerate(found):
            if known is None:
                found[k] = self.encode_piece(pieces[k])
        return found

    def _encode_pieces(self, pieces: list[str]) -> np.ndarray:
        return np.array(list(chain.from_iterable(self._known_pieces(pieces))), dtype=np.int64)

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of token ids, concatenated up a tree of blocks."""
        level = [b"".join(map(self.bytes_of.__getitem__, ids[k:k + LEAF_TOKENS])) for k in range(0, len(ids), LEAF_TOKENS)]
        while len(level) > 1:
            level = [b"".join(level[k:k + 2]) for k in range(0, len(level), 2)]
        return level[0] if level else b""


_loaded: dict[str, Tokenizer] = {}


def shared_tokenizer(name: str, ranks, pattern: str) -> Tokenizer:
    """The worker's tokenizer for a vocabulary, made once. ``ranks``: a broadcast of the rank table."""
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = Tokenizer(ranks.value, pattern)
    return _loaded[name]


def broadcast_ranks(df: DataFrame, path: str, pattern: str):
    """The vocabulary for the executors, and its name. Its size is that of a vocabulary, whatever the table's."""
    ranks = read_ranks(path)
    name = hashlib.sha256(repr((path, len(ranks), pattern)).encode()).hexdigest()
    return df.sparkSession.sparkContext.broadcast(ranks), name


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``docs`` with an array of token ids for each text."""
    ranks, name = broadcast_ranks(docs, vocabulary, pattern)

    @F.pandas_udf("array<int>")
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = shared_tokenizer(name, ranks, pattern)
        for batch in batches:
            yield pd.Series(list(tokenizer.encode_all([t or "" for t in batch])))

    return docs.withColumn(ids, each(F.col(text)))


def decode(docs: DataFrame, vocabulary: str, pattern: str, ids: str = "token_ids", data: str = "decoded") -> DataFrame:
    """``docs`` with the bytes of each array of token ids; NULL gives no bytes."""
    ranks, name = broadcast_ranks(docs, vocabulary, pattern)

    @F.pandas_udf("binary")
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = shared_tokenizer(name, ranks, pattern)
        for batch in batches:
            yield pd.Series([tokenizer.decode([] if t is None else list(t)) for t in batch])

    return docs.withColumn(data, each(F.col(ids)))


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with the number of tokens and the SHA-256 of the ids and of the bytes decoded from them.

    One pass: ids and bytes of a text are made and summed up in the same task, so neither is stored.
    """
    ranks, name = broadcast_ranks(docs, vocabulary, pattern)

    @F.pandas_udf(DIGEST)
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokenizer = shared_tokenizer(name, ranks, pattern)
        for batch in batches:
            rows = []
            for found in map(np.ndarray.tolist, tokenizer.encode_all([t or "" for t in batch])):
                line = ",".join(map(tokenizer.digits.__getitem__, found))
                rows.append((len(found), hashlib.sha256(line.encode()).hexdigest(),
                             hashlib.sha256(tokenizer.decode(found)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    out = docs.withColumn("__digest", each(F.col(text)))
    return out.select(*docs.columns, "__digest.*")
