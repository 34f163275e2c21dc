"""SimHash near-duplicate groups by a grid join on segment bit counts.

A fingerprint's 64 bits are cut into 32 segments of two bits. The counts of set bits form its embedding: the Manhattan
distance of two embeddings never exceeds the Hamming distance of the fingerprints. Counts are kept in unary (0, 01, 11), so
that distance is one ``bit_count``. Eight groups of four segments span the grid: two fingerprints within ``k`` < 8 bits have
equal counts in at least ``8 - k`` groups, so they meet in a cell made of ``8 - k`` groups' counts. Each pair is judged in
the first cell it shares only: Manhattan distance first, exact Hamming distance last. No link is lost or repeated.

Only distinct fingerprints meet: copies, however many, are one row there. NULL and word-free texts have fingerprint zero
and are linked like any other. NULL keys never name a group unless the group has no other key.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from profilar.llm.components import components
from profilar.session import save_and_reload

SHINGLE_WORDS = 4
MAX_DISTANCE = 4
GROUPS = 8
SEED = 42
#: Of groups by similarity: words of a shingle, least share of common shingles, fingerprints of samples and their size.
STAGE_WORDS = 5
SIMILARITY = 0.8
SAMPLES = 12
SAMPLE_SHINGLES = 4
#: Of a cell's texts compared with each other in one task: their shingles, and what a text counts beside its own.
BLOCK_SHINGLES = 1 << 20
TEXT_SHINGLES = 256
EVEN_BITS = 0x5555555555555555


def shingle_hashes(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of a text's word shingles, repeats included; of all words if they are fewer."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if len(found) < words:
        shingles = iter([b" ".join(found)] if found else [])
    else:
        shingles = map(b" ".join, zip(*[found[k:] for k in range(words)]))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64)


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Majority bits of the shingles' 64-bit hashes, as a signed number."""
    return majority(shingle_hashes(text, words))


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes; none for no hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):  # bounded memory for very long texts
        block = np.unpackbits(hashes[at:at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += block.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, key: str, text: str, words: int = SHINGLE_WORDS) -> DataFrame:
    """Columns ``key`` and ``fp`` (long) for every row. Keys stay with Spark: beside a NULL, pandas would round them."""
    @F.pandas_udf("long")
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(t, words) for t in batch], dtype=np.int64)

    return docs.select(F.col(key).cast("long").alias("key"), each(F.col(text)).alias("fp"))


def unary_counts(fp: Column) -> Column:
    """The 32 segment counts, two bits each: none, one or both set."""
    half = F.shiftrightunsigned(fp, 1)
    some, all_ = fp.bitwiseOR(half).bitwiseAND(F.lit(EVEN_BITS)), fp.bitwiseAND(half).bitwiseAND(F.lit(EVEN_BITS))
    return some.bitwiseOR(F.shiftleft(all_, 1))


def cells(points: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """``points`` (fp, node) once for each cell that they lie in."""
    if not 0 <= distance < GROUPS:
        raise ValueError(f"distance must be below {GROUPS}")
    choices = list(combinations(range(GROUPS), GROUPS - distance))
    counts = points.select("fp", "node", unary_counts(F.col("fp")).alias("counts"))
    table = F.array(*[F.struct(
        F.lit(sum(1 << g for g in c)).alias("groups"),
        F.lit(int.from_bytes(bytes(255 if g in c else 0 for g in range(GROUPS)), "little", signed=True)).alias("mask"))
        for c in choices])
    dealt = counts.select("fp", "node", "counts", F.explode(table).alias("c"))
    return dealt.select("fp", "node", F.col("c.groups").alias("groups"), F.col("counts").bitwiseAND(F.col("c.mask")).alias("cell"))


def links(points: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """Every pair of different fingerprints within ``distance`` bits, once: ``a``, ``b`` (nodes).

    Cells are merged, never broadcast: Spark sizes them as ``points``, of which they are up to 70 times the rows.
    """
    placed = cells(points, distance).hint("merge")
    left, right = placed.alias("l"), placed.alias("r")
    lf, rf = F.col("l.fp"), F.col("r.fp")
    differ = unary_counts(lf).bitwiseXOR(unary_counts(rf))
    same = sum((F.when(F.shiftrightunsigned(differ, 8 * g).bitwiseAND(F.lit(255)) == 0, 1 << g).otherwise(0)
                for g in range(GROUPS)), F.lit(0))
    chosen = F.col("l.groups")
    # the first shared cell takes the lowest equal groups: no other equal group lies below its highest one
    below = F.lit(0)
    for g in range(GROUPS):
        below = F.when(chosen >= (1 << g), (1 << g) - 1).otherwise(below)
    first = same.bitwiseXOR(chosen).bitwiseAND(below) == 0
    joined = left.join(right, (F.col("l.groups") == F.col("r.groups")) & (F.col("l.cell") == F.col("r.cell")) & (lf < rf)
                       & (F.bit_count(differ) <= distance) & (F.bit_count(lf.bitwiseXOR(rf)) <= distance) & first)
    return joined.select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS,
           distance: int = MAX_DISTANCE) -> DataFrame:
    """``key``, ``fp`` and ``component`` (least key reachable) for every row, repeated rows included.

    Fingerprints are linked whatever their keys are; a key of several texts has a row, and maybe a group, for each.
    """
    marked = save_and_reload(fingerprints(docs, key, text, words), "fingerprints")
    points = save_and_reload(marked.groupBy("fp").agg(F.min("key").alias("least")), "points")
    roots = save_and_reload(components(links(points.select("fp", F.col("fp").alias("node")), distance), "a", "b"), "roots")
    linked = roots.select(F.col("node").alias("fp"), "root").union(roots.select(F.col("root").alias("fp"), "root").distinct())
    names = linked.join(points, "fp").groupBy("root").agg(F.min("least").alias("name"))
    named = points.join(linked.join(names, "root"), "fp", "left")
    named = named.select("fp", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("name")).alias("component"))
    return marked.join(save_and_reload(named, "named"), "fp").select("key", "fp", "component")


def text_hash(text: str) -> Column:
    """Hash that names a text; NULL as empty."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def sampled_fingerprints(hashes: np.ndarray, samples: int = SAMPLES, size: int = SAMPLE_SHINGLES) -> np.ndarray:
    """A fingerprint for each of several random orders of the shingles: of the first ``size`` different ones."""
    distinct = np.unique(hashes)
    if not len(distinct):
        return np.zeros(0, dtype=np.int64)
    factors = np.random.default_rng(SEED).integers(0, 1 << 63, size=samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    size = min(size, len(distinct))
    out = np.empty((samples, size), dtype=np.uint64)
    for k, factor in enumerate(factors):
        order = (distinct ^ (distinct >> np.uint64(29))) * factor
        order ^= order >> np.uint64(32)
        out[k] = distinct[np.argpartition(order, size - 1)[:size]]
    bits = np.unpackbits(out.view(np.uint8).reshape(samples, size, 8), axis=2, bitorder="little").sum(axis=1, dtype=np.int64)
    return np.packbits(2 * bits > size, axis=1, bitorder="little").view(np.int64)[:, 0]


def merged_roots(sets: list[np.ndarray], roots: np.ndarray, block: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of roots with texts whose sets overlap by ``similarity``: enough of them to connect all that do.

    Every pair of texts of different roots is judged, of one block or, if there are two, of both; roots connected on the way
    are one. ``sets`` are of different hashes.
    """
    left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    own = block.min() == block.max()
    size = np.array([len(s) for s in sets])
    values, owner = np.concatenate([sets[k] for k in right]), np.repeat(np.arange(len(right)), size[right])
    by_value = np.argsort(values, kind="stable")
    values, owner = values[by_value], owner[by_value]
    _, label = np.unique(roots, return_inverse=True)
    out = []
    for k in left:
        other = label[right] != label[k]
        if own:
            other &= right > k
        if not other.any():
            continue
        low = np.searchsorted(values, sets[k], side="left")
        n = np.searchsorted(values, sets[k], side="right") - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(owner[at], minlength=len(right))
        met = right[other & (shared >= similarity * (size[k] + size[right] - shared))]
        for j in met:
            if label[j] != label[k]:
                out.append((int(roots[k]), int(roots[j])))
                label[label == label[j]] = label[k]
    return out


def _similar_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = STAGE_WORDS,
                   similarity: float = SIMILARITY, distance: int = MAX_DISTANCE, block: int = BLOCK_SHINGLES) -> tuple[DataFrame, DataFrame]:
    """Rows with a key (key, t, fp), and the group of each different text (t, fp, lead: least ``least`` and ``t`` of its group).

    Fingerprints within a few bits belong to nearly equal texts only; at a similarity of 0.8 they differ in about ten bits of
    64. So texts are also linked whose sets of shingles overlap by ``similarity`` (shared over all, verified exactly).
    Candidates agree in the fingerprint of a sample: ``SAMPLES`` random orders of the shingles each give the fingerprint of
    the first ``SAMPLE_SHINGLES``, so a pair at 0.8 is met with a probability of 1 - (1 - 0.8^4)^12 = 0.998. Every pair that
    meets is judged unless it is connected already: first each text with its cell's first and with its predecessor, which
    connects most copies; then, in cells that still hold texts of several groups, all pairs of different groups, by blocks of
    ``block`` shingles that return links between groups only. Equal texts are one row throughout, named by their hash ``t``:
    keys may repeat with different texts.
    """
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch["text"]:
                hashes = shingle_hashes(t, words)
                rows.append((majority(hashes), len(hashes), sampled_fingerprints(hashes)))
            yield pd.DataFrame({"key": batch["key"], "t": batch["t"], "fp": [r[0] for r in rows],
                                "size": [r[1] for r in rows], "samples": [r[2] for r in rows]})

    narrow = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"),
                                                    text_hash(text).alias("t"))
    marked = save_and_reload(narrow.mapInPandas(each, "key long, t long, fp long, size long, samples array<long>"), "marked")
    texts = save_and_reload(marked.groupBy("t", "fp").agg(
        F.min("key").alias("least"), F.min("size").alias("size"), F.min_by("samples", "key").alias("samples")
    ).withColumn("node", F.col("t")), "texts")
    points = save_and_reload(texts.groupBy("fp").agg(F.min("node").alias("first")), "points")
    near = links(points.withColumnRenamed("first", "node"), distance)
    same = texts.join(points, "fp").where(F.col("node") != F.col("first")).select(F.col("node").alias("a"), F.col("first").alias("b"))

    cells = texts.select("node", "size", F.posexplode("samples").alias("order", "cell"))
    cell = Window.partitionBy("order", "cell")
    met = cells.select("*", F.min("node").over(cell).alias("first"), F.count("*").over(cell).alias("n"),
                       F.lag("node").over(cell.orderBy("node")).alias("last"))
    met = save_and_reload(met.where(F.col("n") > 1), "met")
    pairs = met.where(F.col("last").isNotNull()).select("node", F.explode(F.array_distinct(F.array("first", "last"))).alias("other"))
    pairs = save_and_reload(pairs.distinct(), "pairs")
    needed = pairs.select("node").union(pairs.select(F.col("other").alias("node"))).distinct()

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": batch["t"], "set": [np.unique(shingle_hashes(t, words)).view(np.int64) for t in batch["text"]]})

    rows = texts.join(needed, "node", "left_semi").select("t", F.col("least").alias("key"))
    held = save_and_reload(narrow.join(rows, ["key", "t"], "left_semi").mapInPandas(
        sets, "node long, set array<long>").dropDuplicates(["node"]), "sets")
    roots = components(near.union(same).union(_alike(pairs, held, similarity)), "a", "b")
    # of three texts in a cell every pair is judged by now
    placed = met.where(F.col("n") > 3).join(roots, "node", "left").select(
        "order", "cell", "node", "size", F.coalesce("root", "node").alias("root"))
    open_ = placed.select("*", F.min("root").over(cell).alias("low"), F.max("root").over(cell).alias("high")).where(
        F.col("low") != F.col("high"))
    weight = F.col("size") + TEXT_SHINGLES
    before = F.sum(weight).over(cell.orderBy("root", "node").rowsBetween(Window.unboundedPreceding, 0)) - weight
    dealt = save_and_reload(open_.select("order", "cell", "node", "root", F.floor(before / block).cast("long").alias("block")), "dealt")
    if not dealt.isEmpty():
        roots = _joined(roots, components(save_and_reload(_block_links(dealt, held, similarity), "merged"), "a", "b"))
    rooted = save_and_reload(texts.join(roots, "node", "left").select("t", "fp", "least", F.coalesce("root", "node").alias("root")),
                             "rooted")
    leads = rooted.groupBy("root").agg(F.min(F.struct("least", "t")).alias("lead"))
    return marked.select("key", "t", "fp"), save_and_reload(rooted.join(leads, "root").select("t", "fp", "lead"), "named")


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = STAGE_WORDS,
                   similarity: float = SIMILARITY, distance: int = MAX_DISTANCE, block: int = BLOCK_SHINGLES) -> DataFrame:
    """``key`` and ``component`` (least key of the group) for every row with a key; see ``_similar_texts``.

    Groups have one name if they share their least key, which only a key of different texts makes possible.
    """
    marked, named = _similar_texts(docs, key, text, words, similarity, distance, block)
    return marked.join(named, ["t", "fp"]).select("key", F.col("lead.least").alias("component"))


def _alike(pairs: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """``a``, ``b``: the ``pairs`` (node, other) whose sets in ``held`` (node, set) overlap by ``similarity``.

    Sets are merged, never broadcast: sets of near copies are many times larger in rows than in the file that Spark sizes them by.
    """
    held = held.hint("merge")
    both = pairs.join(held, "node").join(held.select(F.col("node").alias("other"), F.col("set").alias("set2")), "other")
    shared = F.size(F.array_intersect("set", "set2"))
    return both.where(shared >= similarity * (F.size("set") + F.size("set2") - shared)).select(
        F.col("node").alias("a"), F.col("other").alias("b"))


def _block_links(dealt: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """``a``, ``b``: roots to merge, from every pair of texts in ``dealt`` (order, cell, block, node, root) of different roots."""
    blocks = dealt.groupBy("order", "cell", "block").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    first = blocks.select("order", "cell", F.col("block").alias("i"), "low")
    second = blocks.select("order", "cell", F.col("block").alias("j"), "high")
    # blocks follow the roots' order: all of one root if the first block's least is the second's greatest
    judged = first.join(second, ["order", "cell"]).where((F.col("i") <= F.col("j")) & (F.col("low") != F.col("high")))
    parts = judged.select("order", "cell", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    rows = parts.join(dealt, ["order", "cell", "block"]).join(held.hint("merge"), "node")

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(merged_roots(list(group["set"]), group["root"].to_numpy(), group["block"].to_numpy(), similarity),
                            columns=["a", "b"], dtype="int64")

    return rows.select("order", "cell", "i", "j", "block", "root", "set").groupBy("order", "cell", "i", "j").applyInPandas(
        merged, "a long, b long")


def _joined(roots: DataFrame, merged: DataFrame) -> DataFrame:
    """``roots`` (node, root) where roots are nodes of ``merged``, too."""
    onward = merged.select(F.col("node").alias("root"), F.col("root").alias("onward"))
    moved = roots.join(onward, "root", "left").select("node", F.coalesce("onward", "root").alias("root"))
    return moved.union(merged.join(roots.select("node"), "node", "left_anti"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = STAGE_WORDS,
             similarity: float = SIMILARITY, distance: int = MAX_DISTANCE) -> DataFrame:
    """``docs`` with the row of the least key of each group; rows without a key stay.

    Of rows equal in key and text one stays, that of the least hash. A key of different texts has each of them judged by
    itself: the least key and, under it, the text of least hash leads a group.
    """
    _, named = _similar_texts(docs, key, text, words, similarity, distance)
    kept = named.where(F.col("t") == F.col("lead.t")).select(F.col("lead.least").alias("__key"), F.col("t").alias("__t")).distinct()
    marked = docs.where(F.col(key).isNotNull()).withColumn("__key", F.col(key).cast("long")).withColumn("__t", text_hash(text))
    equal = Window.partitionBy("__key", "__t").orderBy(F.xxhash64(*docs.columns))
    held = marked.join(kept, ["__key", "__t"], "left_semi").withColumn("__n", F.row_number().over(equal)).where("__n = 1")
    return held.select(*docs.columns).unionByName(docs.where(F.col(key).isNull()))
