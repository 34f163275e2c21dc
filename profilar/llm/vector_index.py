"""Nearest neighbours by an inverted multi-index.

Both halves of the vectors get a codebook of their own; a vector's cell is the pair of its nearest centroids. A query visits
cells in ascending order of the summed squared distances to both centroids: a heap walks the pairs of the two sorted lists. It
stops when the visited cells hold the wanted share of all entries. That share is measured while the codebooks are trained: it is
what sample queries need to meet ``target`` of their true neighbours. Entries of the visited cells are reranked by exact
distance.

A codebook has as many centroids as the cube root of the number of entries, within 64 and 1,024: visiting a cell costs a step of
the heap, so cells must hold more entries the more there are of them. Codebooks are trained on 128 vectors per centroid at most,
up to ``sample`` (least key hash); every vector is indexed. Equal vectors are one entry with its smallest ``k + 1`` keys, all
that any answer can hold, and equal queries are searched once.

Centroids are numbered along their leading direction, so that neighbours in number lie near each other. The entries of a first
centroid are dealt to parts of bounded size by ranges of the second, queries to blocks by ranges of their first; what exceeds a
part is split by hash. An entry is shuffled to a block only if one of the block's queries visits the entry's cell.

NULL keys and NULL, zero or non-finite vectors (or with a NULL component) take no part, nor do vectors of another length than
the commonest (ties: the shorter). Repeated rows count once. Ties in distance go to the smaller key.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from profilar.llm.samples import least_hashed
from profilar.session import save_and_reload

LEAST_CENTROIDS, MOST_CENTROIDS = 64, 1024
PER_CENTROID = 128
SAMPLE = 32_768
SAMPLE_QUERIES = 256
ROUNDS = 12
TARGET_RECALL = 0.97
BLOCK = 4096
WALKS = 512  # queries that one task leads through the cells: little data, much work
PROBE = ["p", "v", "visited", "qb", "i", "part", "js"]


def usable(vector: Column, width: int) -> Column:
    """A finite, non-zero vector of the given length."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(vector) == width) & finite & F.exists(vector, lambda x: x != 0)


def common_width(vectors: DataFrame, vector: str) -> int:
    row = vectors.where(F.size(vector) > 0).groupBy(F.size(vector).alias("w")).count().orderBy(F.desc("count"), "w").first()
    return 0 if row is None else int(row["w"])


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``."""
    return np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * a @ b.T)


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids of at most ``k`` groups, from distinct rows."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = distinct[np.random.default_rng(seed).choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        near = squared(x, centres).argmin(axis=1)
        count = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, x[:, d], k) for d in range(x.shape[1])], axis=1)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def along_leading_direction(centres: np.ndarray) -> np.ndarray:
    """Centroids in the order of their projections on their leading direction."""
    if len(centres) < 2 or not centres.shape[1]:
        return centres
    centred = centres - centres.mean(axis=0)
    leading = np.linalg.eigh(centred.T @ centred)[1][:, -1]
    return centres[np.argsort(centred @ leading, kind="stable")]


def centroid_count(entries: int) -> int:
    return int(min(MOST_CENTROIDS, max(LEAST_CENTROIDS, np.ceil(np.cbrt(entries)))))


def dealt(sizes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """First block of each size along the last axis, and the number of blocks that it spreads over."""
    ends = np.cumsum(sizes, axis=-1)
    first = (ends - sizes) // block
    return first, np.maximum(1, (ends - 1) // block - first + 1)


@dataclass
class Codebooks:
    """Centroids of the two halves and the share of entries that a query visits."""

    first: np.ndarray
    second: np.ndarray
    share: float = 1.0

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.first.shape[1]
        return squared(x[:, :cut], self.first), squared(x[:, cut:], self.second)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.halves(x)
        return a.argmin(axis=1), b.argmin(axis=1)


def train(x: np.ndarray, k: int, centroids: int = LEAST_CENTROIDS, target: float = TARGET_RECALL, seed: int = 7) -> Codebooks:
    """Codebooks of a sample, and the share of entries within which its queries find ``target`` of their ``k`` nearest."""
    cut = x.shape[1] // 2
    books = Codebooks(along_leading_direction(k_means(x[:, :cut], centroids, ROUNDS, seed)),
                      along_leading_direction(k_means(x[:, cut:], centroids, ROUNDS, seed + 1)))
    asked = np.random.default_rng(seed).permutation(len(x))[:SAMPLE_QUERIES]
    i, j = books.cells(x)
    needed = []
    for q in asked:
        a, b = books.halves(x[q:q + 1])
        reached = a[0, i] + b[0, j]
        order = squared(x[q:q + 1], x)[0]
        order[q] = np.inf
        near = np.argsort(order, kind="stable")[:min(k, len(x) - 1)]
        needed += [(reached <= reached[n]).mean() for n in near]
    books.share = float(np.quantile(needed, target)) if needed else 1.0
    return books


def visit(to_first: np.ndarray, to_second: np.ndarray, sizes: np.ndarray, wanted: float) -> list[tuple[int, int]]:
    """Pairs of centroids by ascending sum of distances until their cells hold ``wanted`` entries."""
    rows, columns = np.argsort(to_first, kind="stable"), np.argsort(to_second, kind="stable")
    a, b, size = to_first[rows].tolist(), to_second[columns].tolist(), sizes[np.ix_(rows, columns)]
    reach = [0] * len(a)  # columns taken so far of each row: a pair is open if the row above is ahead of it
    heap, held, out = [(a[0] + b[0], 0, 0)], 0, []
    while heap and held < wanted:
        _, r, c = heapq.heappop(heap)
        reach[r] = c + 1
        if size[r, c]:
            held += int(size[r, c])
            out.append((int(rows[r]), int(columns[c])))
        if c + 1 < len(b) and (r == 0 or reach[r - 1] > c + 1):
            heapq.heappush(heap, (a[r] + b[c + 1], r, c + 1))
        if r + 1 < len(a) and reach[r + 1] == c:
            heapq.heappush(heap, (a[r + 1] + b[c], r + 1, c))
    return out


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, width))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding",
            centroids: int | None = None, sample: int = SAMPLE, target: float = TARGET_RECALL,
            block: int = BLOCK) -> DataFrame:
    """The ``k`` nearest other rows of each query row: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``, and ``visited``,
    the share of all entries that lie in the cells the query visited."""
    spark = vectors.sparkSession
    width = common_width(vectors, vector)
    rows = (vectors.where(F.col(key).isNotNull() & usable(F.col(vector), width))
            .select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("asks"))
            .groupBy("v", "id").agg(F.max("asks").alias("asks")))
    smallest = Window.partitionBy("v").orderBy("id")
    points = (rows.withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k + 1)
              .groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("point", F.get("ids", F.lit(0))))
    # a key with several vectors may lead several points
    points = save_and_reload(points.select(F.format_string("%d-%x", "point", F.xxhash64("v")).alias("p"), "v", "ids"), "points")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, visited double")

    centroids = centroids or centroid_count(points.count())
    taken = least_hashed(points, F.xxhash64("p"), min(sample, PER_CENTROID * centroids)).select("v").toPandas()  # ``sample`` rows at most
    if not len(taken):
        return empty
    books = spark.sparkContext.broadcast(train(_matrix(taken["v"], width), k, centroids, target))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                i, j = books.value.cells(_matrix(batch["v"], width))
                yield batch.assign(i=i.astype(np.int32), j=j.astype(np.int32))

    placed = save_and_reload(points.mapInPandas(place, "p string, v array<double>, ids array<long>, i int, j int"), "placed")
    counts = placed.groupBy("i", "j").count().toPandas()  # centroids squared at most
    sizes = np.zeros((len(books.value.first), len(books.value.second)), dtype=np.int64)
    sizes[counts["i"], counts["j"]] = counts["count"]
    total = int(sizes.sum())
    wanted = max(k + 1, int(np.ceil(books.value.share * total)))
    asking = save_and_reload(rows.where("asks").select("id", "v").join(placed.select("v", "p", "i"), "v"), "asking")
    queries = asking.select("p", "v", "i").distinct()
    asked = np.zeros(len(sizes), dtype=np.int64)
    for row in queries.groupBy("i").count().collect():  # as many as centroids
        asked[row["i"]] = row["count"]
    deals = spark.sparkContext.broadcast((sizes, dealt(sizes, block), dealt(asked, block)))  # centroids squared

    @F.pandas_udf("int")
    def part_of(i: pd.Series, j: pd.Series, number: pd.Series) -> pd.Series:
        first, pieces = (x[i.to_numpy(), j.to_numpy()] for x in deals.value[1])
        return pd.Series((first + number.to_numpy() % pieces).astype(np.int32))

    @F.pandas_udf("int")
    def block_of(i: pd.Series, number: pd.Series) -> pd.Series:
        first, pieces = (x[i.to_numpy()] for x in deals.value[2])
        return pd.Series((first + number.to_numpy() % pieces).astype(np.int32))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each query and part that it visits, and one without a query for all of a batch that visit the part."""
        first, pieces = deals.value[1]
        for batch in batches:
            if not len(batch):
                continue
            to_first, to_second = books.value.halves(_matrix(batch["v"], width))
            out, asked_for = [], {}
            for n, row in enumerate(batch.itertuples(index=False)):
                by_part: dict[tuple[int, int], list[int]] = {}
                held = 0
                for i, j in visit(to_first[n], to_second[n], deals.value[0], wanted):
                    held += int(deals.value[0][i, j])
                    for part in range(first[i, j], first[i, j] + pieces[i, j]):
                        by_part.setdefault((i, part), []).append(j)
                for (i, part), js in by_part.items():
                    out.append((row.p, row.v, held / total, row.qb, i, part, js))
                    asked_for.setdefault((row.qb, i, part), set()).update(js)
                if len(out) >= block:
                    yield pd.DataFrame(out, columns=PROBE)
                    out = []
            out += [(None, None, None, qb, i, part, sorted(js)) for (qb, i, part), js in asked_for.items()]
            yield pd.DataFrame(out, columns=PROBE)

    number = F.pmod(F.xxhash64("p"), F.lit(1 << 31))
    blocked = queries.select("p", "v", block_of("i", number).alias("qb")).repartition(max(1, -(-int(asked.sum()) // WALKS)), "p")
    visits = save_and_reload(blocked.mapInPandas(
        walk, "p string, v array<double>, visited double, qb int, i int, part int, js array<int>"), "visits")
    probes = visits.where(F.col("p").isNotNull()).toDF(*PROBE)
    demand = (visits.where(F.col("p").isNull()).groupBy("qb", "i", "part")
              .agg(F.array_distinct(F.flatten(F.collect_list("js"))).alias("js")))  # numbers of centroids, of each batch once
    entries = (placed.withColumn("part", part_of("i", "j", number)).select("i", "j", "part", "v", "ids")
               .join(demand, ["i", "part"]).where(F.array_contains("js", F.col("j"))).drop("js"))

    def rerank(near: pd.DataFrame, far: pd.DataFrame) -> pd.DataFrame:
        if not len(near) or not len(far):
            return pd.DataFrame([], columns=["p", "visited", "score", "ids"], dtype=object)
        q, e, codes = _matrix(near["v"], width), _matrix(far["v"], width), far["j"].to_numpy()
        ids, out = far["ids"].to_numpy(), []
        lists, names, shares = near["js"].to_numpy(), near["p"].to_numpy(), near["visited"].to_numpy()
        for at in range(0, len(q), 256):
            rough = squared(q[at:at + 256], e)
            for n in range(len(rough)):
                inside = np.flatnonzero(np.isin(codes, lists[at + n]))
                if len(inside) > 2 * (k + 1):  # exact distances decide near the edge
                    edge = np.partition(rough[n, inside], k)[k]
                    inside = inside[rough[n, inside] <= edge + 1e-9 * (1.0 + edge)]
                score = np.sqrt(((e[inside] - q[at + n]) ** 2).sum(axis=1))
                out += [(names[at + n], shares[at + n], s, ids[m]) for s, m in zip(score, inside)]
        return pd.DataFrame(out, columns=["p", "visited", "score", "ids"])

    keys = ["i", "part", "qb"]
    found = probes.groupBy(*keys).cogroup(entries.groupBy(*keys)).applyInPandas(
        rerank, "p string, visited double, score double, ids array<long>")
    best = Window.partitionBy("p").orderBy("score", "vec_id")
    top = (found.select("p", "visited", "score", F.explode("ids").alias("vec_id"))
           .withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1))
    own = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (asking.select(F.col("id").alias("query_id"), "p").distinct().join(top, "p")
            .where(F.col("query_id") != F.col("vec_id"))
            .withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score", "visited"))
