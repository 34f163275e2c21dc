"""Line windows and SimHash groups against brute force."""

import random
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from profilar.llm import line_dedup, simhash
from profilar.llm.components import components


def brute_lines(rows, size=3):
    """Texts without lines under later occurrences; rows equal in key and text are one occurrence."""
    order = lambda r: (r[0] is not None, r[0] or 0)
    first, spots = {}, []
    for r in sorted({r for r in rows if r[1] is not None}, key=order):
        lines = r[1].split("\n")
        for p in range(len(lines) - size + 1):
            spots.append((r, p, tuple(lines[p:p + size])))
    gone = {}
    for r, p, w in spots:
        if w in first and first[w] != (r, p):
            gone.setdefault(r, set()).update(range(p, p + size))
        first.setdefault(w, (r, p))
    return [(r[0], None if r[1] is None else "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in gone.get(r, ())))
            for r in rows]


def test_line_windows(spark):
    rnd = random.Random(4)
    rows = [(k, "\n".join(rnd.choices("abcd", k=rnd.randint(0, 12)))) for k in range(150)] + [(500, None), (None, "a\nb\nc\nd")]
    rows += [rows[3], rows[3], (600, "\n".join("aaaaaaa"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k", F.lit(9)).withColumn("spans", F.lit("x"))
    found = line_dedup.remove_repeated_lines(df).collect()
    assert sorted(map(repr, [(r["doc_id"], r["text"]) for r in found])) == sorted(map(repr, brute_lines(rows)))
    assert {r["k"] for r in found} == {9}


def test_no_line_is_lost_from_the_corpus(spark):
    rnd = random.Random(5)
    rows = [(k, "\n".join(rnd.choices("abcdefgh", k=9))) for k in range(80)]
    kept = line_dedup.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    lines = lambda texts: {x for t in texts for x in t.split("\n")} - {""}
    assert lines(r["text"] for r in kept) == lines(t for _, t in rows)


def test_line_edges(spark, odd_docs, no_docs):
    found = line_dedup.remove_repeated_lines(odd_docs)
    assert found.columns == odd_docs.columns and found.count() == odd_docs.count()
    assert line_dedup.remove_repeated_lines(no_docs).count() == 0


def brute_fingerprint(text, words=4):
    found = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    shingles = [b" ".join(found[k:k + words]) for k in range(len(found) - words + 1)] or ([b" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(points, distance, texts=None, similarity=0.8):
    """Least key reachable through fingerprints within ``distance`` bits or, given texts, similar sets of five-word shingles."""
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    def shingles(text):
        found = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        return {b" ".join(found[k:k + 5]) for k in range(max(1, len(found) - 4))} if found else set()

    sets = {p: shingles(texts[p]) for p in points} if texts else {}
    for (a, x), (b, y) in combinations(points.items(), 2):
        shared = len(sets[a] & sets[b]) if texts else 0
        alike = shared and shared >= similarity * len(sets[a] | sets[b])
        if (alike or bin(x ^ y).count("1") <= distance) and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in points}


def test_fingerprints_and_groups(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    words = rows[0]["text"].split()
    extra = [(10_000 + k, " ".join(words[:k] + ["other"] + words[k + 1:])) for k in range(0, len(words), 7)]
    extra += [(20_000, None), (20_001, ""), (20_002, "One two"), (20_003, "one TWO"), (20_004, "É é")]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    table = table.union(table.where("doc_id < 3"))
    prints = {r["doc_id"]: brute_fingerprint(r["text"]) for r in table.collect()}
    want = brute_roots(prints, 4)
    found = simhash.groups(table).select("key", simhash.hex_digits(F.col("fp")).alias("hex"), "component").collect()
    assert len(found) == table.count()
    for r in found:
        assert r["hex"] == f"{prints[r['key']]:016x}" and r["component"] == want[r["key"]]
    assert sum(want[k] != k for k in want) > 10


def test_similar_texts_keep_one(spark, docs):
    rnd = random.Random(9)
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for k in range(40):  # scattered and bundled edits, and copies of copies
        words = texts[rnd.choice(list(texts))].split()
        for _ in range(max(1, int(len(words) * rnd.choice([0.005, 0.01, 0.02, 0.03])))):
            words[rnd.randrange(len(words))] = f"new{rnd.randrange(10 ** 6)}"
        if k % 3 == 0:
            at = rnd.randrange(len(words))
            words[at:at + len(words) // 12] = []
        texts[10_000 + k] = " ".join(words)
    texts |= {20_000: None, 20_001: "", 20_002: "One two", 20_003: "one TWO", 20_004: "É é"}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    table = table.union(table.where("doc_id < 3")).withColumn("fp", F.lit("clash"))
    want = brute_roots({k: brute_fingerprint(t, 5) for k, t in texts.items()}, 4, texts)
    found = {r["key"]: r["component"] for r in simhash.similar_groups(table).collect()}
    assert found == want and sum(want[k] != k for k in want if k >= 10_000) > 25
    kept = simhash.keep_one(table).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want.values()))


def test_samples_meet_similar_sets():
    rng = np.random.default_rng(10)
    met = 0
    for _ in range(400):
        union = rng.integers(0, 1 << 63, size=200, dtype=np.uint64)
        a, b = union[:180], union[20:]  # similarity 160 / 200
        met += bool((simhash.sampled_fingerprints(a) == simhash.sampled_fingerprints(b)).any())
    assert met / 400 > 0.98


def star(rnd, copies, first):
    """Copies of a text of 204 words, each with four scattered edits; the original has the middle key."""
    words = [f"w{rnd.randrange(10 ** 9)}" for _ in range(204)]
    out = []
    for k in range(copies + 1):
        new = list(words)
        for at in range(4) if k != copies // 2 else ():
            new[rnd.randrange(at * 51 + 5, at * 51 + 46)] = f"new{rnd.randrange(10 ** 9)}"
        out.append((first + k, " ".join(new)))
    return out


def similar_pairs(texts):
    """Pairs at 0.8 or more that agree in a sample."""
    sets = {k: np.unique(simhash.shingle_hashes(t, 5)) for k, t in texts}
    samples = {k: simhash.sampled_fingerprints(s) for k, s in sets.items()}
    for a, b in combinations(sets, 2):
        shared = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        if shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared):
            yield a, b, bool((samples[a] == samples[b]).any())


def test_star_of_copies_is_one_group(spark):
    texts = star(random.Random(11), 500, 0)
    near = list(similar_pairs(texts))
    assert len(near) >= 500 and sum(met for *_, met in near) >= 0.99 * len(near)
    met = {k for a, b, m in near if m and 250 in (a, b) for k in (a, b)}
    table = spark.createDataFrame(texts, "doc_id long, text string")
    for block in (simhash.BLOCK_SHINGLES, 20_000):
        found = {r["key"]: r["component"] for r in simhash.similar_groups(table, block=block).collect()}
        lost = [k for k in met if found[k] != found[250]]
        assert not lost, len(lost)


def test_interleaved_families_of_a_shared_passage(spark):
    rnd = random.Random(12)
    passage = " ".join(f"p{rnd.randrange(10 ** 9)}" for _ in range(100))
    one, two = star(rnd, 30, 0), star(rnd, 30, 0)
    texts = [(2 * k + n, f"{t} {passage}") for n, part in enumerate((one, two)) for k, t in part]
    links = [(a, b) for a, b, met in similar_pairs(texts) if met]
    assert all(a % 2 == b % 2 for a, b in links)
    found = {r["key"]: r["component"] for r in simhash.similar_groups(
        spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert all(found[a] == found[b] for a, b in links) and set(found.values()) == {0, 1}


def test_repeated_keys_with_different_texts(spark):
    rnd = random.Random(14)
    a, b, c = (" ".join(f"{name}{rnd.randrange(10 ** 9)}" for _ in range(100)) for name in "abc")
    rows = [(5, a), (5, b), (5, b), (7, a + " end"), (8, c), (5, c + " end"), (9, c)]
    for seed in range(3):
        table = spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), "doc_id long, text string")
        kept = sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(table.repartition(3)).collect())
        assert kept == sorted([(5, a), (5, b), (5, c + " end")])


def test_merged_roots_by_brute_force():
    rng = np.random.default_rng(13)
    for n in range(40):
        base = rng.integers(0, 50, size=30)
        sets = [np.unique(np.where(rng.random(30) < 0.1, rng.integers(0, 50, size=30), base)) for _ in range(12)]
        roots, block = rng.integers(0, 9, size=12), np.arange(12) * (n % 2 + 1) // 12
        pairs = [(roots[a], roots[b]) for a, b in combinations(range(12), 2) if n % 2 == 0 or block[a] != block[b]
                 if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))]
        label = lambda links: [min(x) for x in _closed(links)]
        assert label(pairs) == label(simhash.merged_roots(sets, roots, block, 0.8))


def _closed(links):
    """For each root from 0 to 8 all that are connected with it."""
    out = [{k} for k in range(9)]
    for _ in range(9):
        for a, b in links:
            out[a] = out[b] = out[a] | out[b]
    return out


def test_grid_join_finds_every_pair_once(spark):
    rnd = random.Random(6)
    points = {}
    for k in range(60):
        base = rnd.getrandbits(64)
        for m in range(6):
            x = base
            for b in rnd.sample(range(64), rnd.randint(0, 4)):
                x ^= 1 << b
            points[x] = k * 10 + m
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x), n) for x, n in points.items()], "fp long, node long")
    for distance in (0, 2, 4, 7):
        found = [tuple(sorted(r)) for r in simhash.links(df, distance).collect()]
        want = {tuple(sorted((points[x], points[y]))) for x, y in combinations(points, 2) if bin(x ^ y).count("1") <= distance}
        assert len(found) == len(set(found)) and set(found) == want


def broadcasts(df):
    return "Broadcast" in df._jdf.queryExecution().executedPlan().toString()


def test_grid_cells_are_not_broadcast(spark):
    df = spark.range(500).select(F.xxhash64("id").alias("fp"), F.col("id").alias("node"))
    assert not broadcasts(simhash.links(df, 4))


def test_sets_are_not_broadcast(spark, tmp_path):
    spark.createDataFrame([(1, [5, 6]), (2, [5, 6]), (3, [7])], "node long, set array<long>").write.parquet(f"{tmp_path}/sets")
    held = spark.read.parquet(f"{tmp_path}/sets")
    dealt = spark.createDataFrame([(0, 9, n, n, n // 3) for n in (1, 2, 3)], "order int, cell long, node long, root long, block long")
    found = simhash._block_links(dealt, held, 0.8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "[node#" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
    assert {tuple(sorted(r)) for r in found.collect()} == {(1, 2)}
    pairs = spark.createDataFrame([(2, 1), (3, 1)], "node long, other long")
    found = simhash._alike(pairs, held, 0.8)
    assert not broadcasts(found) and [tuple(r) for r in found.collect()] == [(2, 1)]


def test_components(spark):
    rnd = random.Random(7)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(180)] + [(1000 + k, 1001 + k) for k in range(70)]
    edges += [(2000, 2001 + k) for k in range(200)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    nodes = {n for e in edges for n in e}
    root = {n: n for n in nodes}
    while True:
        new = dict(root)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == root:
            break
        root = new
    assert found == {n: r for n, r in root.items() if n != r}


def test_simhash_edges(spark, odd_docs, no_docs):
    found = simhash.groups(odd_docs)
    rows = found.collect()
    assert len(rows) == odd_docs.count()
    assert {r["component"] for r in rows if r["fp"] == 0} == {1}  # NULL, empty and blank texts
    kept = simhash.keep_one(odd_docs).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [1, 3, 4, 5, 6, 9]
    assert sum(r["doc_id"] is None for r in kept) == 1
    assert simhash.groups(no_docs).count() == 0
