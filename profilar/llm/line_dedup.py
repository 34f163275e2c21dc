"""Removal of repeated three-line windows, in DataFrame functions only.

Every three consecutive lines of a text form a window; windows overlap. A window that occurs more than once keeps its first
occurrence, by (key, text hash, position); the lines that later occurrences cover are merged into spans and removed. As the
first occurrence of a line's earliest window is never covered, no line's content is lost from the corpus.

Texts of fewer than three lines have no window and stay as they are, NULL stays NULL, and a text covered throughout becomes
the empty text. Rows equal in key and text count as one occurrence and get the same result. Lines are compared exactly and
end with ``\\n`` only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from profilar.session import save_and_reload

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(docs: DataFrame, key: str, text: str, size: int = WINDOW) -> DataFrame:
    """A row per window: key, text hash, position of its first line, and 128 bits of hash over its lines."""
    def at(lines: Column, i: Column) -> Column:
        parts = [F.get(lines, i + k) for k in range(size)]
        return F.struct(i.alias("pos"), F.xxhash64(*parts).alias("h1"),
                        F.xxhash64(F.lit("second"), *parts[::-1]).alias("h2"))

    lined = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("t"), _lines(F.col(text)).alias("lines"))
    lined = lined.where(F.size("lines") >= size)
    hashed = lined.select("k", "t", F.explode(F.transform(
        F.sequence(F.lit(0), F.size("lines") - size), lambda i: at(F.col("lines"), i))).alias("w"))
    return hashed.select("k", "t", "w.pos", "w.h1", "w.h2")


def repeated(found: DataFrame) -> DataFrame:
    """The first occurrence of each window that has others."""
    first = found.groupBy("h1", "h2").agg(F.min(F.struct("k", "t", "pos")).alias("first"),
                                          F.max(F.struct("k", "t", "pos")).alias("last"))
    return first.where(F.col("first") != F.col("last")).select("h1", "h2", "first")


def removed_spans(docs: DataFrame, key: str, text: str, size: int = WINDOW) -> DataFrame:
    """Key, text hash and the spans [start, end) of lines to remove, for each text that has any."""
    found = windows(docs, key, text, size)
    # a table of its own: the join then deals both sides by itself and can split a window that fills many rows
    first = save_and_reload(repeated(found), "first_windows")
    later = found.join(first, ["h1", "h2"]).where(F.struct("k", "t", "pos") > F.col("first"))
    starts = later.groupBy("k", "t").agg(F.array_sort(F.collect_set("pos")).alias("s"))
    s, n = F.col("s"), F.size("s")
    begins = F.filter(s, lambda x, i: (i == 0) | (x > F.get(s, i - 1) + size))
    ends = F.transform(F.filter(s, lambda x, i: (i == n - 1) | (F.get(s, i + 1) > x + size)), lambda x: x + size)
    return starts.select("k", "t", F.transform(F.arrays_zip(begins.alias("b"), ends.alias("e")),
                                               lambda z: F.struct(z["b"].alias("start"), z["e"].alias("end"))).alias("spans"))


def keep_lines(text: Column, spans: Column) -> Column:
    """A text without the lines in ascending, disjoint spans."""
    lines = _lines(text)
    last = F.size(spans)
    kept = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
        F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"]).alias("a"),
        F.when(i == last, F.size(lines)).otherwise(F.get(spans, i)["start"]).alias("b")))
    return F.array_join(F.flatten(F.transform(kept, lambda z: F.slice(lines, z["a"] + 1, z["b"] - z["a"]))), "\n")


def remove_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW,
                          spans: str | None = None) -> DataFrame:
    """``docs`` with shortened texts; ``spans`` names a column for what was removed (NULL: nothing)."""
    gone = removed_spans(docs, key, text, size).select(
        F.col("k").alias("__k"), F.col("t").alias("__t"), F.col("spans").alias("__spans"))
    joined = docs.join(gone, F.col(key).eqNullSafe(F.col("__k")) & (F.xxhash64(text) == F.col("__t")), "left")
    shorter = F.when(F.col("__spans").isNull(), F.col(text)).otherwise(keep_lines(F.col(text), F.col("__spans")))
    out = joined.withColumn(text, shorter)
    if spans:
        out = out.withColumn(spans, F.col("__spans"))
    return out.drop("__k", "__t", "__spans")
