"""Readers for the text files and tables the analysis uses."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path, schema: str | T.StructType | None = None, **options) -> DataFrame:
    """CSV with a header line. Give a schema at scale; without one Spark reads the data twice."""
    reader = spark.read.option("header", True).option("multiLine", False)
    reader = reader.option("ignoreTrailingWhiteSpace", True).options(**options)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_tagged(spark: SparkSession, paths: Mapping[str, str], schema=None, tag: str = "site",
                **options) -> DataFrame:
    """Many files stacked, each row tagged with the key of its file."""
    frames = [read_csv(spark, p, schema, **options).withColumn(tag, F.lit(k)) for k, p in paths.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def file_key(position: int, pattern: str = "_|[.]") -> Column:
    """One-based part of the source file's own name."""
    return F.get(F.split(F.col("_metadata.file_name"), pattern), position - 1)


def read_folder(spark: SparkSession, folder: str, glob: str, schema, keys: Mapping[str, int],
                recursive: bool = False) -> DataFrame:
    """All files of a folder whose names fit a glob, in one scan, with keys taken from the name."""
    df = read_csv(spark, folder, schema, pathGlobFilter=glob,
                  recursiveFileLookup=str(recursive).lower())
    return df.select("*", *[file_key(pos).alias(name) for name, pos in keys.items()])


def _fields(line: str | Column) -> Column:
    """Blank-separated fields; a quoted field may hold blanks and loses its quotes."""
    pieces = F.regexp_extract_all(line, F.lit(r'("[^"]*"|\S+)'), 1)
    return F.transform(pieces, lambda c: F.regexp_replace(c, '^"(.*)"$', "$1"))


def read_whitespace(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Table split on runs of blanks, with a header line; NA is missing.

    The header is recognised by its text, so each file may be split freely
    among tasks.
    """
    header = F.array(*[F.lit(n) for n in schema.fieldNames()])
    lines = spark.read.text(path).where(F.trim("value") != "").select(_fields("value").alias("p"))
    rows = lines.where(F.col("p") != header)
    return rows.select(
        *[
            F.when(F.get("p", F.lit(i)) != "NA", F.get("p", F.lit(i)).try_cast(f.dataType)).alias(f.name)
            for i, f in enumerate(schema.fields)
        ]
    )


def whitespace_header(spark: SparkSession, path: str) -> list[str]:
    """Names in the first line of a whitespace table."""
    return spark.read.text(path).select(_fields("value").alias("p")).first()["p"]


def stack_tagged(frames: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """Named frames stacked with their name in a column."""
    parts = [f.withColumn(tag, F.lit(k)) for k, f in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_results(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}")
