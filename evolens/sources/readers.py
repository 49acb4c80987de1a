"""Readers. Schemas are always given, never inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evolens.functions import fixed_values as fv
from evolens.functions import paths
from evolens.sources import split_csv

# Blank cells read as null and quoted empty cells as empty text.
CSV_READ_OPTIONS = {
    "header": "true",
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "encoding": "UTF-8",
    "mode": "PERMISSIVE",
    "nullValue": "\u0000",
}


def read_csv(
    spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """CSV with a header, quoted line breaks and doubled quotes; bad bytes are replaced. Files are read in many tasks."""
    df = split_csv.parse(split_csv.records(spark, path), schema, CSV_READ_OPTIONS)
    return df if columns is None else df.select(*columns)


def read_json(
    spark: SparkSession, path: str, schema: str, single_array: bool = False
) -> DataFrame:
    """JSON records: one per line, or one array per file when ``single_array`` is set."""
    return spark.read.schema(schema).option("multiLine", single_array).json(path)


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Parquet, reading only the named columns."""
    return spark.read.parquet(path).select(*columns)


def head_files(
    listing: DataFrame, path: str = "path", suffixes: Sequence[str] = fv.HEAD_SUFFIXES
) -> DataFrame:
    """Files of a listing that have a source suffix, with forward slashes."""
    kept = listing.filter(paths.has_suffix(F.col(path), suffixes))
    return kept.withColumn(path, paths.normalise(F.col(path)))


def list_files(spark: SparkSession, root: str, repo: str) -> DataFrame:
    """A HEAD listing from a checked-out tree; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), f"^\\Q{root.rstrip('/')}\\E/", "")
    return head_files(
        files.select(F.lit(repo).alias("repo_name"), relative.alias("file_path")), "file_path"
    )


def selection_rows(df: DataFrame, json: Column, mode: str) -> DataFrame:
    """Rows of a JSON map from repository to a list of records or paths.

    An element is an object with ``file_path`` or the path itself; empty paths are skipped.
    """
    lists = F.from_json(json, "map<string,array<string>>")
    entries = df.select(F.explode(lists).alias("repo", "entries")).select(
        "repo", F.explode("entries").alias("entry")
    )
    file_path = F.when(
        F.col("entry").startswith("{"), F.get_json_object("entry", "$.file_path")
    ).otherwise(F.col("entry"))
    return entries.select("repo", file_path.alias("file_path"), F.lit(mode).alias("mode")).filter(
        F.length("file_path") > 0
    )


def with_content(df: DataFrame, contents: DataFrame) -> DataFrame:
    """Add the content of each file at its commit; null where there is none."""
    keys = ["repo_name", "commit_hash", "file_path"]
    return df.join(contents.select(*keys, "content"), keys, "left")
