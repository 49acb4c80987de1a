"""Tables that grow by committed parts.

A part is written to a folder of its own, and counts only once a row of the log names it. A run that stops while it
writes leaves a folder that nobody reads; the part is written again, elsewhere. The log holds a row per part.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "kind string, version bigint, attempt string"
DELTA, BASE = "delta", "base"
COMPACT_AFTER = 16


def log(spark: SparkSession, folder: str) -> DataFrame:
    """kind, version and attempt of every committed part."""
    try:
        return spark.read.schema(LOG).parquet(f"{folder}/log")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def add(df: DataFrame, folder: str, kind: str, version: int) -> None:
    """Write a part, then commit it."""
    attempt = uuid.uuid4().hex
    df.write.parquet(f"{folder}/parts/{attempt}")
    row = df.sparkSession.createDataFrame([(kind, version, attempt)], LOG)
    row.coalesce(1).write.mode("append").parquet(f"{folder}/log")


def committed(spark: SparkSession, folder: str, kinds: Sequence[str]) -> list[tuple[str, int, str]]:
    """The log's rows of these kinds by version; of a version committed twice the first attempt counts."""
    rows = log(spark, folder).where(F.col("kind").isin(*kinds)).groupBy("kind", "version").agg(F.min("attempt").alias("attempt"))
    return sorted((tuple(r) for r in rows.collect()), key=lambda r: r[1])  # a row per part


def read(spark: SparkSession, folder: str, parts: Sequence[tuple[str, int, str]], version: str | None = None) -> DataFrame:
    """The rows of these parts, with their version in a column of that name if one is given."""
    frames = [spark.read.parquet(f"{folder}/parts/{attempt}") for _, _, attempt in parts]
    if version is not None:
        frames = [f.withColumn(version, F.lit(v).cast("bigint")) for f, (_, v, _) in zip(frames, parts)]
    return reduce(DataFrame.unionByName, frames)


# --- keyed merge ------------------------------------------------------------


def _last(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last by ``order``; rows that tie there by their values. Null keys are keys."""
    values = [c for c in rows.columns if c not in keys]
    if not values:
        return rows.distinct()
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order, *values)).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in rows.columns])


def ingest(rows: DataFrame, folder: str, keys: Sequence[str], order: Sequence[str] = (), compact_after: int = COMPACT_AFTER) -> None:
    """Append rows to a table with a natural key: of rows with one key, the last ingested counts.

    Inside one ingest the last by ``order`` counts. Only the new rows are worked on; every ``compact_after`` ingests the
    table is written anew as one part.
    """
    spark = rows.sparkSession
    parts = committed(spark, folder, [DELTA, BASE])
    version = 1 + max((v for _, v, _ in parts), default=0)
    add(_last(rows, keys, order), folder, DELTA, version)
    since = max((v for k, v, _ in parts if k == BASE), default=0)
    if sum(v > since for k, v, _ in parts if k == DELTA) + 1 >= compact_after:
        compact(spark, folder, keys)


def _live(spark: SparkSession, folder: str) -> list[tuple[str, int, str]]:
    parts = committed(spark, folder, [DELTA, BASE])
    bases = [p for p in parts if p[0] == BASE]
    return [*bases[-1:], *[p for p in parts if p[0] == DELTA and p[1] > (bases[-1][1] if bases else 0)]]


def current(spark: SparkSession, folder: str, keys: Sequence[str]) -> DataFrame:
    """The table as it is now: one row per key."""
    parts = _live(spark, folder)
    if not parts:
        raise FileNotFoundError(f"nothing was ingested into {folder}")
    if len(parts) == 1:
        return read(spark, folder, parts)
    return _last(read(spark, folder, parts, "_version"), keys, ["_version"]).drop("_version")


def compact(spark: SparkSession, folder: str, keys: Sequence[str]) -> None:
    """Write the current table as one part; later reads begin there."""
    add(current(spark, folder, keys), folder, BASE, _live(spark, folder)[-1][1])
