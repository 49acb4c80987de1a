"""Writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CSV_WRITE_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> bool:
    """Write CSV with a header. Writes nothing, and says so, when there are no rows."""
    if df.isEmpty():
        return False
    df.write.mode(mode).options(**CSV_WRITE_OPTIONS).csv(path)
    return True


def append_csv(df: DataFrame, path: str) -> bool:
    """Append; every file carries the header, and readers take it as one table."""
    return write_csv(df, path, "append")


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite"
) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def grouped_json(df: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """One JSON array of records per group.

    For selections, which hold at most k rows per group; longer series are
    written one record per line instead.
    """
    fields = F.struct(*df.columns)
    keyed = df.select(F.col(group), F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)], fields.alias("record")).alias("_r"))
    rows = keyed.groupBy(group).agg(F.sort_array(F.collect_list("_r")).alias("_rows"))
    return rows.select(group, F.to_json(F.transform("_rows", lambda r: r["record"])).alias("records"))


def write_selection(df: DataFrame, path: str) -> None:
    """A selection both as JSON grouped by repository and as flat CSV."""
    order = [-F.col("score"), F.col("file_path")]
    write_json(grouped_json(df, "repo_name", order), f"{path}.json")
    write_csv(df.withColumn("score", F.col("score").cast("string")), f"{path}.csv")


def write_series(points: DataFrame, path: str) -> None:
    """Series points as JSON lines, one folder per repository."""
    points.write.mode("overwrite").partitionBy("repo_name").json(path)


def save_corpus(corpus: DataFrame, path: str) -> None:
    """Documents, metadata and vectors, laid out by repository so that scopes prune."""
    write_table(corpus, path, ["repo"])


def load_corpus(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def pending(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work that has no result yet: a stopped run goes on where it was."""
    return work.join(done.select(*keys), list(keys), "left_anti")


def append_batch(results: DataFrame, path: str) -> None:
    """Add finished results to the checkpoint table."""
    results.write.mode("append").parquet(path)


def report_markdown(title: str, note: str, body: Column) -> Column:
    return F.concat(F.lit(f"# {title}\n\n*{note}*\n\n---\n\n"), body)


def report_json(synthesis: Column, metadata: dict[str, Column]) -> Column:
    fields = F.struct(*[v.alias(k) for k, v in metadata.items()])
    return F.to_json(F.struct(synthesis.alias("synthesis"), fields.alias("metadata")))
