"""Appending new change files to a history table as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from evolens.sources.readers import CSV_READ_OPTIONS


def new_files(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of the rows of CSV files put into ``folder``."""
    return spark.readStream.schema(schema).options(**CSV_READ_OPTIONS).csv(folder)


def append_available(rows: DataFrame, table: str, progress: str) -> StreamingQuery:
    """Append what has arrived since the last call, each file once, and stop.

    ``progress`` remembers the files taken, so running it again adds nothing twice.
    """
    return (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start(table)
    )
