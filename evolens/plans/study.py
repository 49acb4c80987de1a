"""Comparing two ways of selecting entities, and example series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evolens.functions import fixed_values as fv
from evolens.functions import times
from evolens.operators import selection as sel
from evolens.operators.history import earliest_per_key
from evolens.operators.joins import lookup_join
from evolens.session import materialise


def commit_dates(snapshots: DataFrame, ingest_order: str) -> DataFrame:
    """The first known date of every commit; rows without a hash or a valid date are skipped."""
    dated = snapshots.withColumn("commit_date", times.parse_instant(F.col("commit_date"))).filter(
        (F.length("commit_hash") > 0) & F.col("commit_date").isNotNull()
    )
    keys = ["repo_name", "commit_hash"]
    return earliest_per_key(dated, keys, [ingest_order], ["commit_date"])


def longest_series(
    metrics: DataFrame,
    dates: DataFrame,
    metric: str = "loc_after",
    repos: Sequence[str] | None = None,
) -> DataFrame:
    """The points of the file with the most rows in each repository, dated and sorted.

    Ties go to the largest path. Points without a date come last.
    """
    rows = sel.only_repos(metrics, repos).filter(F.length("file_path") > 0)
    sizes = rows.groupBy("repo_name", "file_path").agg(F.count("*").alias("n"))
    longest = sizes.groupBy("repo_name").agg(
        F.max_by("file_path", F.struct("n", "file_path")).alias("file_path")
    )
    points = lookup_join(
        rows, materialise(longest), ["repo_name", "file_path"], "left_semi", salt_on=["commit_hash"]
    )
    # Only the commits of these points are dated; the semi join goes below the parsing and grouping of all dates.
    points, keys = materialise(points), ["repo_name", "commit_hash"]
    needed = points.select(*keys).distinct()
    dated = points.join(lookup_join(dates, needed, keys, "left_semi", salt_on=["commit_hash"]), keys, "left")
    return dated.select(
        "repo_name",
        "file_path",
        F.lit(metric).alias("metric"),
        F.coalesce("commit_hash", F.lit("")).alias("commit_hash"),
        "commit_date",
        F.col(metric).cast("string").alias("metric_value"),
    ).orderBy("repo_name", F.col("commit_date").asc_nulls_last(), "commit_hash")


def first_series(series: DataFrame) -> DataFrame:
    """The clean, sorted series of the first repository by name, ready for a chart.

    Points whose date or value cannot be read are dropped.
    """
    first = series.agg(F.min("repo_name").alias("repo_name")).scalar()
    chosen = series.filter(F.col("repo_name") == first)
    clean = chosen.withColumns(
        {
            "commit_date": times.parse_instant(F.col("commit_date").cast("string")),
            "metric_value": times.parse_number(F.col("metric_value")),
        }
    ).dropna(subset=["commit_date", "metric_value"])
    return clean.orderBy("commit_date", "commit_hash")


def compare_selections(
    changes: DataFrame,
    analysis: DataFrame,
    metadata: DataFrame,
    k: int = fv.TOP_K,
    repos: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """Both selections and the three tables that compare them."""
    frequent = sel.select_by_commit_count(sel.commit_counts(changes, repos), k)
    unusual = sel.select_by_anomaly(analysis, k, repos)
    both = sel.selection_with_mode(frequent, fv.MODE_FREQUENCY).unionByName(
        sel.selection_with_mode(unusual, fv.MODE_ANOMALY)
    )
    assignments = sel.cluster_assignments(analysis, repos)
    return {
        "selection_frequency": frequent,
        "selection_anomaly": unusual,
        "selection_quality": sel.selection_quality(both, metadata, k),
        "cluster_coverage": sel.cluster_coverage(both, assignments, k),
        "file_type_distribution": sel.file_type_distribution(both, metadata),
    }
