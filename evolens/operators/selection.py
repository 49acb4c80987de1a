"""Selecting entities: counts, top-k per group, dominant categories, coverage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evolens.functions import fixed_values as fv
from evolens.functions import paths


SKETCH_PRECISION = 12


def only_repos(df: DataFrame, repos: Sequence[str] | None) -> DataFrame:
    """Rows of the given repositories; all of them when none are given."""
    return df if repos is None else df.filter(F.col("repo_name").isin(*repos))


def filter_repo(df: DataFrame, repo: str | None) -> DataFrame:
    """Rows of one repository. Fails, naming those there are, when it has no rows."""
    if repo is None:
        return df
    chosen = df.filter(F.col("repo_name") == repo)
    if chosen.isEmpty():
        known = df.select("repo_name").distinct().orderBy("repo_name").collect()
        names = ", ".join(str(r.repo_name) for r in known)
        raise ValueError(f"no rows for repository '{repo}'; available: {names}")
    return chosen


def _filled(column: str) -> Column:
    return F.length(column) > 0


def commit_counts(changes: DataFrame, repos: Sequence[str] | None = None) -> DataFrame:
    """Distinct commits per file; rows without a path or commit are skipped."""
    rows = only_repos(changes, repos).filter(_filled("file_path") & _filled("commit_hash"))
    return rows.groupBy("repo_name", "file_path").agg(
        F.count_distinct("commit_hash").alias("n_commits")
    )


def commit_sketches(changes: DataFrame, precision: int = SKETCH_PRECISION) -> DataFrame:
    """A mergeable sketch of the different commits of each file: stored once, and united with those of later changes."""
    rows = changes.filter(_filled("file_path") & _filled("commit_hash"))
    return rows.groupBy("repo_name", "file_path").agg(F.hll_sketch_agg("commit_hash", F.lit(precision)).alias("sketch"))


def merged_counts(*sketches: DataFrame) -> DataFrame:
    """About how many different commits each file has in all tables of sketches together; no change is read again.

    The standard error is `sketch_error(precision)` of the count; counts that small sketches hold whole are exact.
    """
    every = reduce(DataFrame.unionByName, sketches)
    merged = every.groupBy("repo_name", "file_path").agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.select("repo_name", "file_path", F.hll_sketch_estimate("sketch").alias("n_commits"))


def sketch_error(precision: int = SKETCH_PRECISION) -> float:
    return 1.04 / 2 ** (precision / 2)


def top_k_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int = fv.TOP_K
) -> DataFrame:
    """The first ``k`` rows of every group with their ``rank``.

    Spark keeps k rows per group on the map side, so a hot group ships k rows per task.
    For k above 1,000 raise ``spark.sql.optimizer.windowGroupLimitThreshold`` with it.
    """
    ranked = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)


def select_by_commit_count(counts: DataFrame, k: int = fv.TOP_K) -> DataFrame:
    top = top_k_per_group(counts, ["repo_name"], [F.desc("n_commits"), F.asc("file_path")], k)
    return top.select(
        "repo_name",
        "file_path",
        F.col("n_commits").cast("double").alias("score"),
        F.lit("commit_count").alias("score_label"),
    )


def select_by_anomaly(
    analysis: DataFrame, k: int = fv.TOP_K, repos: Sequence[str] | None = None
) -> DataFrame:
    scored = only_repos(analysis, repos).select(
        "repo_name",
        F.coalesce("file_path", F.lit("")).alias("file_path"),
        F.coalesce(F.col("anomaly_score").cast("double"), F.lit(0.0)).alias("score"),
        F.lit("anomaly_score").alias("score_label"),
    )
    top = top_k_per_group(scored, ["repo_name"], [F.desc("score"), F.asc("file_path")], k)
    return top.drop("rank")


def top_k(
    df: DataFrame, criterion: str, k: int = fv.TOP_K, ties: Sequence[str] = ("repo_name", "file_path")
) -> DataFrame:
    """The ``k`` rows with the highest criterion; a missing one counts as 0."""
    return df.orderBy(F.coalesce(F.col(criterion), F.lit(0)).desc(), *ties).limit(k)


def cluster_assignments(analysis: DataFrame, repos: Sequence[str] | None = None) -> DataFrame:
    return only_repos(analysis, repos).select(
        "repo_name",
        *[
            F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
            for c in ("file_path", "cluster_id", "anomaly_score")
        ],
    )


def file_metadata(
    tables: Sequence[DataFrame], repos: Sequence[str] | None = None
) -> DataFrame:
    """Every file named in any table, once, with its type."""
    union = None
    for table in tables:
        keys = only_repos(table, repos).select("repo_name", "file_path").filter(_filled("file_path"))
        union = keys if union is None else union.unionByName(keys)
    return union.distinct().withColumn("file_type", paths.file_type(F.col("file_path")))


def selection_with_mode(selection: DataFrame, mode: str) -> DataFrame:
    return selection.select(F.col("repo_name").alias("repo"), "file_path", F.lit(mode).alias("mode"))


def _type_counts(selections: DataFrame, metadata: DataFrame) -> DataFrame:
    meta = metadata.withColumnRenamed("repo_name", "repo")
    joined = selections.join(meta, ["repo", "file_path"], "left")
    return (
        joined.filter(F.col("file_type").isNotNull())
        .groupBy("repo", "mode", "file_type")
        .agg(F.count("*").alias("count"))
    )


def selection_quality(
    selections: DataFrame, metadata: DataFrame, k_fixed: int = fv.TOP_K
) -> DataFrame:
    """The dominant file type per repository and mode."""
    counts = _type_counts(selections, metadata)
    first = top_k_per_group(
        counts, ["repo", "mode"], [F.desc("count"), F.asc("file_type")], k=1
    )
    return first.select(
        "repo",
        "mode",
        F.lit(k_fixed).alias("k_fixed"),
        F.col("file_type").alias("dominant_file_type"),
        "count",
    )


def file_type_distribution(selections: DataFrame, metadata: DataFrame) -> DataFrame:
    """The share of each file type per repository and mode, in percent."""
    counts = _type_counts(selections, metadata)
    total = F.sum("count").over(Window.partitionBy("repo", "mode"))
    return counts.select(
        "repo", "mode", "file_type", F.bround(100 * F.col("count") / total, 2).alias("percent")
    )


def cluster_coverage(
    selections: DataFrame, assignments: DataFrame, files_explained: int = fv.TOP_K
) -> DataFrame:
    """Distinct clusters among the selected files; files without a cluster do not count."""
    clusters = assignments.select(
        F.col("repo_name").alias("repo"), "file_path", F.nullif("cluster_id", F.lit("")).alias("cluster_id")
    )
    joined = selections.join(clusters, ["repo", "file_path"], "left")
    return joined.groupBy("repo", "mode").agg(
        F.lit(files_explained).alias("files_explained"),
        F.count_distinct("cluster_id").alias("clusters_covered"),
    )


def dedupe_last(df: DataFrame, keys: Sequence[str], ingest_order: str) -> DataFrame:
    """Keep the row ingested last for every key."""
    from evolens.operators.history import latest_per_key

    return latest_per_key(df, keys, [ingest_order])


def dedupe_first(df: DataFrame, keys: Sequence[str], ingest_order: str) -> DataFrame:
    """Keep the row ingested first for every key."""
    from evolens.operators.history import earliest_per_key

    return earliest_per_key(df, keys, [ingest_order])


def latest_by_frequency(
    changes: DataFrame, snapshots: DataFrame, time: str, k: int = fv.TOP_K
) -> DataFrame:
    """The latest snapshot of the ``k`` most often changed paths."""
    from evolens.operators.history import latest_per_key

    frequent = (
        changes.groupBy("file_path")
        .agg(F.count("*").alias("n_changes"))
        .orderBy(F.desc("n_changes"), F.asc("file_path"))
        .limit(k)
    )
    # k rows: the snapshots stay where they are and only k paths are aggregated.
    chosen = snapshots.join(F.broadcast(frequent), "file_path")
    return latest_per_key(chosen, ["file_path"], [time, "commit_hash"])
