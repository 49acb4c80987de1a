"""Summaries: clusters, components, labels, profiles, coverage and run counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evolens.functions import fixed_values as fv
from evolens.functions import paths
from evolens.functions.labels import cluster_label


# Output name of each cluster average and the feature it is taken from.
CLUSTER_AVERAGES = {
    "avg_churn_rate": "churn_rate",
    "avg_cc_after": "mean_cc_after",
    "avg_cc_trend": "cc_trend",
    "avg_mi_after": "mean_mi_after",
    "avg_mi_trend": "mi_trend",
    "avg_mi_volatility": "std_mi_after",
    "avg_imports_after": "mean_imports_after",
    "avg_imports_trend": "imports_trend",
    "avg_std_cc_after": "std_cc_after",
    "avg_std_imports_after": "std_imports_after",
    "avg_func_after": "mean_func_after",
}


def _label_counts(column: str, labels: Sequence[str]) -> Column:
    pairs = F.array(
        *[
            F.struct(F.lit(v).alias("key"), F.count_if(F.col(column) == v).alias("value"))
            for v in labels
        ]
    )
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"] > 0))


def cluster_summary(labelled: DataFrame) -> DataFrame:
    """One row per cluster in one aggregate: size, averages, label counts and a name."""
    return (
        labelled.groupBy("cluster_id")
        .agg(
            F.count("*").alias("size"),
            *[F.avg(source).alias(name) for name, source in CLUSTER_AVERAGES.items()],
            _label_counts("churn_label", ("high", "moderate", "low")).alias(
                "churn_label_distribution"
            ),
            _label_counts("cc_trend_label", ("increasing", "stable", "decreasing")).alias(
                "cc_trend_label_distribution"
            ),
        )
        .withColumn(
            "derived_cluster_label",
            cluster_label(F.col("avg_churn_rate"), F.col("avg_cc_trend"), F.col("avg_std_cc_after")),
        )
    )


def label_distribution(df: DataFrame, group: str, label: str) -> DataFrame:
    """Rows per group and label, in long form."""
    return df.groupBy(group, label).agg(F.count("*").alias("rows"))


def cluster_lookup(clusters: DataFrame, list_order: str) -> DataFrame:
    """Records of a cluster list by key: ``cluster_id``, else ``id``, else unknown; the last one wins."""
    from evolens.operators.history import latest_per_key

    keyed = clusters.withColumn(
        "cluster_key",
        F.coalesce(F.col("cluster_id").cast("string"), F.col("id").cast("string"), F.lit("unknown")),
    )
    return latest_per_key(keyed, ["cluster_key"], [list_order])


def cluster_lookup_from_map(df: DataFrame, column: str) -> DataFrame:
    """The same lookup when the records come as a map from key to record."""
    return df.select(F.explode(column).alias("cluster_key", "record")).select(
        "cluster_key", "record.*"
    )


def component_summary(explanations: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Files, mean anomaly and distinct clusters per component.

    The set per component holds cluster ids only, of which there are few.
    """
    component = paths.component(F.col("file")).alias("component")
    summary = explanations.groupBy(*group, component).agg(
        F.count("*").alias("files"),
        F.bround(F.avg(F.coalesce("anomaly_score", F.lit(0.0))), 2).alias("avg_anomaly"),
        F.sort_array(F.collect_set("cluster")).alias("clusters"),
    )
    return summary.withColumn(
        "line",
        F.format_string(
            fv.COMPONENT_LINE,
            F.col("component"),
            F.col("files"),
            F.col("avg_anomaly"),
            F.array_join(F.transform("clusters", lambda c: F.concat(F.lit("'"), c, F.lit("'"))), ", "),
        ),
    )


def grounding_metrics(
    explanations: DataFrame, quantified: Column | None = None
) -> DataFrame:
    """Four rates in percent and the number of files; all 0 without files.

    A row without validation (an error row) counts as grounded and as over the
    word limit. ``quantified`` decides what counts as a comparison; by default
    the text holds an x, and ``quantified_strict`` asks for a number before it.
    """
    text = F.coalesce("explanation", F.lit(""))
    violated = F.coalesce(F.size("validation.violations"), F.lit(0)) > 0
    within = F.coalesce(F.col("validation.word_count"), F.lit(fv.MAX_WORDS + 1)) <= fv.MAX_WORDS
    quantified = text.contains("x") if quantified is None else quantified

    def rate(condition: Column) -> Column:
        return F.coalesce(F.try_divide(F.count_if(condition) * 100.0, F.count("*")), F.lit(0.0))

    return explanations.agg(
        rate(~violated).alias("commit_grounding_rate"),
        rate(quantified).alias("quantified_comparison_rate"),
        rate(within).alias("word_limit_compliance"),
        rate(violated).alias("violation_rate"),
        F.count("*").alias("total_files"),
    )


def quantified_strict(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"[0-9]\s?[x×]")


def files_per_commit(changes: DataFrame) -> DataFrame:
    """Files and distinct files of every commit."""
    return changes.groupBy("repo_name", "commit_hash").agg(
        F.count("*").alias("files"), F.count_distinct("file_path").alias("distinct_files")
    )


def commit_totals(per_commit: DataFrame) -> DataFrame:
    return per_commit.agg(
        F.count("*").alias("total_commits"), F.coalesce(F.sum("files"), F.lit(0)).alias("total_files")
    )


def entity_profile(
    df: DataFrame, keys: Sequence[str], delta: str, value: str
) -> DataFrame:
    """Raw profile per entity, for checking reported numbers by hand."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.count_if(~F.col(delta).eqNullSafe(F.lit(0))).alias("non_zero"),
        F.avg(F.abs(delta)).alias("mean_abs_delta"),
        F.avg(value).alias("mean_value"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.stddev_samp(value).alias("std_value"),
    )


def substring_profile(df: DataFrame, path: str, fragment: str, values: Sequence[str]) -> DataFrame:
    """Rows, distinct files and mean values of the files whose path holds a fragment."""
    chosen = df.filter(F.coalesce(F.col(path).contains(fragment), F.lit(False)))
    return chosen.agg(
        F.count("*").alias("rows"),
        F.count_distinct(path).alias("files"),
        *[F.avg(v).alias(f"mean_{v}") for v in values],
    )


def overview(analysis: DataFrame) -> DataFrame:
    """Files, mean anomaly and clusters present: one row."""
    return analysis.agg(
        F.count("*").alias("files_analyzed"),
        F.coalesce(F.bround(F.avg("anomaly_score"), 3), F.lit(0.0)).alias("avg_anomaly"),
        F.count_distinct("cluster_id").alias("clusters_present"),
    )


def count_by(df: DataFrame, column: str, output: str = "rows") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias(output))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def dashboard_filter(
    analysis: DataFrame,
    repo: str | None = None,
    clusters: Sequence[int] | None = None,
    min_anomaly: float = 0.0,
) -> DataFrame:
    if repo is not None:
        analysis = analysis.filter(F.col("repo_name") == repo)
    if clusters is not None:
        analysis = analysis.filter(F.col("cluster_id").isin(*clusters))
    return analysis.filter(F.col("anomaly_score") >= min_anomaly)


DASHBOARD_COLUMNS = (
    "file_path",
    "cluster_id",
    "anomaly_score",
    "raw_churn_rate",
    "hist_cc_value",
    "n_commits",
)


def dashboard_table(flat: DataFrame) -> DataFrame:
    return flat.select(*DASHBOARD_COLUMNS).orderBy(F.desc("anomaly_score"), "file_path")


def scatter_inputs(flat: DataFrame) -> DataFrame:
    """The columns behind churn against anomaly and churn against complexity slope."""
    return flat.select(
        "file_path", "n_commits", "cluster_id", "raw_churn_rate", "anomaly_score", "hist_cc_value"
    )


# Name of each label list, and the flat column and value it selects.
LABEL_SLICES = {
    "high_churn": ("churn_label", "high"),
    "increasing_complexity": ("hist_cc_label", "increasing"),
    "decreasing_maintainability": ("hist_mi_label", "decreasing"),
    "oscillating_imports": ("imports_volatility_label", "oscillating"),
}


def label_slice(flat: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    """The entities with one telling label, highest anomaly first."""
    column, value = LABEL_SLICES[name]
    rows = flat.filter(F.col(column) == value)
    ordered = rows.orderBy(F.desc("anomaly_score"), "repo_name", "file_path")
    return ordered if limit is None else ordered.limit(limit)


def label_slice_totals(flat: DataFrame) -> DataFrame:
    """How many entities carry each telling label, in one pass."""
    return flat.agg(
        *[
            F.count_if(F.col(column) == value).alias(name)
            for name, (column, value) in LABEL_SLICES.items()
        ]
    )


def content_availability(snapshots: DataFrame) -> DataFrame:
    with_content = F.count_if(F.coalesce("content_available", F.lit(False)))
    return snapshots.agg(
        F.count("*").alias("snapshots"),
        with_content.alias("with_content"),
        F.coalesce(F.try_divide(with_content * 100.0, F.count("*")), F.lit(0.0)).alias("percent"),
    )


def row_counts(inputs: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of every input, one row each."""
    counts = [
        df.agg(F.lit(name).alias("input"), F.count("*").alias("rows"))
        for name, df in inputs.items()
    ]
    return reduce(DataFrame.unionByName, counts)
