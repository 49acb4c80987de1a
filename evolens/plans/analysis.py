"""From a metric history to analysed entities, end to end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evolens.functions import fixed_values as fv
from evolens.functions.labels import add_rule_labels
from evolens.operators.clustering import cluster_auto_k
from evolens.operators.history import KEYS, ORDER, entity_features
from evolens.operators.isolation import anomaly_scores
from evolens.operators.joins import assert_inside, inside, with_commit_time
from evolens.operators.scaling import fit_scaler
from evolens.operators.selection import filter_repo
from evolens.operators.summary import cluster_summary
from evolens.session import materialise

_RAW = (
    "churn_rate",
    "mean_abs_loc_delta",
    "mean_cc_after",
    "mean_mi_after",
    "mean_imports_after",
    "mean_func_after",
    "std_cc_after",
    "std_imports_after",
)


def pack(labelled: DataFrame) -> DataFrame:
    """The nested record of every analysed entity, rounded for display."""
    def at(column: str, digits: int) -> Column:
        return F.bround(F.col(column).cast("double"), digits)

    def struct(**fields: Column) -> Column:
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    def history(metric: str) -> Column:
        return struct(value=at(f"{metric}_trend", 6), label=F.col(f"{metric}_trend_label"))

    def recent(metric: str) -> Column:
        return struct(
            value=at(f"recent_{metric}_trend", 6),
            vs_historical=F.col(f"recent_{metric}_trend_vs_historical"),
        )

    return labelled.select(
        "repo_name",
        "file_path",
        F.col("n_commits").cast("int").alias("n_commits"),
        F.col("cluster_id").cast("int").alias("cluster_id"),
        at("anomaly_score", 4).alias("anomaly_score"),
        "churn_label",
        "cc_volatility_label",
        "imports_volatility_label",
        struct(cc=history("cc"), mi=history("mi"), imports=history("imports")).alias(
            "historical_trends"
        ),
        struct(
            cc=recent("cc"), mi=struct(value=at("recent_mi_trend", 6)), imports=recent("imports")
        ).alias("recent_trends"),
        struct(cc=F.col("recent_cc_volatility_vs_historical")).alias("volatility_comparison"),
        struct(**{c: at(c, 4) for c in _RAW}).alias("raw_features"),
    )


# Nested column and the prefix of its flat columns.
_FLATTENED = {"raw_features": "raw", "historical_trends": "hist", "recent_trends": "recent"}


def flatten(packed: DataFrame) -> DataFrame:
    """The nested record as flat columns named by path, such as ``hist_cc_value``."""
    def leaves(field: StructType, path: str, name: str):
        for child in field.fields:
            inner_path, inner_name = f"{path}.{child.name}", f"{name}_{child.name}"
            if isinstance(child.dataType, StructType):
                yield from leaves(child.dataType, inner_path, inner_name)
            else:
                yield F.col(inner_path).alias(inner_name)

    columns = [F.col(c) for c in packed.columns if c not in _FLATTENED]
    for column, prefix in _FLATTENED.items():
        columns += leaves(packed.schema[column].dataType, column, prefix)
    return packed.select(*columns)


def analyse_entities(
    history: DataFrame,
    head: DataFrame | None = None,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER,
    min_commits: int = fv.MIN_COMMITS,
    recent_window: int = fv.RECENT_WINDOW,
) -> DataFrame:
    """Features, cluster, anomaly score and labels of every entity with enough history.

    Entities missing from ``head`` are left out after aggregation, when there is
    one row per entity and no hot key left. The feature table is written once and
    read by every pass of clustering and scoring.
    """
    features = entity_features(history, keys, order, recent=recent_window, min_rows=min_commits)
    if head is not None:
        features = inside(features, head, keys)
    features = materialise(features)
    points = fit_scaler(features, fv.FEATURE_NAMES).transform(features, "scaled")
    points = materialise(points)
    clustered = cluster_auto_k(points, keys)
    scored = materialise(anomaly_scores(clustered, keys))
    return add_rule_labels(scored.drop("scaled"))


def evolution(
    metrics: DataFrame,
    commits: DataFrame,
    head: DataFrame,
    min_commits: int = fv.MIN_COMMITS,
    recent_window: int = fv.RECENT_WINDOW,
    repo: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The whole run: the packed record of every entity, and the cluster summary."""
    timed = with_commit_time(filter_repo(metrics, repo), commits)
    labelled = analyse_entities(
        timed, head, min_commits=min_commits, recent_window=recent_window
    )
    packed = assert_inside(pack(labelled), head, KEYS)
    return packed, cluster_summary(labelled)
