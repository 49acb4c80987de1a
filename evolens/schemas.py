"""Explicit schemas of the tables the library reads and writes, as Spark DDL."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame

COMMITS = (
    "repo_name string, commit_hash string, parent_hash string, author string, "
    "timestamp timestamp, message string"
)
FILE_CHANGES = "repo_name string, commit_hash string, file_path string, change_type string"
DIFFS = "repo_name string, commit_hash string, file_path string, diff_text string"
METRICS = (
    "repo_name string, commit_hash string, file_path string, language string, "
    "loc_before int, loc_after int, loc_delta int, "
    "cc_before double, cc_after double, cc_delta double, "
    "mi_before double, mi_after double, mi_delta double, "
    "func_before int, func_after int, func_delta int, "
    "imports_before int, imports_after int, imports_delta int"
)
SNAPSHOTS = (
    "file_path string, repo_name string, commit_hash string, commit_date string, author string, "
    "commit_message string, diff string, current_content string, content_available boolean"
)
SELECTION = "repo_name string, file_path string, score double, score_label string"
CLUSTER_ASSIGNMENTS = "repo_name string, file_path string, cluster_id string, anomaly_score string"
FILE_METADATA = "repo_name string, file_path string, file_type string"
TIME_SERIES = (
    "repo_name string, file_path string, metric string, commit_hash string, "
    "commit_date string, metric_value string"
)
FILE_ANALYSIS = (
    "repo_name string, file_path string, n_commits int, cluster_id int, anomaly_score double, "
    "churn_label string, cc_volatility_label string, imports_volatility_label string, "
    "historical_trends struct<cc:struct<value:double,label:string>,"
    "mi:struct<value:double,label:string>,imports:struct<value:double,label:string>>, "
    "recent_trends struct<cc:struct<value:double,vs_historical:string>,"
    "mi:struct<value:double>,imports:struct<value:double,vs_historical:string>>, "
    "volatility_comparison struct<cc:string>, "
    "raw_features struct<churn_rate:double,mean_abs_loc_delta:double,mean_cc_after:double,"
    "mean_mi_after:double,mean_imports_after:double,mean_func_after:double,"
    "std_cc_after:double,std_imports_after:double>"
)
EXPLANATIONS = (
    "repo string, file string, cluster string, anomaly_score double, "
    "referenced_commits array<string>, explanation string, "
    "validation struct<valid:boolean,violations:array<string>,word_count:int>"
)
CORPUS = (
    "repo string, file string, commit string, type string, document string, "
    "embedding array<float>"
)


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Fail early, naming every column that is absent."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    return df


def require_inputs(inputs: Mapping[str, DataFrame | None]) -> None:
    """Fail early, naming every input table that is absent."""
    absent = [name for name, df in inputs.items() if df is None]
    if absent:
        raise FileNotFoundError("missing required inputs: " + ", ".join(absent))
