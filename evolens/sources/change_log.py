"""From raw change logs to the commits, file changes, diffs and snapshots tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evolens.functions import fixed_values as fv
from evolens.functions import paths, text
from evolens.operators.history import latest_per_key
from evolens.operators.selection import top_k_per_group
from evolens.sources.readers import with_content


def commits(log: DataFrame, max_commits: int | None = None) -> DataFrame:
    """The commits of each repository that have exactly one parent; if asked, of its newest ``max_commits`` only.

    The cap counts merges and roots too: it is applied first.
    """
    newest = log
    if max_commits is not None:
        newest = top_k_per_group(
            log, ["repo_name"], [F.desc("timestamp"), F.asc("commit_hash")], max_commits
        )
    return newest.filter(F.size("parents") == 1).select(
        "repo_name",
        "commit_hash",
        F.get("parents", F.lit(0)).alias("parent_hash"),
        "author",
        "timestamp",
        text.one_line(F.col("message")).alias("message"),
    )


def file_changes(raw: DataFrame) -> DataFrame:
    """One row per change: the new path, or the old one when there is no new path."""
    path = text.first_non_empty(F.col("b_path"), F.col("a_path"))
    return raw.select(
        "repo_name", "commit_hash", path.alias("file_path"), "change_type"
    ).filter(F.col("file_path").isNotNull())


def explode_changes(log: DataFrame) -> DataFrame:
    """File changes of a log that carries an array of changes per commit."""
    raw = log.select("repo_name", "commit_hash", F.inline("changes"))
    return file_changes(raw)


def diffs(raw: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Diff text of added and modified source files, not blank; if asked, cut to ``max_chars``."""
    kept = raw.filter(
        F.col("change_type").isin("A", "M")
        & paths.has_suffix(F.col("file_path"), fv.SOURCE_SUFFIXES)
    )
    if max_chars is not None:
        kept = kept.withColumn("diff_text", text.cap(F.col("diff_text"), max_chars))
    return kept.filter(text.non_blank(F.col("diff_text"))).select(
        "repo_name", "commit_hash", "file_path", "diff_text"
    )


def snapshots(
    changes: DataFrame,
    commit_table: DataFrame,
    diff_table: DataFrame,
    contents: DataFrame,
    max_chars: int = fv.MAX_SNAPSHOT_CHARS,
) -> DataFrame:
    """The latest change of every file with its commit, diff and content.

    The latest commit per file is an aggregate over narrow rows; the wide diff and
    content columns are joined to one row per file afterwards.
    """
    timed = changes.select("repo_name", "commit_hash", "file_path").join(
        commit_table.select("repo_name", "commit_hash", "timestamp"), ["repo_name", "commit_hash"]
    )
    latest = latest_per_key(timed, ["repo_name", "file_path"], ["timestamp", "commit_hash"])
    keys = ["repo_name", "commit_hash", "file_path"]
    described = latest.join(
        commit_table.select("repo_name", "commit_hash", "author", "message"),
        ["repo_name", "commit_hash"],
        "left",
    ).join(diff_table.select(*keys, "diff_text"), keys, "left")
    joined = with_content(described, contents)
    content: Column = text.cap_marked(F.col("content"), max_chars, fv.CONTENT_MARKER)
    return joined.select(
        "file_path",
        "repo_name",
        "commit_hash",
        F.col("timestamp").alias("commit_date"),
        "author",
        F.col("message").alias("commit_message"),
        F.coalesce("diff_text", F.lit("")).alias("diff"),
        F.coalesce(content, F.lit("")).alias("current_content"),
        F.col("content").isNotNull().alias("content_available"),
    )
