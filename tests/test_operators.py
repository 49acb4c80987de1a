"""Joins, selections, quantiles and summaries on hand-made rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evolens import schemas
from evolens.functions import fixed_values as fv
from evolens.operators import context, joins, quantiles, selection, summary
from evolens.plans import study
from evolens.plans.analysis import flatten, pack
from evolens.catalog import adapters as a
from evolens.catalog.selection_queries import flat


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_broadcast_join(spark, how):
    big = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 40).alias("k")
    )
    small = spark.range(0, 60, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    broadcast = joins.lookup_join(big, small, ["k"], how)
    salted = joins.lookup_join(big, small, ["k"], how, salt_on=["id"], max_rows=5)
    assert sorted(broadcast.columns) == sorted(salted.columns)
    columns = sorted(broadcast.columns)
    key = lambda r: tuple(str(v) for v in r)
    left, right = broadcast.select(*columns).collect(), salted.select(*columns).collect()
    assert sorted(left, key=key) == sorted(right, key=key)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_large_lookup_repeats_only_crowded_keys(spark, how, monkeypatch):
    big = spark.range(20_000).select("id", F.when(F.col("id") % 4 == 0, 7).when(F.col("id") % 4 == 1, None).otherwise(F.col("id")).alias("k"))
    assert len(joins._crowded_slots(big, ["k"])) == 2  # that of 7 and that of null
    assert joins._crowded_slots(spark.range(20_000), ["id"]) == []
    monkeypatch.setattr(joins, "SALTS", 100_000)  # the whole small side so often would not end here
    small = spark.range(0, 20_000, 3).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    want, got = big.join(small, "k", how), joins.lookup_join(big, small, ["k"], how, salt_on=["id"], max_rows=5)
    assert got.count() == want.count() and got.exceptAll(want.select(got.columns)).isEmpty()
    narrow = small.select(F.col("k").cast("int").alias("k"), "v").limit(20)  # equal keys of unlike types
    monkeypatch.setattr(joins, "SALTS", 4)
    want, got = big.join(narrow, "k", how), joins.lookup_join(big, narrow, ["k"], how, salt_on=["id"], max_rows=5)
    assert got.count() == want.count() and got.exceptAll(want.select(got.columns)).isEmpty()


def test_missing_times_get_the_earliest_instant(spark):
    metrics = spark.createDataFrame([("r", "a", 1), ("r", "b", 2)], "repo_name string, commit_hash string, v int")
    commits = spark.createDataFrame(
        [("r", "a", "x", "w", "2024-01-01 00:00:00", "m")],
        "repo_name string, commit_hash string, parent_hash string, author string, timestamp string, message string",
    ).withColumn("timestamp", F.to_timestamp("timestamp"))
    got = {r.commit_hash: r for r in joins.with_commit_time(metrics, commits).collect()}
    assert got["b"].time_missing and got["b"].timestamp.year == 1
    assert not got["a"].time_missing and got["a"].timestamp.year == 2024


def test_leak_is_found(spark):
    df = spark.createDataFrame([("r", "a"), ("r", "b")], "repo_name string, file_path string")
    keys = ["repo_name", "file_path"]
    joins.assert_inside(df, df, keys)
    with pytest.raises(AssertionError, match="'b'"):
        joins.assert_inside(df, df.filter("file_path = 'a'"), keys)


def test_unknown_repository_lists_the_known(spark):
    df = spark.createDataFrame([("x",), ("y",)], "repo_name string")
    assert selection.filter_repo(df, "x").count() == 1
    with pytest.raises(ValueError, match="x, y"):
        selection.filter_repo(df, "z")


def test_missing_inputs_are_named(spark):
    with pytest.raises(FileNotFoundError, match="commits, diffs"):
        schemas.require_inputs({"metrics": spark.range(1), "commits": None, "diffs": None})
    with pytest.raises(ValueError, match="b"):
        schemas.require_columns(spark.range(1), ["id", "b"])


def test_percentile_ties(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.2,), (0.4,)], "s double")
    got = {r.s: r.percentile for r in quantiles.percentile_ranks(df, "s").collect()}
    assert got == {0.1: 25.0, 0.2: 62.5, 0.4: 100.0}
    ranked = quantiles.with_percentile_rank(df, "s")
    assert rows(ranked, "percentile", "top_percent") == [(25, 75), (62, 38), (62, 38), (100, 0)]


def test_percentiles_of_many_unrounded_scores(spark):
    n = 30_000
    df = spark.range(n, numPartitions=6).select((F.pmod(F.col("id") * 7919, F.lit(n)) / 1e9).alias("s"))
    got = {r.s: r.percentile for r in quantiles.percentile_ranks(df, "s").collect()}
    assert len(got) == n
    assert all(got[i / 1e9] == pytest.approx((2 * i + 2) * 50 / n) for i in range(n))
    assert quantiles.percentile_ranks(df, "s", digits=5).count() == 4


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10, 257, 30_000])
@pytest.mark.parametrize("q", [0.1, 0.5, 0.9])
def test_exact_quantiles(spark, n, q):
    rng = np.random.default_rng(n)
    data = {"a": rng.normal(size=n).round(3), "b": rng.integers(0, 3, size=n).astype(float)}
    df = spark.createDataFrame(
        [(g, float(v)) for g, vs in data.items() for v in vs] + [("a", None)], "g string, v double"
    )
    got = {r.g: r.value for r in quantiles.exact_quantiles(df, ["g"], ["v"], q).collect()}
    for g, vs in data.items():
        assert got[g] == pytest.approx(np.percentile(vs, 100 * q))


def test_inverted_min_max(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (2.0,)], "v double")
    assert rows(quantiles.invert_min_max(df, "v", "s"), "v", "s") == [(1.0, 1.0), (2.0, 0.5), (3.0, 0.0)]
    constant = quantiles.invert_min_max(df.filter("v = 1"), "v", "s")
    assert rows(constant, "s") == [(0.0,)]


def test_top_k_ties_and_missing_scores(spark):
    counts = spark.createDataFrame(
        [("r", "b", 2), ("r", "a", 2), ("r", "c", 1), ("s", "z", 9)],
        "repo_name string, file_path string, n_commits long",
    )
    top = selection.select_by_commit_count(counts, 2)
    assert rows(top, "repo_name", "file_path", "score") == [("r", "a", 2.0), ("r", "b", 2.0), ("s", "z", 9.0)]
    analysis = spark.createDataFrame(
        [("r", "a", None), ("r", "b", 0.5), ("r", "c", 0.1)],
        "repo_name string, file_path string, anomaly_score double",
    )
    assert [r.file_path for r in selection.top_k(analysis, "anomaly_score", 2).collect()] == ["b", "c"]
    assert rows(selection.select_by_anomaly(analysis, 3), "file_path", "score") == [
        ("a", 0.0), ("b", 0.5), ("c", 0.1),
    ]


def test_empty_keys_are_not_counted(spark):
    changes = spark.createDataFrame(
        [("r", "", "c"), ("r", "a", ""), ("r", None, "c"), ("r", "a", "c"), ("r", "a", "c"), ("x", "a", "c")],
        "repo_name string, file_path string, commit_hash string",
    )
    got = selection.commit_counts(changes, ["r"])
    assert rows(got, "repo_name", "file_path", "n_commits") == [("r", "a", 1)]


def test_deduplication(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("k", 3, "c")], "k string, i int, v string")
    assert rows(selection.dedupe_last(df, ["k"], "i"), "v") == [("c",)]
    assert rows(selection.dedupe_first(df, ["k"], "i"), "v") == [("a",)]


def test_selected_files_without_metadata_or_cluster(spark):
    chosen = spark.createDataFrame(
        [("r", "a.py", "m"), ("r", "b.md", "m"), ("s", "x", "m")], "repo string, file_path string, mode string"
    )
    meta = spark.createDataFrame(
        [("r", "a.py", "code"), ("r", "b.md", "docs")], "repo_name string, file_path string, file_type string"
    )
    assert rows(selection.file_type_distribution(chosen, meta), "repo", "file_type", "percent") == [
        ("r", "code", 50.0), ("r", "docs", 50.0),
    ]
    quality = selection.selection_quality(chosen, meta)
    assert rows(quality, "repo", "dominant_file_type", "count") == [("r", "code", 1)]
    clusters = spark.createDataFrame(
        [("r", "a.py", "1")], "repo_name string, file_path string, cluster_id string"
    )
    coverage = selection.cluster_coverage(chosen, clusters)
    assert rows(coverage, "repo", "clusters_covered") == [("r", 1), ("s", 0)]


def test_series(spark):
    metrics = spark.createDataFrame(
        [("r", "a", "3", "1"), ("r", "a", "1", "2"), ("r", "a", "2", "x"), ("r", "b", "1", "9"), ("s", "q", "1", "5")],
        "repo_name string, file_path string, commit_hash string, loc_after string",
    )
    snapshots = spark.createDataFrame(
        [("r", "1", "2024-01-02T00:00:00+02:00", 1), ("r", "1", "2030-01-01T00:00:00Z", 2),
         ("r", "2", "2024-01-01T23:30:00-01:00", 3), ("r", "3", "never", 4), ("s", "", "2024-01-01", 5)],
        "repo_name string, commit_hash string, commit_date string, i int",
    )
    dates = study.commit_dates(snapshots, "i")
    series = study.longest_series(metrics, dates)
    got = [(r.repo_name, r.file_path, r.commit_hash) for r in series.collect()]
    assert got == [("r", "a", "1"), ("r", "a", "2"), ("r", "a", "3"), ("s", "q", "1")]
    clean = study.first_series(series).collect()
    assert [(r.commit_hash, r.metric_value) for r in clean] == [("1", 2.0)]


def test_cluster_lookup(spark):
    df = spark.createDataFrame(
        [(1, 7, None, "a"), (2, None, "z", "b"), (3, None, None, "c"), (4, 7, None, "d")],
        "i int, cluster_id int, id string, v string",
    )
    got = rows(summary.cluster_lookup(df, "i"), "cluster_key", "v")
    assert got == [("7", "d"), ("unknown", "c"), ("z", "b")]
    mapped = spark.sql("select map('1', named_struct('v', 5)) as m")
    assert rows(summary.cluster_lookup_from_map(mapped, "m"), "cluster_key", "v") == [("1", 5)]


def test_grounding_metrics(spark):
    schema = "explanation string, validation struct<valid:boolean,violations:array<string>,word_count:int>"
    df = spark.createDataFrame(
        [("2x", (True, [], 10)), ("many", (False, ["v"], 251)), ("Error", None), (None, (True, [], 250))], schema
    )
    row = summary.grounding_metrics(df).first()
    assert (row.commit_grounding_rate, row.quantified_comparison_rate) == (75.0, 25.0)
    assert (row.word_limit_compliance, row.violation_rate, row.total_files) == (50.0, 25.0, 4)
    empty = summary.grounding_metrics(df.limit(0)).first()
    assert tuple(empty) == (0.0, 0.0, 0.0, 0.0, 0)
    strict = summary.grounding_metrics(df, summary.quantified_strict(F.col("explanation"))).first()
    assert strict.quantified_comparison_rate == 25.0


def test_nested_record_schema(spark, folder):
    from evolens.functions.labels import add_rule_labels

    packed = pack(add_rule_labels(a.analysed(spark, folder)))
    written = spark.createDataFrame([], schemas.FILE_ANALYSIS).schema
    assert packed.schema.simpleString() == written.simpleString()
    assert {"hist_cc_value", "raw_churn_rate", "recent_imports_vs_historical"} <= set(flatten(packed).columns)


def test_context_of_a_few_against_everyone(spark, folder):
    everyone = flat(spark, folder)
    full = context.with_context(everyone).select("repo_name", "file_path", "anomaly_context", "churn_comparison")
    top = selection.top_k(everyone, "anomaly_score", 3)
    few = context.with_context(top, everyone).select(*full.columns)
    assert set(map(tuple, few.collect())) <= set(map(tuple, full.collect()))
    assert few.count() == 3


def test_cluster_summary_counts(spark):
    from evolens.functions.labels import add_rule_labels

    zero = ", ".join(f"0.0D as {n}" for n in fv.FEATURE_NAMES if n != "churn_rate")
    df = spark.sql(f"select 0 as cluster_id, explode(array(0.1D, 0.9D, 0.95D)) as churn_rate, {zero}")
    row = summary.cluster_summary(add_rule_labels(df)).first()
    assert row["size"] == 3 and row.churn_label_distribution == {"low": 1, "high": 2}
    assert row.cc_trend_label_distribution == {"stable": 3}
    assert row.derived_cluster_label == "moderate churn, stable complexity"


def test_empty_overview(spark, folder):
    row = summary.overview(flat(spark, folder).limit(0)).first()
    assert tuple(row) == (0, 0.0, 0)
