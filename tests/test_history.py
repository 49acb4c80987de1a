"""Histories: hand-computed features, positions, and hot keys."""

import math

import pytest
from pyspark.sql import functions as F

from evolens.catalog import adapters as a
from evolens.functions import fixed_values as fv
from evolens.operators import history as h

SCHEMA = (
    "repo_name string, file_path string, commit_hash string, timestamp timestamp, "
    "loc_delta int, cc_delta double, imports_delta int, func_delta int, "
    "cc_after double, mi_after double, imports_after int, func_after int"
)


def make(spark, path, cc, mi=None, loc=None):
    import datetime

    rows = []
    for i, value in enumerate(cc):
        rows.append(
            (
                "r",
                path,
                f"c{i:03d}",
                datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i),
                (loc or [1] * len(cc))[i],
                -1.0,
                2,
                0,
                float(value),
                (mi or [None] * len(cc))[i],
                3,
                4,
            )
        )
    return spark.createDataFrame(rows, SCHEMA)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_single_row_history(spark):
    row = one(h.entity_features(make(spark, "a", [5.0]), min_rows=1))
    assert row.std_cc_after == 0 and row.cc_trend == 0 and row.recent_cc_volatility == 0
    assert row.mean_cc_after == 5 and row.mean_mi_after == 0 and row.n_commits == 1


def test_equal_rows_have_no_trend(spark):
    row = one(h.entity_features(make(spark, "a", [5, 5, 5]), min_rows=1))
    assert row.cc_trend == 0 and row.std_cc_after == 0


def test_trend_counts_known_values_only(spark):
    df = make(spark, "a", [1, 1, 1, 1], mi=[1.0, 2.0, None, 3.0])
    row = one(h.entity_features(df, min_rows=1))
    assert row.mi_trend == pytest.approx(1.0)
    assert row.recent_mi_trend == pytest.approx(1.0)
    assert row.mean_mi_after == pytest.approx(2.0)


def test_recent_window(spark):
    values = [0] * 5 + list(range(20))
    row = one(h.entity_features(make(spark, "a", values)))
    assert row.recent_cc_trend == pytest.approx(1.0)
    assert row.cc_trend < 1.0
    mean = sum(range(20)) / 20
    spread = math.sqrt(sum((v - mean) ** 2 for v in range(20)) / 19)
    assert row.recent_cc_volatility == pytest.approx(spread)


def test_change_features(spark):
    df = make(spark, "a", [1, 2, 3, 4], loc=[0, -3, None, 5])
    row = one(h.entity_features(df, min_rows=1))
    assert row.churn_rate == pytest.approx(0.75)  # an unknown change counts as a change
    assert row.mean_abs_loc_delta == pytest.approx(8 / 3)
    assert row.mean_abs_cc_delta == 1 and row.mean_abs_imports_delta == 2


def test_minimum_history(spark):
    df = make(spark, "short", [1] * 4).union(make(spark, "long", [1] * 5))
    assert [r.file_path for r in h.entity_features(df).collect()] == ["long"]
    assert h.with_min_history(df).count() == 5
    row = one(h.history_coverage(df))
    assert (row.entities, row.entities_kept) == (2, 1)


def test_empty_history(spark):
    df = make(spark, "a", [1]).limit(0)
    assert h.entity_features(df).count() == 0
    assert h.sequence(df).count() == 0


def test_hot_keys_give_the_same_positions(spark, folder):
    """Keys above the limit are numbered in slices; nothing else changes."""
    df = a.history(spark, folder)
    counted = ["mi_after", "cc_after"]
    columns = ["repo_name", "file_path", "commit_hash", "position", "history_rows"]
    columns += [f"position_{c}" for c in counted]

    def rows(limit):
        numbered = h.with_positions(df, counted=counted, rows_above=limit)
        return sorted(map(tuple, numbered.select(*columns).collect()))

    plain = rows(h.HOT_ROWS)
    sizes = [r.n for r in df.groupBy(*h.KEYS).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) > 2
    assert rows(sorted(sizes)[len(sizes) // 2]) == plain
    assert rows(0) == plain


def test_one_key_with_most_rows(spark):
    """A key with nearly all rows is split over tasks and keeps its features."""
    n = 4000
    df = spark.range(n).select(
        F.lit("r").alias("repo_name"),
        F.when(F.col("id") % 50 == 0, F.concat(F.lit("f"), F.col("id") % 400)).otherwise("hot").alias("file_path"),
        F.format_string("%08d", F.col("id")).alias("commit_hash"),
        F.timestamp_seconds(F.floor(F.col("id") / 3)).alias("timestamp"),
        *[F.lit(1).alias(f"{m}_delta") for m in ("loc", "imports", "func")],
        F.lit(1.0).alias("cc_delta"),
        F.sin(F.col("id").cast("double")).alias("cc_after"),
        F.when(F.col("id") % 7 > 0, F.cos(F.col("id").cast("double"))).alias("mi_after"),
        (F.col("id") % 11).alias("imports_after"),
        F.lit(2).alias("func_after"),
    )

    def features(limit):
        found = h.entity_features(df, rows_above=limit)
        return {r.file_path: r for r in found.collect()}

    plain, split = features(h.HOT_ROWS), features(500)
    assert plain.keys() == split.keys()
    for key, row in plain.items():
        for name in fv.FEATURE_NAMES:
            assert split[key][name] == pytest.approx(row[name], abs=1e-9), (key, name)


def test_features_do_not_depend_on_partitioning(spark, folder):
    df = a.history(spark, folder)

    def rows(part):
        found = h.entity_features(part).orderBy(*h.KEYS).collect()
        return [[round(v, 9) if isinstance(v, float) else v for v in r] for r in found]

    assert rows(df) == rows(df.repartition(13))


def test_latest_and_earliest(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 3, "c"), ("k", 2, "b")], "k string, i int, v string")
    assert one(h.latest_per_key(df, ["k"], ["i"])).v == "c"
    assert one(h.earliest_per_key(df, ["k"], ["i"])).v == "a"
