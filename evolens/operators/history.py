"""Entity histories: positions in time order, recent rows and feature vectors."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evolens.functions import fixed_values as fv
from evolens.operators.joins import null_safe
from evolens.session import materialise

KEYS = ("repo_name", "file_path")
ORDER = ("timestamp", "commit_hash")

# A key with more rows than this is sorted by several tasks, not by one.
HOT_ROWS = 5_000_000
# The list of hot keys never grows beyond this; a key that is not on it holds
# less than one part in so many of all rows.
MAX_HOT_KEYS = 100_000


def hot_keys(df: DataFrame, keys: Sequence[str], rows_above: int) -> DataFrame | None:
    """The keys one task should not sort alone, at most ``MAX_HOT_KEYS``; None if there are none."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    largest = sizes.filter(F.col("_rows") > rows_above).orderBy(F.desc("_rows"), *keys)
    found = largest.limit(MAX_HOT_KEYS).collect()
    if not found:
        return None
    return df.sparkSession.createDataFrame(found, sizes.schema).select(*keys)


def _number(df: DataFrame, parts: Sequence[str], order: Sequence[str], counted: Sequence[str]):
    ordered = Window.partitionBy(*parts).orderBy(*order)
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns(
        {
            "position": F.row_number().over(ordered).cast("bigint"),
            **{f"position_{c}": F.count(c).over(running) for c in counted},
        }
    )


def with_positions(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER,
    counted: Sequence[str] = (),
    rows_above: int = HOT_ROWS,
) -> DataFrame:
    """Number the rows of every key in time order, from 1.

    Adds ``position``, ``history_rows`` (rows of the key) and, for each column in
    ``counted``, ``position_<column>``: the number of its values so far.

    Ordinary keys take one window. The rows of hot keys are range partitioned on
    key and order, so that each task numbers a slice of a key; adding up the
    slices before it turns that into the position in the whole history.
    """
    keys, order, counted = list(keys), list(order), list(counted)
    rows = F.count("*")
    hot = hot_keys(df, keys, rows_above)

    def ordinary(part: DataFrame) -> DataFrame:
        numbered = _number(part, keys, order, counted)
        return numbered.withColumn("history_rows", rows.over(Window.partitionBy(*keys)))

    if hot is None:
        return ordinary(df)

    heavy = df.join(F.broadcast(hot), null_safe(df, hot, keys), "left_semi")
    heavy = materialise(
        heavy.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id())
    )
    slice_key = [*keys, "_slice"]
    sizes = heavy.groupBy(*slice_key).agg(
        rows.alias("_n"), *[F.count(c).alias(f"_n_{c}") for c in counted]
    )
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(slice_key)],
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        *[
            F.coalesce(F.sum(f"_n_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}")
            for c in counted
        ],
        F.sum("_n").over(Window.partitionBy(*keys)).alias("history_rows"),
    )
    numbered = _number(heavy, slice_key, order, counted)
    same_slice = F.lit(True)
    for i, k in enumerate(slice_key):
        same_slice = same_slice & numbered[k].eqNullSafe(offsets[f"_key_{i}"])
    # One row per hot key and slice: bounded by MAX_HOT_KEYS and the partition count.
    numbered = numbered.join(F.broadcast(offsets), same_slice)
    numbered = numbered.withColumns(
        {
            "position": F.col("position") + F.col("_before"),
            **{f"position_{c}": F.col(f"position_{c}") + F.col(f"_before_{c}") for c in counted},
        }
    )
    rest = df.join(F.broadcast(hot), null_safe(df, hot, keys), "left_anti")
    rest = ordinary(rest)
    return rest.unionByName(numbered.select(*rest.columns))


def sequence(df: DataFrame, keys=KEYS, order=ORDER, rows_above: int = HOT_ROWS) -> DataFrame:
    """The history in time order: every row with its position."""
    return with_positions(df, keys, order, rows_above=rows_above).drop("history_rows")


def with_min_history(df: DataFrame, keys=KEYS, min_rows: int = fv.MIN_COMMITS) -> DataFrame:
    """Keep the rows of keys with at least ``min_rows`` rows.

    Counts first and joins the counts of short keys back, which are few rows each,
    so that long histories are not moved.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    short = sizes.filter(F.col("_rows") < min_rows).select(*keys)
    return df.join(short, null_safe(df, short, keys), "left_anti")


def history_coverage(df: DataFrame, keys=KEYS, min_rows: int = fv.MIN_COMMITS) -> DataFrame:
    """How many entities there are and how many have enough history: one row."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    return sizes.agg(
        F.count("*").alias("entities"),
        F.count_if(F.col("_rows") >= min_rows).alias("entities_kept"),
    )


def latest_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """The last row of every key; an aggregate, so a hot key is combined map-side."""
    return _one_per_key(df, keys, order, columns, F.max_by)


def earliest_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """The first row of every key."""
    return _one_per_key(df, keys, order, columns, F.min_by)


def _one_per_key(df, keys, order, columns, pick) -> DataFrame:
    rest = [c for c in (columns or df.columns) if c not in keys]
    chosen = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return chosen.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


# --- features ---------------------------------------------------------------

TREND_METRICS = ("cc", "mi", "imports")


def _slope(value: Column, position: Column, where: Column | None = None) -> Column:
    """Least squares slope over the position among known values; 0 where it is not defined."""
    y = value.cast("double")
    if where is not None:
        y = F.when(where, y)
    return F.coalesce(F.regr_slope(y, position.cast("double")), F.lit(0.0))


def _known(column: Column) -> Column:
    return F.coalesce(column, F.lit(0.0))


def _feature_expressions(recent: int) -> dict[str, Column]:
    c = F.col
    lately = c("position") > c("history_rows") - recent

    def spread(name: str) -> Column:
        return _known(F.stddev_samp(name))

    return {
        "churn_rate": F.avg(F.when(c("loc_delta").eqNullSafe(F.lit(0)), 0.0).otherwise(1.0)),
        **{
            f"mean_abs_{m}_delta": _known(F.avg(F.abs(f"{m}_delta")))
            for m in ("loc", "cc", "imports", "func")
        },
        **{f"std_{m}_after": spread(f"{m}_after") for m in ("cc", "imports", "mi")},
        **{
            f"{m}_trend": _slope(c(f"{m}_after"), c(f"position_{m}_after")) for m in TREND_METRICS
        },
        **{
            f"mean_{m}_after": _known(F.avg(f"{m}_after")) for m in ("cc", "mi", "imports", "func")
        },
        **{
            f"recent_{m}_trend": _slope(c(f"{m}_after"), c(f"position_{m}_after"), lately)
            for m in TREND_METRICS
        },
        **{
            f"recent_{m}_volatility": _known(F.stddev_samp(F.when(lately, c(f"{m}_after"))))
            for m in ("cc", "imports")
        },
    }


CHANGE_FEATURES = fv.FEATURE_NAMES[0:5]
STABILITY_FEATURES = fv.FEATURE_NAMES[5:8]
TREND_FEATURES = fv.FEATURE_NAMES[8:11]
LEVEL_FEATURES = fv.FEATURE_NAMES[11:15]
RECENT_FEATURES = fv.FEATURE_NAMES[15:20]
ORDERED_FEATURES = frozenset(TREND_FEATURES + RECENT_FEATURES)


def entity_features(
    history: DataFrame,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER,
    names: Iterable[str] = fv.FEATURE_NAMES,
    recent: int = fv.RECENT_WINDOW,
    min_rows: int = fv.MIN_COMMITS,
    rows_above: int = HOT_ROWS,
) -> DataFrame:
    """One row per entity with ``n_commits`` and the named features.

    One window pass numbers the rows and one conditional aggregate on the same
    partitioning computes every feature. Features that do not depend on order
    take the aggregate alone.
    """
    names = list(names)
    if ORDERED_FEATURES.intersection(names):
        counted = [f"{m}_after" for m in TREND_METRICS]
        history = with_positions(history, keys, order, counted, rows_above)
    expressions = _feature_expressions(recent)
    features = history.groupBy(*keys).agg(
        F.count("*").alias("n_commits"), *[expressions[n].alias(n) for n in names]
    )
    return features.filter(F.col("n_commits") >= min_rows)
