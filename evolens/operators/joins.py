"""Joins of a large, possibly skewed table with a table of one row per key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# At most this many rows are ever broadcast.
BROADCAST_ROWS = 100_000
SALTS = 32
# Keys are counted by hash in so many slots; a slot with more than a share of 1 / HOT_SHARE of the rows is spread.
SLOTS = 1 << 16
HOT_SHARE = 1024


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(and_, [left[k].eqNullSafe(right[k]) for k in keys])


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    salt_on: Sequence[str] | None = None,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Equi join that no hot key can slow down.

    A small side of at most ``max_rows`` rows (counted, not guessed) is broadcast,
    so the big side does not move. With a larger one the big side's rows are counted
    by slots of their keys' hash; the rows of crowded slots are spread over salts, and
    the small side's rows of those slots alone are repeated once per salt. All other
    rows of both sides move once.
    """
    keys = list(keys)
    if small.limit(max_rows + 1).count() <= max_rows:
        return big.join(F.broadcast(small), keys, how)
    salt = F.pmod(F.xxhash64(*(salt_on or big.columns)), F.lit(SALTS)).cast("int")
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    if all(big.schema[k].dataType == small.schema[k].dataType for k in keys):
        crowded = _slot(keys).isin(_crowded_slots(big, keys))
        salt = F.when(crowded, salt).otherwise(F.lit(0))
        salts = F.when(crowded, salts).otherwise(F.array(F.lit(0)))
    # Keys of unlike types may be equal and differ in their hash: all of them are spread.
    repeated = small.withColumn("_salt", F.explode(salts))
    return big.withColumn("_salt", salt).join(repeated, [*keys, "_salt"], how).drop("_salt")


def _slot(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(F.lit("slot"), *keys), F.lit(SLOTS)).cast("int")


def _crowded_slots(big: DataFrame, keys: Sequence[str]) -> list[int]:
    """Fewer than HOT_SHARE slots; one row for each slot and task is all that moves."""
    rows = big.groupBy(_slot(keys).alias("_slot")).agg(F.count("*").alias("_rows")).toArrow().to_pydict()
    total = sum(rows["_rows"])
    return sorted(s for s, n in zip(rows["_slot"], rows["_rows"]) if n * HOT_SHARE > total)


def with_commit_time(
    metrics: DataFrame, commits: DataFrame, time: str = "timestamp"
) -> DataFrame:
    """Add the commit time; rows without a commit get the earliest instant.

    ``time_missing`` tells those rows apart. A commit that is listed several times has
    the latest of its times and never repeats a row.
    """
    times = commits.groupBy("repo_name", "commit_hash").agg(F.max(time).alias(time))
    joined = metrics.join(times, ["repo_name", "commit_hash"], "left")
    # One day late, so that every client zone can show it.
    earliest = F.lit("0001-01-02 00:00:00").cast("timestamp")
    return joined.withColumns(
        {
            "time_missing": F.col(time).isNull(),
            time: F.coalesce(F.col(time).cast("timestamp"), earliest),
        }
    )


def inside(df: DataFrame, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is in ``members``."""
    return df.join(members.select(*keys).distinct(), list(keys), "left_semi")


def outside(df: DataFrame, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``members``; empty when nothing leaked."""
    return df.join(members.select(*keys), list(keys), "left_anti")


def assert_inside(df: DataFrame, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    leaked = outside(df, members, keys).select(*keys).first()
    if leaked is not None:
        raise AssertionError(f"row outside the allowed set: {tuple(leaked)}")
    return df


def reconcile(
    reported: DataFrame,
    recomputed: DataFrame,
    keys: Sequence[str],
    value: str,
    tolerance: float = 0.01,
) -> DataFrame:
    """Compare a reported value with the recomputed one, per key."""
    both = reported.select(*keys, F.col(value).alias("reported")).join(
        recomputed.select(*keys, F.col(value).alias("recomputed")), list(keys)
    )
    return both.withColumn(
        "matches", F.abs(F.col("reported") - F.col("recomputed")) < F.lit(tolerance)
    )
