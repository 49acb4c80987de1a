"""Centroid clustering of integer vectors by equal-average equal-variance search.

Vectors are turned into integers floor(`scale` * x). Nearest centroids are found without measuring all of them: with
S the sum of a vector's components and V = sqrt(d * sum of squares - S^2) (d times its standard deviation),

    d * |x - c|^2  >=  (S_x - S_c)^2 + (V_x - V_c)^2.

Centroids are sorted by S; every vector scans outward from its own S, takes the closer of the next centroid below and
above, rejects it by the deviations or measures it exactly, and stops when the difference of the sums alone is too
large. Bounds are rounded towards measuring, and what is measured is measured in integers, so that neither the
assignment nor its ties (to the smaller number) depend on rounding. All rows of a batch take their steps together.

A round is one pass over the table: tasks add up their vectors by centroid, Spark adds up the tasks, and `k` rows of
`d` exact sums reach the driver. Nothing else does, whatever the table's size.

Kept are vectors of exactly `dimensions` components without null, NaN or infinity; other rows (null vectors, empty ones,
other lengths) are not in the result. Repeated rows count and are returned each; rows with a null id are clustered as
others are, but start no centroid while there are others. Fewer than `k` kept rows are that many centroids; equal
centroids stay apart, the smaller number takes the vectors. An empty table gives an empty result. Components too large
for 64-bit distances are worked with as unbounded integers (of 64-bit floats beyond the range of 32-bit ones, the end of that
range is taken); a distance or a sum above 2^63 - 1 is returned as that.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evolens.session import materialise

SMALL = 1 << 26  # components up to here: 64 (or some hundred) squared differences fit into 63 bits
LARGEST = 2.0**128  # no 32-bit float is larger
LIMB = 60
MOST = (1 << 63) - 1


def kept_vectors(vectors: DataFrame, vector: str, dimensions: int) -> DataFrame:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vectors.where((F.size(vector) == dimensions) & ~bad)


def _integers(column: pa.Array, dimensions: int, scale: int) -> np.ndarray:
    """floor(scale * x) of every component; Python integers where 64 bits would not do."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
    floored = np.floor(np.clip(flat, -LARGEST, LARGEST) * scale)
    if not len(floored) or np.abs(floored).max() <= SMALL:
        return floored.astype(np.int64)
    exact = np.empty(flat.shape, dtype=object)
    exact[:] = [[int(x) for x in row] for row in floored]
    return exact


class Centroids:
    """Centroids sorted by their sums, with what the bounds need."""

    def __init__(self, values: list[list[int]]):
        small = all(abs(x) <= SMALL for row in values for x in row)
        self.values = np.array(values, dtype=np.int64 if small else object)
        self.dimensions = self.values.shape[1]
        if small:
            self.order = np.lexsort((np.arange(len(values)), self.values.sum(1)))
            self.sorted = self.values[self.order]
            self.sums, self.deviations = self._statistics(self.sorted)

    def _statistics(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """S and V of every row as floats."""
        sums = x.sum(1).astype(np.float64)
        spread = self.dimensions * (x * x).sum(1).astype(np.float64) - sums**2
        return sums, np.sqrt(np.maximum(spread, 0.0))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid of every row."""
        if x.dtype == object or self.values.dtype == object:
            return self._nearest_of_large(x.astype(object))
        n, k = len(x), len(self.order)
        sums, deviations = self._statistics(x)
        # V is the root of a difference of rounded numbers: off by less than this share of the larger S.
        slack = 1e-7 * (np.abs(sums) + deviations + np.abs(self.sums).max() + self.deviations.max())
        above = np.searchsorted(self.sums, sums)
        below = above - 1
        best = np.zeros(n, dtype=np.int64)
        bound = np.full(n, np.inf)
        who = np.full(n, k)
        rows = np.arange(n)
        while len(rows):
            low, high = below[rows], above[rows]
            down = np.where(low >= 0, sums[rows] - self.sums[low], np.inf)
            up = np.where(high < k, self.sums[np.minimum(high, k - 1)] - sums[rows], np.inf)
            apart = np.minimum(down, up)
            least = np.maximum(apart - slack[rows], 0.0) ** 2
            go = np.isfinite(apart) & (least <= bound[rows])
            rows, least, downwards = rows[go], least[go], (down <= up)[go]
            at = np.where(downwards, low[go], high[go])
            below[rows] -= downwards
            above[rows] += ~downwards
            spread = np.maximum(np.abs(deviations[rows] - self.deviations[at]) - slack[rows], 0.0)
            measured = least + spread**2 <= bound[rows]
            r, c = rows[measured], at[measured]
            difference = x[r] - self.sorted[c]
            distance, number = (difference * difference).sum(1), self.order[c]
            better = (who[r] == k) | (distance < best[r]) | ((distance == best[r]) & (number < who[r]))
            r, distance = r[better], distance[better]
            best[r], who[r] = distance, number[better]
            bound[r] = self.dimensions * distance.astype(np.float64) * (1 + 1e-9)
        return who, best

    def _nearest_of_large(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same in unbounded integers, every centroid measured: no float bounds such numbers."""
        all_of = np.array([((x - row) ** 2).sum(1) for row in self.values.astype(object)], dtype=object).T.reshape(len(x), -1)
        who = np.array([min(range(len(row)), key=lambda c: (row[c], c)) for row in all_of], dtype=np.int64)
        return who, np.array([row[c] for row, c in zip(all_of, who)], dtype=object)


def _sums(vectors: DataFrame, vector: str, centroids: Centroids, scale: int) -> dict[int, tuple[int, list[int]]]:
    """Rows and exact component sums of every non-empty centroid's vectors."""
    d = centroids.dimensions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, int] = {}
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            x = _integers(batch.column(0), d, scale)
            who, _ = centroids.nearest(x)
            for c in np.unique(who).tolist():
                mine = x[who == c]
                rows[c] = rows.get(c, 0) + len(mine)
                totals[c] = totals.get(c, np.zeros(d, dtype=object)) + mine.sum(0).astype(object)
        # Sums are unbounded integers; they travel in two parts, each far inside a decimal.
        for c, total in totals.items():
            parts = [pa.array([Decimal(int(v) >> LIMB) for v in total], pa.decimal128(38, 0)), pa.array([Decimal(int(v) & ((1 << LIMB) - 1)) for v in total], pa.decimal128(38, 0))]
            columns = [pa.array([c] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([rows[c]] * d, pa.int64()), *parts]
            yield pa.RecordBatch.from_arrays(columns, ["cluster", "place", "n", "high", "low"])

    partial = vectors.select(vector).mapInArrow(run, "cluster int, place int, n bigint, high decimal(38,0), low decimal(38,0)")
    added = partial.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"))
    found: dict[int, tuple[int, list[int]]] = {}
    for row in sorted(added.collect(), key=lambda r: (r["cluster"], r["place"])):  # k * d rows
        found.setdefault(row["cluster"], (row["n"], []))[1].append((int(row["high"]) << LIMB) + int(row["low"]))
    return found


def starting_centroids(vectors: DataFrame, key: str, vector: str, k: int, dimensions: int, scale: int, salt: str = "1") -> list[list[int]]:
    """The k rows with the smallest sha256 of `salt:id`; equal hashes by their vectors, null ids last."""
    draw = F.sha2(F.concat(F.lit(f"{salt}:"), F.col(key).cast("string")), 256)
    first = vectors.select(draw.alias("_draw"), vector).orderBy(F.asc_nulls_last("_draw"), vector).limit(k)
    column = pa.array([row[vector] for row in first.collect()], pa.list_(pa.float64()))  # k rows
    return [[int(v) for v in row] for row in _integers(column, dimensions, scale)]


def fit(vectors: DataFrame, key: str, vector: str, k: int, rounds: int, dimensions: int, scale: int) -> Centroids | None:
    """Centroids after `rounds` rounds over kept vectors; None for an empty table."""
    values = starting_centroids(vectors, key, vector, k, dimensions, scale)
    if not values:
        return None
    for _ in range(rounds):
        for c, (n, totals) in _sums(vectors, vector, Centroids(values), scale).items():
            values[c] = [total // n for total in totals]
    return Centroids(values)


def assign(vectors: DataFrame, key: str, vector: str, centroids: Centroids, scale: int) -> DataFrame:
    """key, cluster and squared distance (long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, distance = centroids.nearest(_integers(batch.column(1), centroids.dimensions, scale))
            if distance.dtype == object:
                distance = np.array([min(int(x), MOST) for x in distance], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(who.astype(np.int32)), pa.array(distance)], [key, "cluster", "distance"])

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(key, vector).mapInArrow(run, f"`{key}` {kind}, cluster int, distance bigint")


def cluster(
    table: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 16, rounds: int = 3, dimensions: int = 64, scale: int = 64
) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia and the final centroid as text, a row for every kept row."""
    rows = kept_vectors(table.select(key, vector), vector, dimensions)
    centroids = fit(rows, key, vector, k, rounds, dimensions, scale)
    if centroids is None:
        kind = rows.schema[key].dataType.simpleString()
        schema = f"`{key}` {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid string"
        return table.sparkSession.createDataFrame([], schema)
    assigned = materialise(assign(rows, key, vector, centroids, scale))
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"))
    totals = {r["cluster"]: int(r["total"]) for r in sums.collect()}  # k rows
    whole = min(sum(totals.values()), MOST)
    described = [(c, min(t, MOST), whole, ",".join(str(int(v)) for v in centroids.values[c])) for c, t in totals.items()]
    names = table.sparkSession.createDataFrame(described, "cluster int, cluster_inertia bigint, inertia bigint, centroid string")
    joined = assigned.join(F.broadcast(names), "cluster")  # k rows
    return joined.select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid")
