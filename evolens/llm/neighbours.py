"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample of vectors (about `sample`, by hash of their id); every vector of the table is
then filed under the leaf it reaches. A query walks the tree through a priority queue: the branch whose centre is
nearest comes next, and leaves are opened in that order. How many are opened is calibrated: for a bounded set of
queries the exact neighbours are found by a scan of the whole table, and visits are widened until their recall over
these queries reaches `recall`. A query also goes on until the opened leaves hold more than k vectors, so tables of
fewer than k candidates are returned whole.

Neighbouring leaves share a bin of at most BLOCK vectors, and a query brings to a bin one row with the list of the leaves
it opens there. A larger leaf is a bin of its own, searched in blocks of about BLOCK vectors and BLOCK queries, so a leaf
that holds a third of all rows is many tasks; each block gives its k best. Distances are Euclidean, in double precision, on the stored vectors;
ties go to the smaller id. Vectors that are null, empty, all zero, or hold a null or non-finite component take no part,
nor do rows without an id or whose dimension is not the most common one. Repeated rows with one id are separate
candidates but never neighbours of their own id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evolens.session import materialise

BRANCHES = 8
LEAF_SIZE = 32
BLOCK = 2048


@dataclass
class Tree:
    """Centres of every node's children; children[i] is a node number, or -1 - leaf."""

    centres: list[np.ndarray]
    children: list[np.ndarray]
    leaves: int

    def file(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        leaf = np.zeros(len(vectors), dtype=np.int64)
        waiting = [(0, np.arange(len(vectors)))]
        while waiting:
            node, rows = waiting.pop()
            if not len(rows):
                continue
            nearest = _squares(vectors[rows], self.centres[node]).argmin(1)
            for i, child in enumerate(self.children[node].tolist()):
                mine = rows[nearest == i]
                if child < 0:
                    leaf[mine] = -1 - child
                else:
                    waiting.append((child, mine))
        return leaf

    def best_first(self, query: np.ndarray) -> Iterator[int]:
        """Leaves in the order in which the queue yields them."""
        queue: list[tuple[float, int]] = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if node < 0:
                yield -1 - node
                continue
            for d, child in zip(_squares(query[None], self.centres[node])[0].tolist(), self.children[node].tolist()):
                heapq.heappush(queue, (d, child))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :], 0)


def _split(vectors: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """k-means with BRANCHES centres: centres that kept members, and the centre of each vector."""
    draw = np.random.RandomState(seed)
    chosen = [int(draw.randint(len(vectors)))]
    nearest = _squares(vectors, vectors[chosen])[:, 0]
    while len(chosen) < BRANCHES and nearest.sum() > 0:
        chosen.append(int(draw.choice(len(vectors), p=nearest / nearest.sum())))
        nearest = np.minimum(nearest, _squares(vectors, vectors[chosen[-1:]])[:, 0])
    centres = vectors[chosen]
    for _ in range(8):
        of = _squares(vectors, centres).argmin(1)
        kept = np.unique(of)
        centres = np.stack([vectors[of == i].mean(0) for i in kept])
    return centres, _squares(vectors, centres).argmin(1)


def fit(vectors: np.ndarray) -> Tree:
    tree = Tree([np.empty((0, 0))], [np.empty(0, np.int64)], 0)
    waiting = [(0, np.arange(len(vectors)))]
    while waiting:
        node, rows = waiting.pop()
        centres, of = _split(vectors[rows], node)
        children = []
        for i in range(len(centres)):
            mine = rows[of == i]
            if len(mine) > LEAF_SIZE and len(centres) > 1:
                tree.centres.append(np.empty((0, 0)))
                tree.children.append(np.empty(0, np.int64))
                children.append(len(tree.centres) - 1)
                waiting.append((children[-1], mine))
            else:
                children.append(-1 - tree.leaves)
                tree.leaves += 1
        tree.centres[node], tree.children[node] = centres, np.array(children)
    return tree


def bins(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each leaf, and into how many blocks each bin is cut."""
    of, held = np.zeros(len(sizes), dtype=np.int64), []
    for leaf, n in enumerate(sizes.tolist()):
        if not held or held[-1] + n > BLOCK:
            held.append(0)
        of[leaf] = len(held) - 1
        held[-1] += n
    return of, np.maximum(1, -(-np.array(held, dtype=np.int64) // BLOCK))


def usable(rows: DataFrame) -> DataFrame:
    """id and vector (array of double) of the rows that take part."""
    rows = rows.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & fine)
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    common = sizes.first()
    return rows.where(F.size("vector") == (common["n"] if common else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64) if len(column) else np.empty((0, 0))


def _bounded(rows: DataFrame, n: int, name: str) -> DataFrame:
    """About n rows, by hash of the id."""
    total = rows.count()
    return rows.where(F.pmod(F.xxhash64(F.lit(name), "id"), F.lit(1 << 30)) < (1 << 30) * min(1.0, n / max(1, total)))


def _k_best(ids: np.ndarray, vectors: np.ndarray, query: int, vector: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    d = np.sqrt(((vectors - vector) ** 2).sum(1))
    own = ids == query
    if own.any():
        d = np.where(own, np.inf, d)
    if len(d) > k:
        bound = np.partition(d, k - 1)[k - 1]
        rows = np.flatnonzero(d <= bound)
    else:
        rows = np.arange(len(d))
    rows = rows[np.lexsort((ids[rows], d[rows]))][:k]
    rows = rows[np.isfinite(d[rows])]
    return ids[rows], d[rows]


def exact(rows: DataFrame, queries: list[tuple[int, np.ndarray]], k: int) -> dict[int, list[int]]:
    """The true neighbours of a bounded list of queries, by a scan of all rows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column("id").to_numpy(), _matrix(batch.column("vector"))
            found = [(q, *_k_best(ids, vectors, q, v, k)) for q, v in queries] if len(ids) else []
            yield pa.RecordBatch.from_pydict(
                {
                    "query": pa.array([q for q, i, _ in found for _ in i], pa.int64()),
                    "id": pa.array([int(x) for _, i, _ in found for x in i], pa.int64()),
                    "d": pa.array([float(x) for _, _, d in found for x in d], pa.float64()),
                }
            )

    near = rows.mapInArrow(scan, "query bigint, id bigint, d double")
    best = near.groupBy("query").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "id"))), 1, k).alias("best"))
    return {r["query"]: [x["id"] for x in r["best"]] for r in best.collect()}


def _calibrate(tree: Tree, rows: DataFrame, filed: DataFrame, queries: list[tuple[int, np.ndarray]], k: int, recall: float) -> int:
    """The least number of visited leaves at which the calibration queries' mean recall reaches the aim."""
    truth = exact(rows, queries, k)
    wanted = sorted({i for near in truth.values() for i in near})
    spark = rows.sparkSession
    named = spark.createDataFrame([(i,) for i in wanted], "id bigint") if wanted else None
    leaf_of: dict[int, int] = {}
    if named is not None:
        leaf_of = {r["id"]: r["leaf"] for r in filed.select("id", "leaf").join(F.broadcast(named), "id").collect()}
    hits = np.zeros(tree.leaves)
    total = 0
    for q, vector in queries:
        place = {leaf: n for n, leaf in enumerate(tree.best_first(vector))}
        for i in truth.get(q, []):
            hits[place[leaf_of[i]]] += 1
            total += 1
    reached = np.cumsum(hits) >= recall * total
    return int(reached.argmax()) + 1


def search(
    table: DataFrame, query_divisor: int, k: int = 10, recall: float = 0.97, sample: int = 20_000, calibration: int = 100
) -> DataFrame:
    """The k nearest of every row whose vec_id is divisible by query_divisor, among all other rows.

    table: vec_id, embedding; other columns play no part. Result: query_id, rank, vec_id, score; no rows for an empty
    table. calibration: about how many queries are answered exactly, by a scan.
    """
    spark = table.sparkSession
    result = "query_id bigint, rank int, vec_id bigint, score double"
    rows = usable(table)
    drawn = _bounded(rows, sample, "tree").select("vector").toArrow()
    if not drawn.num_rows:
        drawn = rows.limit(sample).select("vector").toArrow()
    if not drawn.num_rows:
        return spark.createDataFrame([], result)
    tree = fit(_matrix(drawn.column("vector").combine_chunks()))
    shared = spark.sparkContext.broadcast(tree)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = shared.value.file(_matrix(batch.column("vector")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], ["id", "vector", "leaf"])

    filed = materialise(rows.mapInArrow(file, "id bigint, vector array<double>, leaf bigint"))
    asked = rows.where(F.col("id") % query_divisor == 0)
    tried = [(r["id"], np.array(r["vector"])) for r in _bounded(asked, calibration, "calibration").collect()]
    visits = _calibrate(tree, rows, filed, tried, k, recall) if tried else tree.leaves
    sizes = np.zeros(tree.leaves, dtype=np.int64)
    for r in filed.groupBy("leaf").count().collect():
        sizes[r["leaf"]] = r["count"]
    bin_of, blocks = bins(sizes)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                some = batch.slice(low, 64)
                out: list[tuple[int, int, int, list[int]]] = []
                for row, vector in enumerate(_matrix(some.column("vector"))):
                    opened: dict[int, list[int]] = {}
                    held = seen = 0
                    for leaf in tree.best_first(vector):
                        opened.setdefault(int(bin_of[leaf]), []).append(leaf)
                        held += sizes[leaf]
                        seen += 1
                        if seen >= visits and held > k:
                            break
                    out += [(row, name, b, leaves) for name, leaves in opened.items() for b in range(blocks[name])]
                at, name, block, leaves = zip(*out) if out else ((), (), (), ())
                arrays = [some.column(c).take(pa.array(at, pa.int64())) for c in ("id", "vector")]
                arrays += [pa.array(name, pa.int64()), pa.array(block, pa.int64()), pa.array(leaves, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["query", "target", "bin", "block", "leaves"])

    asked_blocks = materialise(asked.mapInArrow(walk, "query bigint, target array<double>, bin bigint, block bigint, leaves array<bigint>"))
    # both sides are cut: a popular bin's queries by hash, its vectors by hash
    busy = {r["bin"]: -(-r["n"] // BLOCK) for r in asked_blocks.where("block = 0").groupBy("bin").agg(F.count("*").alias("n")).collect()}
    known = spark.createDataFrame(
        [(leaf, name, int(blocks[name]), int(busy.get(name, 0))) for leaf, name in enumerate(bin_of.tolist())],
        "leaf bigint, bin bigint, blocks bigint, parts bigint",
    )
    vectors = filed.join(F.broadcast(known), "leaf").where("parts > 0").withColumn("block", F.pmod(F.xxhash64("id", "vector"), "blocks"))
    vectors = vectors.select("bin", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "leaf", "id", "vector")
    part = F.pmod(F.xxhash64("query"), F.col("parts"))
    wanted = asked_blocks.join(F.broadcast(known.select("bin", "parts").distinct()), "bin")
    wanted = wanted.select("bin", "block", part.alias("part"), "query", "target", "leaves")

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query": [], "id": [], "d": []}).astype({"query": "int64", "id": "int64", "d": "float64"})
        ids, leaf, held = left["id"].to_numpy(), left["leaf"].to_numpy(), np.stack(left["vector"].to_numpy())
        found = []
        for q, v, leaves in zip(*(right[c].to_numpy() for c in ("query", "target", "leaves"))):
            opened = np.flatnonzero(np.isin(leaf, leaves))
            found.append((q, *_k_best(ids[opened], held[opened], q, v, k)))
        return pd.DataFrame(
            {
                "query": np.concatenate([np.full(len(i), q) for q, i, _ in found]),
                "id": np.concatenate([i for _, i, _ in found]),
                "d": np.concatenate([d for _, _, d in found]),
            }
        )

    near = vectors.groupBy("bin", "block", "part").cogroup(wanted.groupBy("bin", "block", "part")).applyInPandas(nearest, "query bigint, id bigint, d double")
    best = near.groupBy("query").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "id"))), 1, k).alias("best"))
    ranked = best.select("query", F.posexplode("best").alias("pos", "hit"))
    return ranked.select(
        F.col("query").alias("query_id"), (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.d").alias("score")
    )
