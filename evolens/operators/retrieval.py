"""Text evidence per entity: change documents, vectors and scoped nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evolens.functions import fixed_values as fv
from evolens.functions import text, vectors
from evolens.operators.history import latest_per_key
from evolens.operators.joins import lookup_join
from evolens.session import materialise

SCOPE = ("repo", "file")
DIMENSIONS = 384
# An unscoped search holds blocks of about so many documents, around so many pivots, and measures so many queries at once.
QUERY_BLOCK = 512
DOCUMENT_BLOCK = 8_192
PIVOTS = 64


# --- documents --------------------------------------------------------------


def diff_document(repo: Column, file: Column, commit: Column, message: Column, diff: Column) -> Column:
    return text.strip(
        F.format_string(
            fv.DIFF_DOCUMENT,
            file,
            repo,
            text.short_hash(commit),
            text.cap(message, fv.DOC_MESSAGE_CHARS),
            text.cap(diff, fv.DOC_DIFF_CHARS),
        )
    )


def entity_query(file: Column, repo: Column, churn_label: Column, anomaly: Column) -> Column:
    return F.format_string(
        fv.ENTITY_QUERY,
        file,
        repo,
        F.coalesce(churn_label, F.lit("unknown")),
        F.coalesce(anomaly, F.lit(0.0)),
    )


def diff_documents(diffs: DataFrame, commits: DataFrame) -> DataFrame:
    """One document per change that is long enough to say something.

    Messages are looked up by commit hash alone; a hash in several repositories
    keeps one of its messages, the last by repository name. A change that is listed several
    times gives one document, of its last text in alphabetical order.
    """
    messages = latest_per_key(
        commits.select("commit_hash", "repo_name", "message"), ["commit_hash"], ["repo_name"]
    ).select("commit_hash", "message")
    kept = diffs.filter(F.length("diff_text") >= fv.MIN_DIFF_CHARS)
    kept = kept.groupBy("repo_name", "commit_hash", "file_path").agg(F.max("diff_text").alias("diff_text"))
    joined = kept.join(messages, "commit_hash", "left")
    return joined.select(
        F.col("repo_name").alias("repo"),
        F.col("file_path").alias("file"),
        F.col("commit_hash").alias("commit"),
        F.lit("diff").alias("type"),
        diff_document(
            F.col("repo_name"),
            F.col("file_path"),
            F.col("commit_hash"),
            F.coalesce("message", F.lit(fv.NO_MESSAGE)),
            F.col("diff_text"),
        ).alias("document"),
    )


def trivial_counts(diffs: DataFrame) -> DataFrame:
    trivial = F.length("diff_text") < fv.MIN_DIFF_CHARS
    return diffs.agg(
        F.count_if(~trivial).alias("documents"), F.count_if(trivial).alias("skipped_trivial")
    )


def commits_in_scope(corpus: DataFrame, repo: str | None = None, file: str | None = None) -> DataFrame:
    """The indexed commits of one scope, or of every scope, one row each."""
    rows = corpus.filter(F.col("type") == "diff").select("repo", "file", "commit")
    if repo is not None:
        rows = rows.filter((F.col("repo") == repo) & (F.col("file") == file))
    return rows


# --- vectors ----------------------------------------------------------------


def hash_embedding(
    df: DataFrame, column: str, output: str = "embedding", dimensions: int = DIMENSIONS
) -> DataFrame:
    """Unit vectors of hashed word counts: the default embedder, no model needed."""
    words = RegexTokenizer(inputCol=column, outputCol="_words", pattern=r"[^\p{L}\p{N}_]+")
    counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dimensions)
    unit = Normalizer(inputCol="_counts", outputCol="_unit")
    embedded = unit.transform(counts.transform(words.transform(df)))
    vector = vector_to_array("_unit", "float32")
    return embedded.withColumn(output, vector).drop("_words", "_counts", "_unit")


def model_embedding(
    df: DataFrame,
    column: str,
    encode: Callable[[list[str]], Sequence[Sequence[float]]],
    output: str = "embedding",
) -> DataFrame:
    """Vectors from any batch encoder, called once per Arrow batch."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            encoded = encode(batch.fillna("").tolist()) if len(batch) else []
            yield pd.Series([np.asarray(v, dtype="float32") for v in encoded])

    return df.withColumn(output, embed(F.col(column)))


# --- search -----------------------------------------------------------------

_METRICS = {"l2": vectors.l2, "squared": vectors.squared_l2}


def _ranked(pairs: DataFrame, scope: Sequence[str], k: int) -> DataFrame:
    nearest = Window.partitionBy(*scope).orderBy("distance", "commit")
    return pairs.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)


def knn_scoped(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = fv.TOP_K,
    scope: Sequence[str] = SCOPE,
    metric: str = "l2",
) -> DataFrame:
    """The ``k`` nearest documents of each query among those of its own scope.

    ``queries`` holds one row per scope with ``query`` (a vector), so every
    document is compared once. Documents of a hot scope are spread over tasks and
    each task passes on k of them.
    """
    scope = list(scope)
    asked = queries.select(*scope, "query")
    pairs = lookup_join(corpus, asked, scope, salt_on=[*scope, "commit"])
    pairs = pairs.withColumn("distance", _METRICS[metric](F.col("embedding"), F.col("query")))
    return _ranked(pairs.drop("query"), scope, k).withColumn(
        "similarity", vectors.similarity(F.col("distance"))
    )


def knn_overfetch(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = fv.TOP_K,
    factor: int = 5,
    scope: Sequence[str] = SCOPE,
) -> DataFrame:
    """Search all documents for each query, then keep those of its scope.

    Takes the ``factor * k`` nearest documents over all scopes by squared distance and of these up to ``k`` of the
    query's own scope, so it may return fewer. Documents lie in blocks: shells around the nearest of PIVOTS pivots. By
    the triangle inequality a block's shell bounds its distances to a query from below and above; a query visits only
    blocks that may hold one of its nearest, and documents move once, to their block. Answers are exact.
    """
    scope = list(scope)
    fetch = factor * k
    key_types = {f.name: f.dataType.simpleString() for f in corpus.schema.fields}
    asked = [f"query_{c}" for c in scope]
    found_schema = ", ".join(
        [f"{a} {key_types[c]}" for a, c in zip(asked, scope)] + [f"{c} {key_types[c]}" for c in [*scope, "commit"]] + ["distance double"]
    )
    documents = corpus.select(*scope, "commit", F.col("embedding").cast("array<double>").alias("_vector"))
    draw = F.xxhash64(*scope, "commit")
    pivots = np.array([r["_vector"] for r in documents.orderBy(draw, "commit").limit(PIVOTS).collect()], dtype=float)
    wanted = queries.select(*[F.col(c).alias(a) for a, c in zip(asked, scope)], F.col("query").cast("array<double>").alias("_vector"))
    if not len(pivots):
        return _ranked(documents.sparkSession.createDataFrame([], found_schema), scope, k).drop(*asked).withColumn("similarity", F.lit(0.0))
    placed, blocks = _shells(documents, pivots, [*scope, "commit"])
    visits = _visits(wanted, pivots, blocks, fetch)
    # A block's documents come first and are held; the queries stream past them.
    both = placed.withColumn("_query", F.lit(0)).unionByName(visits.withColumn("_query", F.lit(1)), allowMissingColumns=True)
    keys = [*scope, "commit"]
    ordered = both.select("_block", "_query", *asked, *keys, "_vector").repartition("_block").sortWithinPartitions("_block", "_query")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in batches:
            numbers, kinds = (batch.column(c).to_numpy() for c in ("_block", "_query"))
            edges = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(kinds) != 0)) + 1
            for low, high in zip([0, *edges], [*edges, len(numbers)]):
                part = batch.slice(low, high - low)
                if high > low and numbers[low] != block:
                    block, held = numbers[low], []
                if high > low and not kinds[low]:
                    held.append(part)
                elif high > low and held:
                    if len(held) > 1 or isinstance(held[0], pa.RecordBatch):
                        table = pa.Table.from_batches(held).combine_chunks()
                        x = table["_vector"].combine_chunks().flatten().to_numpy().reshape(len(table), -1)
                        held = [(table.select(keys), x, (x**2).sum(axis=1))]
                    yield from _best_of(*held[0], part, asked, fetch)

    fetched = _ranked(ordered.mapInArrow(nearest, found_schema), asked, fetch).drop("rank")
    for a, c in zip(asked, scope):
        fetched = fetched.filter(F.col(a).eqNullSafe(F.col(c)))
    return _ranked(fetched, scope, k).drop(*asked).withColumn("similarity", vectors.similarity(F.col("distance")))


def _shells(documents: DataFrame, pivots: np.ndarray, keys: Sequence[str]) -> tuple[DataFrame, list]:
    """Documents with their block, and of each block: number, pivot, rows, least and greatest distance to the pivot."""
    squares = (pivots**2).sum(axis=1)

    @F.pandas_udf("pivot int, radius double")
    def nearest_pivot(batch: pd.Series) -> pd.DataFrame:
        if not len(batch):
            return pd.DataFrame({"pivot": pd.Series(dtype="int32"), "radius": pd.Series(dtype=float)})
        x = np.stack(batch.to_numpy()).astype(float)
        pivot = ((x**2).sum(axis=1)[:, None] + squares - 2 * x @ pivots.T).argmin(axis=1)
        return pd.DataFrame({"pivot": pivot.astype("int32"), "radius": np.sqrt(((x - pivots[pivot]) ** 2).sum(axis=1))})

    near = materialise(documents.withColumn("_near", nearest_pivot("_vector")).select("*", "_near.*").drop("_near"))
    most = near.groupBy("pivot").count().agg(F.max("count")).first()[0]
    shells = -(-most // DOCUMENT_BLOCK)
    shares = [i / shells for i in range(1, shells)]
    cuts = near.groupBy("pivot").agg((F.percentile_approx("radius", shares) if shares else F.array().cast("array<double>")).alias("cuts"))
    shelled = near.join(F.broadcast(cuts), "pivot")  # a row for each pivot
    shelled = shelled.withColumn("shell", F.size(F.filter("cuts", lambda c: c < F.col("radius")))).drop("cuts")
    # Documents at one distance share a shell, however many; such a shell is split by hash.
    sizes = shelled.groupBy("pivot", "shell").agg(F.count("*").alias("n"), F.min("radius").alias("least"), F.max("radius").alias("most"))
    blocks, numbers = [], []
    for r in sizes.orderBy("pivot", "shell").collect():  # a row for each DOCUMENT_BLOCK documents
        parts = -(-r["n"] // (2 * DOCUMENT_BLOCK))
        numbers.append((r["pivot"], r["shell"], len(blocks), parts))
        blocks += [(len(blocks) + i, r["pivot"], r["n"] if i == 0 else 0, r["least"], r["most"]) for i in range(parts)]
    numbered = documents.sparkSession.createDataFrame(numbers, "pivot int, shell int, _first int, _parts int")
    placed = lookup_join(shelled, numbered, ["pivot", "shell"], salt_on=keys)
    block = F.col("_first") + F.pmod(F.xxhash64(*keys), F.col("_parts")).cast("int")
    return placed.select(*keys, "_vector", block.alias("_block")), blocks


def _visits(queries: DataFrame, pivots: np.ndarray, blocks: list, fetch: int) -> DataFrame:
    """Queries, repeated for every block that may hold one of their nearest documents."""
    _, pivot, rows, least, most = (np.array(x) for x in zip(*blocks))
    names = [c for c in queries.columns if c != "_vector"]

    @F.pandas_udf("array<int>")
    def visited(batch: pd.Series) -> pd.Series:
        found = []
        for vector in batch:
            d = np.sqrt(((pivots - np.asarray(vector, dtype=float)) ** 2).sum(axis=1))[pivot]
            upper, lower = d + most, np.maximum(d - most, least - d)
            order = np.argsort(upper)
            enough = np.searchsorted(np.cumsum(rows[order]), fetch)
            reach = upper[order[enough]] if enough < len(order) else np.inf
            found.append(np.flatnonzero(lower <= reach * (1 + 1e-9) + 1e-9).astype("int32"))
        return pd.Series(found)

    return queries.select(*names, "_vector", F.explode(visited("_vector")).alias("_block"))


def _best_of(keys: pa.Table, x: np.ndarray, squares: np.ndarray, queries: pa.RecordBatch, asked: Sequence[str], fetch: int) -> Iterator[pa.RecordBatch]:
    """The nearest `fetch` documents of one block for each of the queries."""
    for low in range(0, queries.num_rows, QUERY_BLOCK):
        some = queries.slice(low, QUERY_BLOCK)
        q = some.column("_vector").flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1)
        own = (q**2).sum(axis=1)
        # The product gives all distances but for rounding; whatever that leaves in reach is measured exactly.
        rough = squares[:, None] + own[None, :] - 2 * x @ q.T
        reach = np.partition(rough, fetch - 1, axis=0)[fetch - 1] if len(x) > fetch else np.full(some.num_rows, np.inf)
        of_query, at = np.nonzero((rough <= reach + 1e-9 * (squares.max() + own)).T)
        distances = ((x[at] - q[of_query]) ** 2).sum(axis=1)
        columns = [some.column(a).take(pa.array(of_query)) for a in asked]
        columns += [keys.column(c).combine_chunks().take(pa.array(at)) for c in keys.column_names]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(distances)], [*asked, *keys.column_names, "distance"])


def knn_windowed(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = 3,
    scope: Sequence[str] = SCOPE,
    order: str = "commit",
) -> DataFrame:
    """Documents of the commits a query names, at most ``k`` per scope.

    ``queries`` has ``query`` and ``inflection_commits``. A query that names none
    takes the nearest documents of its scope, measured by squared distance. With at most k named documents all
    are returned with similarity 1, in index order; else the k nearest.
    """
    scope = list(scope)
    asked = queries.select(*scope, "query", "inflection_commits")
    named = F.coalesce(F.size("inflection_commits"), F.lit(0)) > 0
    pairs = lookup_join(corpus, asked, scope, salt_on=[*scope, "commit"]).withColumn("named", named)
    candidates = pairs.filter(~F.col("named") | F.array_contains("inflection_commits", F.col("commit")))
    squared = vectors.squared_l2(F.col("embedding"), F.col("query"))
    distance = F.when(F.col("named"), F.sqrt(squared)).otherwise(squared)
    candidates = candidates.withColumn("distance", distance)
    # k + 1 rows are enough to tell whether a scope has more than k candidates.
    few = _ranked(candidates, scope, k + 1)
    size = F.count("*").over(Window.partitionBy(*scope))
    direct = F.col("named") & (F.col("candidates") <= k)
    few = few.withColumn("candidates", size).withColumn("direct", direct)
    in_order = F.row_number().over(Window.partitionBy(*scope).orderBy(order))
    return (
        few.withColumn("rank", F.when(F.col("direct"), in_order).otherwise(F.col("rank")))
        .filter(F.col("rank") <= k)
        .withColumn(
            "similarity",
            F.when(F.col("direct"), 1.0).otherwise(vectors.similarity(F.col("distance"))),
        )
        .drop("query", "inflection_commits", "named", "candidates", "direct")
    )
