"""Retrieval, clustering and anomaly scores against brute force and known shapes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evolens.catalog import adapters as a
from evolens.functions import fixed_values as fv
from evolens.operators import clustering, isolation, retrieval, scaling
from evolens.operators.quantiles import exact_quantiles

DOCS = "repo string, file string, commit long, embedding array<float>"
QUERIES = "repo string, file string, query array<double>"


@pytest.fixture(scope="module")
def two_scopes(spark):
    docs = [
        ("r", "a", 1, [1.0, 0.0]), ("r", "a", 2, [5.0, 0.0]), ("r", "a", 3, [6.0, 0.0]),
        ("r", "b", 4, [0.0, 0.1]), ("r", "b", 5, [0.0, 0.2]), ("r", "b", 6, [0.0, 0.3]),
    ]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame([("r", "a", [0.0, 0.0])], QUERIES)


def found(df):
    return [(r.commit, r["rank"], round(r.similarity, 6)) for r in df.orderBy("rank").collect()]


def test_scope_comes_first(two_scopes):
    docs, queries = two_scopes
    assert found(retrieval.knn_scoped(docs, queries, 2)) == [(1, 1, 0.5), (2, 2, round(1 / 6, 6))]
    assert found(retrieval.knn_scoped(docs, queries, 1, metric="squared")) == [(1, 1, 0.5)]


def test_overfetch_may_return_fewer(two_scopes):
    docs, queries = two_scopes
    assert found(retrieval.knn_overfetch(docs, queries, 2, factor=2)) == [(1, 1, 0.5)]
    wide = retrieval.knn_overfetch(docs, queries, 2, factor=5)
    assert found(wide) == [(1, 1, 0.5), (2, 2, round(1 / 26, 6))]


def test_overfetch_does_not_depend_on_partitioning(spark, folder):
    corpus, queries = a.corpus(spark, folder), a.scope_queries(spark, folder)

    def rows(docs):
        result = retrieval.knn_overfetch(docs, queries, 3)
        return sorted((r.repo, r.file, r.commit, r["rank"]) for r in result.collect())

    assert rows(corpus) == rows(corpus.repartition(7))


def test_overfetch_in_many_blocks(spark, folder, monkeypatch):
    corpus, queries = a.corpus(spark, folder), a.scope_queries(spark, folder)

    def rows():
        result = retrieval.knn_overfetch(corpus, queries, 3)
        return sorted((r.repo, r.file, r.commit, r["rank"]) for r in result.collect())

    plain = rows()
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    monkeypatch.setattr(retrieval, "DOCUMENT_BLOCK", 40)
    assert rows() == plain
    assert retrieval.knn_overfetch(corpus, queries.limit(0), 3).count() == 0


def test_scoped_search_with_many_queries_is_salted(spark, folder, monkeypatch):
    corpus, queries = a.corpus(spark, folder), a.scope_queries(spark, folder)
    columns = ["repo", "file", "commit", "rank"]

    def rows():
        return sorted(map(tuple, retrieval.knn_scoped(corpus, queries, 3).select(*columns).collect()))

    plain = rows()
    real = retrieval.lookup_join
    monkeypatch.setattr(retrieval, "lookup_join", lambda *x, **y: real(*x, **y, max_rows=1))
    assert rows() == plain


@pytest.mark.parametrize(
    "named, expected",
    [
        ([], [(1, 1, 0.5), (2, 2, round(1 / 26, 6)), (3, 3, round(1 / 37, 6))]),
        ([3, 2], [(2, 1, 1.0), (3, 2, 1.0)]),
        ([9], []),
        ([1, 2, 3, 4, 7], [(1, 1, 0.5), (2, 2, round(1 / 6, 6)), (3, 3, round(1 / 7, 6))]),
    ],
)
def test_windowed(spark, two_scopes, named, expected):
    docs, queries = two_scopes
    extra = spark.createDataFrame([("r", "a", 7, [9.0, 0.0])], DOCS)
    asked = queries.withColumn("inflection_commits", F.array(*[F.lit(c) for c in named]).cast("array<long>"))
    assert found(retrieval.knn_windowed(docs.union(extra), asked, 3)) == expected


def test_embedders(spark):
    df = spark.createDataFrame([("a b",), ("",), (None,)], "t string").fillna("")
    rows = retrieval.hash_embedding(df, "t").collect()
    assert [round(float(np.linalg.norm(r.embedding)), 5) for r in rows] == [1.0, 0.0, 0.0]
    encoded = retrieval.model_embedding(df, "t", lambda texts: [[len(t), 1.0] for t in texts])
    assert [list(r.embedding) for r in encoded.collect()] == [[3.0, 1.0], [0.0, 1.0], [0.0, 1.0]]


def blobs(spark, seed=1, each=60, far=None):
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0, 0], [10, 0, 0], [0, 10, 0], [0, 0, 12]])
    x = np.concatenate([c + rng.normal(scale=0.5, size=(each, 3)) for c in centres])
    if far is not None:
        x = np.vstack([x, far])
    rows = [(f"p{i:04d}", v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id string, scaled array<double>"), x


def test_separated_blobs_are_found(spark):
    points, _ = blobs(spark)
    clustered = clustering.cluster_auto_k(points, ["id"])
    labels = {r.id: r.cluster_id for r in clustered.collect()}
    groups = [{labels[f"p{i:04d}"] for i in range(b * 60, b * 60 + 60)} for b in range(4)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 4
    again = clustering.cluster_auto_k(points.repartition(5), ["id"])
    assert {r.id: r.cluster_id for r in again.collect()} == labels
    plain = clustering.cluster_auto_k(points, ["id"], measure="euclidean")
    assert {r.id: r.cluster_id for r in plain.collect()} == labels


@pytest.mark.parametrize("n, clusters", [(0, 0), (1, 1), (2, 1), (3, 2)])
def test_few_points(spark, n, clusters):
    points, _ = blobs(spark)
    few = spark.createDataFrame(points.orderBy("id").limit(n).collect(), points.schema)
    clustered = clustering.cluster_auto_k(few, ["id"])
    assert clustered.select("cluster_id").distinct().count() == clusters


@pytest.mark.parametrize("measure", ["squared", "euclidean"])
def test_silhouette_against_brute_force(spark, measure):
    rng = np.random.default_rng(3)
    x, labels = rng.normal(size=(40, 3)), rng.integers(0, 3, size=40)
    labels[0] = 9  # alone in its cluster: silhouette 0
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    d = d if measure == "squared" else np.sqrt(d)
    scores = []
    for i in range(40):
        own = labels == labels[i]
        if own.sum() == 1:
            scores.append(0.0)
            continue
        within = d[i, own].sum() / (own.sum() - 1)
        nearest = min(d[i, labels == c].mean() for c in set(labels) if c != labels[i])
        scores.append((nearest - within) / max(within, nearest))
    df = spark.createDataFrame([(int(c), v.tolist()) for c, v in zip(labels, x)], "c int, v array<double>")
    got = {r.c: r.silhouette for r in clustering.silhouette(df, "v", "c", measure).collect()}
    for c in set(labels):
        assert got[c] == pytest.approx(np.mean([s for s, k in zip(scores, labels) if k == c]))


@pytest.mark.parametrize("rows, grid", [(9_000, clustering.GRID_ROWS), (600, 100)])
def test_plain_silhouette_in_many_blocks(spark, monkeypatch, rows, grid):
    monkeypatch.setattr(clustering, "GRID_ROWS", grid)
    monkeypatch.setattr(clustering, "CHUNK", 3)
    rng = np.random.default_rng(8)
    x, labels = rng.normal(size=(rows, 2)), rng.integers(0, 7, size=rows)
    x[:, 0] += labels
    d = np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ x.T + (x**2).sum(1)[None], 0))
    np.fill_diagonal(d, 0)
    sums = d @ np.eye(7)[labels]
    n = np.bincount(labels, minlength=7)
    own = sums[np.arange(rows), labels] / (n[labels] - 1)
    means = sums / n
    means[np.arange(rows), labels] = np.inf
    scores = (means.min(1) - own) / np.maximum(means.min(1), own)
    df = spark.createDataFrame([(f"label{c}", v.tolist()) for c, v in zip(labels, x)] + [(None, [0.0, 0.0])], "c string, v array<double>")
    got = {r.c: (r["rows"], r.silhouette) for r in clustering.silhouette(df, "v", "c").collect()}
    assert {c: r[0] for c, r in got.items()} == {f"label{c}": n[c] for c in range(7)}
    for c in range(7):
        assert got[f"label{c}"][1] == pytest.approx(scores[labels == c].mean(), abs=1e-6)
    assert clustering.silhouette(df.limit(0), "v", "c").count() == 0


def test_more_clusters_than_one_row_holds(spark):
    rng = np.random.default_rng(5)
    rows = [(int(c), [float(c), float(rng.normal(scale=0.01))]) for c in range(300) for _ in range(2)]
    df = spark.createDataFrame(rows, "c int, v array<double>")
    for measure in ("euclidean", "squared"):
        got = clustering.silhouette(df, "v", "c", measure).collect()
        assert len(got) == 300 and all(r.silhouette > 0.9 for r in got)


def test_models_that_never_rest_are_reported(spark, monkeypatch):
    points, _ = blobs(spark)
    with pytest.warns(UserWarning, match="still moved after 1 passes"):
        clustering.fit_models(points, ["id"], "scaled", [3], 2, 1, max_iter=1)
    best = clustering.fit_models(points, ["id"], "scaled", [4], 2, 1)[4]
    monkeypatch.setattr(clustering, "PARTS_ADDED_HERE", 0)
    assert np.allclose(clustering.fit_models(points.repartition(3), ["id"], "scaled", [4], 2, 1)[4], best)


def test_outlier_scores_highest(spark):
    points, _ = blobs(spark, far=[40.0, -40.0, 40.0])
    scored = isolation.anomaly_scores(points, ["id"]).collect()
    scores = {r.id: r.anomaly_score for r in scored}
    assert max(scores, key=scores.get) == "p0240"
    assert max(scores.values()) == 1.0 and min(scores.values()) == 0.0


def test_anomaly_scores_do_not_depend_on_partitioning(spark):
    points, _ = blobs(spark, each=200)

    def scores(df):
        return {r.id: r.anomaly_score for r in isolation.anomaly_scores(df, ["id"]).collect()}

    assert scores(points) == scores(points.repartition(6))


def test_flagged_share(spark):
    points, _ = blobs(spark, each=200)
    scored = isolation.anomaly_scores(points, ["id"])
    row = isolation.flagged_summary(scored).first()
    raw = np.array([r.raw_score for r in scored.select("raw_score").collect()])
    assert row.flagged == (raw < np.percentile(raw, 10)).sum()
    assert row.percent == pytest.approx(100 * row.flagged / 800)


def test_tree_samples_are_bounded(spark):
    points = spark.range(5000).select(F.col("id").cast("string").alias("id"), F.array(F.rand(1)).alias("scaled"))
    samples = isolation.tree_samples(points, ["id"], "scaled", 20, 256, 42, 5000)
    sizes = [r["count"] for r in samples.groupBy("tree").count().collect()]
    assert len(sizes) == 20 and max(sizes) == 256 and min(sizes) > 200


def test_scores_of_tiny_tables(spark):
    points, _ = blobs(spark)
    for n in (0, 1, 2):
        few = spark.createDataFrame(points.limit(n).collect(), points.schema)
        scored = isolation.anomaly_scores(few, ["id"]).collect()
        assert [r.anomaly_score for r in scored] == [0.0] * n or n == 2
    same = points.withColumn("scaled", F.array(F.lit(1.0), F.lit(2.0)))
    assert {r.anomaly_score for r in isolation.anomaly_scores(same, ["id"]).collect()} == {0.0}


def test_scaler(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    scaled = scaling.standardise(df, ["a", "b"])
    assert sorted(map(tuple, scaled.collect())) == [(-1.0, 0.0), (1.0, 0.0)]
    check = scaling.standardise_check(scaled, ["a"]).first()
    assert tuple(check) == (0.0, 0.0)


def test_published_search_path_length():
    assert isolation.average_path(1) == 0 and isolation.average_path(2) == 1
    assert isolation.average_path(256) == pytest.approx(10.2448, abs=1e-3)
    assert fv.TREE_SAMPLE == 256


@pytest.mark.parametrize("q", [0.0, 0.01, 0.5, 0.9, 1.0])
def test_quantiles_at_every_size(spark, q):
    sizes = [1, 2, 3, 10, 1_500, 9_999, 10_001, 60_000]
    df = spark.range(max(sizes)).select("id", F.explode(F.array(*map(F.lit, sizes))).alias("size")).where("id < size")
    df = df.select("size", F.when(F.col("size") == 10, F.col("id") % 2).otherwise(F.col("id") * 3).alias("x"))
    found = {r["size"]: r["value"] for r in exact_quantiles(df, ["size"], ["x"], q).collect()}
    for n in sizes:
        values = [i % 2 if n == 10 else i * 3 for i in range(n)]
        assert found[n] == pytest.approx(np.quantile(values, q)), n


def test_quantiles_of_uneven_values(spark, monkeypatch):
    from evolens.operators import quantiles

    values = [0.0, -0.0, 1e-300, 1e-290, -1e308, 1e308, 1.5, 1.5, 1.5, -7.0, 2.0**-1074, 1e9, 1e9 + 1]
    rows = [("few", v) for v in values] + [("one", 3.0)] * 5000 + [("two", float(i % 2)) for i in range(4001)] + [(None, 4.0), ("null", None)]
    rows += [("powers", float(2 ** (i % 1000))) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    monkeypatch.setattr(quantiles, "CUTS", 4)
    monkeypatch.setattr(quantiles, "BRACKET", 0.4)  # wide and few, so that several passes are needed
    for q in (0.3, 1.0):
        found = {r["g"]: r["value"] for r in quantiles.exact_quantiles(df, ["g"], ["x"], q).collect()}
        for g in ("few", "one", "two", "powers"):
            assert found[g] == pytest.approx(np.quantile([v for k, v in rows if k == g], q)), (g, q)


def test_pivots_skip_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "DOCUMENT_BLOCK", 20)
    monkeypatch.setattr(retrieval, "PIVOTS", 8)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 3)) + 50 * rng.integers(0, 6, size=(600, 1))
    docs = spark.createDataFrame([("r", f"f{i % 3}", i, v.tolist()) for i, v in enumerate(x)], DOCS)
    asked = x[:3].copy()
    queries = spark.createDataFrame([("r", f"f{i}", v.tolist()) for i, v in enumerate(asked)], QUERIES)
    got = {(r.file, r["rank"]): r.commit for r in retrieval.knn_overfetch(docs, queries, 2, factor=3).collect()}
    x = x.astype("float32").astype(float)
    for i in range(3):
        near = sorted(range(600), key=lambda j: (((x[j] - asked[i]) ** 2).sum(), j))[:6]
        own = [j for j in near if j % 3 == i][:2]
        assert [got.get((f"f{i}", n + 1)) for n in range(len(own))] == own
    pivots = np.array([r.embedding for r in docs.orderBy("commit").limit(8).collect()], dtype=float)
    placed, blocks = retrieval._shells(docs.withColumn("_vector", F.col("embedding").cast("array<double>")), pivots, ["repo", "file", "commit"])
    visits = retrieval._visits(queries.withColumn("_vector", F.col("query")), pivots, blocks, 6)
    assert placed.count() == 600 and len(blocks) > 20
    assert visits.count() < len(blocks)  # of three queries; visiting all would be three times as many
    same = docs.withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>"))  # one distance, many blocks
    zero = queries.withColumn("query", F.array(F.lit(0.0), F.lit(0.0)).cast("array<double>"))
    found = [(r.file, r.commit) for r in retrieval.knn_overfetch(same, zero, 2, factor=3).collect()]
    assert sorted(found) == [(f"f{c % 3}", c) for c in (0, 3, 1, 4, 2, 5)]
    assert retrieval.knn_overfetch(docs.limit(0), queries).count() == 0


def test_models_far_apart_need_no_pairs_of_rows(spark, monkeypatch):
    spots = [F.when(F.col("id") % 4 == i, 20.0).otherwise(0.0) + F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000 for i in range(4)]
    points = spark.range(600).select("id", F.array(*spots).alias("scaled"))
    want = {r["id"]: r["cluster_id"] for r in clustering.cluster_auto_k(points, ["id"]).collect()}
    models = clustering.fit_models(points, ["id"], "scaled", range(2, 8), 2, 1)
    exact = clustering._model_silhouettes(points, "scaled", models, "euclidean")
    for size in (8, 64):
        cells = np.array([r["scaled"] for r in points.limit(size).collect()])
        rows = points.select(F.col("scaled").alias("_vector"), clustering.nearest_centres(F.col("scaled"), [*models.values(), cells]).alias("_codes"))
        ends = clustering._bounds(rows, 600, models, cells)
        assert all(ends[k][0] - 1e-6 <= exact[k] <= ends[k][1] + 1e-6 for k in models)
    monkeypatch.setattr(clustering, "BOUNDED_ROWS", 10)
    monkeypatch.setattr(clustering, "_plain_sums", None)
    assert {r["id"]: r["cluster_id"] for r in clustering.cluster_auto_k(points, ["id"]).collect()} == want
    assert len(set(want.values())) == 4


def test_memory_of_a_pass_does_not_grow_with_a_task(spark):
    """20,000 rows of one task meet 520 centres; all their distances would be 83 MB."""
    import tracemalloc

    import pyarrow as pa

    class Task:
        def __init__(self, batches):
            self.batches = batches

        def mapInArrow(self, run, schema):
            tracemalloc.start()
            list(run(iter(self.batches)))
            self.peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            raise StopIteration

    rng = np.random.default_rng(4)
    spots = clustering._spots(spark.range(20_000).coalesce(1).select("id", F.array(*[F.rand(i) for i in range(20)]).alias("scaled")), ["id"], "scaled")
    assert spots.count() == 20_000  # no row of many vectors, which a task would have to read whole
    table = spots.toArrow().combine_chunks()
    task = Task(table.to_batches(max_chunksize=10_000))
    with pytest.raises(StopIteration):
        clustering._centre_sums(task, 20, {m: rng.normal(size=(52, 20)) for m in range(10)})
    assert task.peak < 32e6
    assert all((s.stop - s.start) * 520 <= clustering.SLICE_VALUES for s in clustering._slices(20_000, 520))


def test_grid_repeats_rows_by_tiles_not_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(clustering, "GRID_ROWS", 50)
    monkeypatch.setattr(clustering, "CHUNK", 4)
    rng = np.random.default_rng(6)
    x, a, b = rng.normal(size=(1_500, 2)), rng.integers(0, 3, 1_500), rng.integers(3, 9, 1_500)
    rows = spark.createDataFrame([(i, v.tolist(), [int(p), int(q)]) for i, (v, p, q) in enumerate(zip(x, a, b))], "_id long, _vector array<double>, _codes array<int>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = d @ (np.eye(9)[a] + np.eye(9)[b])
    for held in (64 << 20, 8 * 6 * 70):  # the second holds 70 rows of a tile
        monkeypatch.setattr(clustering, "HELD_BYTES", held, raising=False)
        found = clustering._plain_sums(rows, 2, 9).toPandas()
        assert len(found) <= 1_500 * 3 * 8
        got = np.zeros((1_500, 12))
        for r in found.itertuples():
            got[r[1], 4 * r.chunk : 4 * r.chunk + 4] += r.sums
        assert np.allclose(got[:, :9], want, atol=1e-4)


def test_memory_of_nearest_centres_does_not_grow_with_their_number(spark, monkeypatch):
    """A batch of 10,000 rows and 2,048 cells: all their distances would be 164 MB."""
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(5)
    models = [rng.normal(size=(k, 20)) for k in (3, 2_048)]
    monkeypatch.setattr(clustering.F, "pandas_udf", lambda kind: lambda run: lambda column: run)
    nearest = clustering.nearest_centres(None, models)
    vectors = rng.normal(size=(10_000, 20))
    rows = pd.Series(list(vectors))
    tracemalloc.start()
    found = np.stack(nearest(rows).to_numpy())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32e6
    some = vectors[:50]
    for m, c in enumerate(models):
        assert (found[:50, m] == ((some[:, None] - c[None]) ** 2).sum(2).argmin(1) + 3 * m).all()
