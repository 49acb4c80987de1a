"""Committed parts: keyed merge and explanation batches."""

import pytest
from pyspark.sql import functions as F

from evolens.catalog import adapters as a
from evolens.operators import joins, retrieval
from evolens.plans import explain
from evolens.sources import change_log, parts

PROMPTS = "repo string, file string, cluster string, anomaly_score double, provided_commits array<string>, prompt string"


def test_last_ingested_row_wins(spark, tmp_path):
    folder, schema = str(tmp_path / "t"), "k string, at int, v string"
    with pytest.raises(FileNotFoundError):
        parts.current(spark, folder, ["k"])

    def take(*rows, **options):
        parts.ingest(spark.createDataFrame(list(rows), schema), folder, ["k"], ["at"], **options)
        return {r.k: (r["at"], r.v) for r in parts.current(spark, folder, ["k"]).collect()}

    assert take(("a", 2, "new"), ("a", 1, "old"), ("b", 1, "x"), (None, 1, "n")) == {"a": (2, "new"), "b": (1, "x"), None: (1, "n")}
    assert take(("a", 0, "later ingest"), (None, 5, "m"))["a"] == (0, "later ingest")
    before = take(("c", 1, None), ("c", 1, "tie"), compact_after=3)
    assert before == {"a": (0, "later ingest"), "b": (1, "x"), "c": (1, "tie"), None: (5, "m")}
    assert [p[0] for p in parts._live(spark, folder)] == ["base"]  # compacted, reads begin there
    assert take(("b", 9, "y")) == before | {"b": (9, "y")}
    lost = spark.createDataFrame([("a", 1, "never committed")], schema)
    lost.write.parquet(f"{folder}/parts/of-a-run-that-stopped")
    assert {r.k: r.v for r in parts.current(spark, folder, ["k"]).collect()}["a"] == "later ingest"


def test_the_same_rows_twice_change_nothing(spark, folder, tmp_path):
    changes, commits = a.changes(spark, folder), a.single_parent_commits(spark, folder)
    keys, path = ["repo_name", "commit_hash", "file_path"], str(tmp_path / "changes")
    once = changes.dropDuplicates(keys)
    for _ in range(2):
        parts.ingest(once, path, keys)
    timed = joins.with_commit_time(parts.current(spark, path, keys), commits.unionByName(commits))
    assert sorted(map(str, timed.collect())) == sorted(map(str, joins.with_commit_time(once, commits).select(*timed.columns).collect()))
    diffs = change_log.diffs(a.text_changes(spark, folder))
    commits = commits.withColumn("message", F.lit("m"))
    documents = retrieval.diff_documents(diffs, commits)
    again = retrieval.diff_documents(diffs.unionByName(diffs), commits.unionByName(commits))
    assert documents.count() > 0 and documents.exceptAll(again).count() == again.exceptAll(documents).count() == 0


def test_a_killed_run_repeats_one_batch(spark, tmp_path, monkeypatch):
    folder, calls = str(tmp_path / "run"), tmp_path / "calls"
    calls.mkdir()

    def generator(batch):
        import uuid

        for prompt in batch:
            (calls / f"{prompt}-{uuid.uuid4().hex}").touch()
        return [p.upper() for p in batch]

    prompts = spark.createDataFrame([("r", f"f{i:02d}", "0", 0.5, [], f"p{i:02d}") for i in range(20)], PROMPTS)
    real, written = parts.add, []

    def dying(df, where, kind, version):
        if kind == "result" and version == 3:
            df.write.parquet(f"{where}/parts/half-written")  # all calls were made, nothing is committed
            raise KeyboardInterrupt
        real(df, where, kind, version)
        written.append((kind, version))

    monkeypatch.setattr(parts, "add", dying)
    with pytest.raises(KeyboardInterrupt):
        explain.explain_pending(prompts, generator, folder, batch_rows=6)
    assert written == [("plan", 4), ("result", 1), ("result", 2)]
    monkeypatch.setattr(parts, "add", real)
    more = prompts.unionByName(spark.createDataFrame([("r", "new", "0", 0.5, [], "new")], PROMPTS))
    found = {r.file: r.explanation for r in explain.explain_pending(more, generator, folder, batch_rows=6).collect()}
    assert found == {**{f"f{i:02d}": f"P{i:02d}" for i in range(20)}, "new": "NEW"}
    times = [len(list(calls.glob(f"p{i:02d}-*"))) for i in range(20)]
    assert times == [1] * 12 + [2] * 6 + [1] * 2
    explain.explain_pending(more, generator, folder, batch_rows=6)
    assert len(list(calls.iterdir())) == sum(times) + 1


def test_an_answer_may_be_an_error(spark):
    prompts = spark.createDataFrame([(p,) for p in ("a", "bad", "c")], "prompt string").coalesce(1)
    rows = explain.generate(prompts, lambda batch: [ValueError("no") if p == "bad" else p for p in batch]).collect()
    assert [(r.response, r.error) for r in rows] == [("a", None), (None, "no"), ("c", None)]
