"""Prompts, generation with failures and retries, and resuming."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from evolens.functions import fixed_values as fv
from evolens.plans import explain
from evolens.sources import parts
from evolens.plans.analysis import evolution
from evolens.catalog import adapters as a

PROMPTS = "repo string, file string, cluster string, anomaly_score double, provided_commits array<string>, prompt string"


def prompts(spark, *texts):
    rows = [("r", f"f{i}", "0", 0.5, ["abcdef0123456"], t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, PROMPTS)


def by_file(df):
    return {r.file: r for r in df.collect()}


def test_failures_stay_in_their_row(spark):
    def generator(batch):
        if any("bad" in p for p in batch):
            raise RuntimeError("no answer")
        return [f" It appears to be {p} abcdef0 fffffff " for p in batch]

    got = by_file(explain.explain(prompts(spark, "one", "bad", "two"), generator))
    assert got["f0"].explanation == "It shows be one abcdef0 [commit]"
    assert got["f0"].referenced_commits == ["abcdef0123456"]
    assert "References unknown commit: fffffff" in got["f0"].validation.violations
    assert got["f1"].explanation == fv.ERROR_PREFIX + "no answer"
    assert got["f1"].validation is None and got["f1"].referenced_commits == []
    assert "two" in got["f2"].explanation


def test_long_answers_are_asked_for_again(spark):
    def generator(batch):
        return ["short" if p.endswith(explain.SHORTER_RULE) else "w " * int(p) for p in batch]

    got = by_file(explain.explain(prompts(spark, "250", "251"), generator))
    assert got["f0"].validation.word_count == 250
    assert got["f1"].explanation == "short" and got["f1"].validation.word_count == 1


def test_wrong_number_of_answers(spark):
    got = by_file(explain.explain(prompts(spark, "a", "b"), lambda batch: [batch[0]]))
    assert got["f0"].explanation == "a" and got["f1"].explanation == "b"


def test_no_prompts(spark):
    assert explain.explain(prompts(spark, "x").limit(0), lambda batch: batch).count() == 0


def test_resumed_run_explains_only_what_is_left(spark, tmp_path):
    path = str(tmp_path / "results")
    first = prompts(spark, "a", "b")
    assert explain.explain_pending(first.limit(1), lambda b: ["old" for _ in b], path).count() == 1
    both = explain.explain_pending(first, lambda b: ["new" for _ in b], path)
    assert sorted(r.explanation for r in both.collect()) == ["new", "old"]


def test_failing_rows_do_not_send_the_others_again(spark, tmp_path):
    log = str(tmp_path)

    def generator(prompts):
        with open(f"{log}/{uuid.uuid4()}", "w") as f:
            f.write(str(len(prompts)))
        if "bad" in prompts:
            raise ValueError("refused")
        return [p.upper() for p in prompts]

    prompts = [("bad" if i == 5 else f"p{i}",) for i in range(64)]
    rows = explain.generate(spark.createDataFrame(prompts, "prompt string").coalesce(1), generator).collect()
    assert [r.error for r in rows if r.prompt == "bad"] == ["refused"]
    assert all(r.response == r.prompt.upper() for r in rows if r.prompt != "bad")
    assert len(list(tmp_path.iterdir())) == 13  # the whole, two halves of each of six failing lists


def test_evidence(spark):
    schema = "i int, d array<struct<rank:int,commit:string,document:string>>"
    df = spark.createDataFrame(
        [(0, None), (1, []), (2, [(1, "abcdefghij", "x"), (2, "b", "y"), (3, "c", "z")])], schema
    )
    shown = [r.e for r in df.select("i", explain.evidence_text(F.col("d")).alias("e")).orderBy("i").collect()]
    assert shown[0] == shown[1] == fv.NO_DIFFS
    assert shown[2] == "[change 1, made by abcdefgh]\nx\n[end of change 1]\n[change 2, made by b]\ny\n[end of change 2]\n"


def test_synthesis(spark):
    df = spark.createDataFrame(
        [("a/x/1", "0", 0.2, "## Why This File Stands Out\nsmall"), ("b", "1", 0.9, "none"), ("a/x/2", "1", 0.4, "")],
        "file string, cluster string, anomaly_score double, explanation string",
    )
    row = explain.synthesis_prompts(df).first()
    assert row.component_lines.split("\n") == [
        "root/: 1 files, avg anomaly 0.90, clusters ['1']",
        "x/: 2 files, avg anomaly 0.30, clusters ['0', '1']",
    ]
    assert row.signal_lines.split("\n") == [
        f"- **b**: {fv.NO_SIGNAL}", f"- **a/x/2**: {fv.NO_SIGNAL}", "- **a/x/1**: small",
    ]


def test_snapshot_descriptions(spark):
    snapshots = spark.createDataFrame(
        [("f", "r", "c", "2024-01-01", "w", "m", "", "")],
        "file_path string, repo_name string, commit_hash string, commit_date string, author string, "
        "commit_message string, diff string, current_content string",
    )
    row = explain.explain_snapshots(snapshots, lambda batch: [p + " " for p in batch]).first()
    assert fv.NO_DIFF in row.explanation and fv.NO_CONTENT in row.explanation
    assert row.explanation == row.explanation.strip()


def test_evolution_end_to_end(spark, folder):
    history = a.history(spark, folder)
    commits = history.select("repo_name", "commit_hash", "timestamp")
    head = history.filter("repo_name <> 'view'").select("repo_name", "file_path").distinct()
    packed, clusters = evolution(history.drop("timestamp"), commits, head, min_commits=3)
    rows = packed.collect()
    assert rows and all(r.repo_name != "view" for r in rows)
    assert max(r.anomaly_score for r in rows) == 1.0 and min(r.anomaly_score for r in rows) == 0.0
    assert sum(r["size"] for r in clusters.collect()) == len(rows)
    none, summary = evolution(history.drop("timestamp"), commits, head, min_commits=10_000)
    assert none.count() == 0 and summary.count() == 0
    with pytest.raises(ValueError, match="available"):
        evolution(history.drop("timestamp"), commits, head, repo="missing")


def test_evidence_is_searched_in_the_entity_s_scope(spark):
    rows = [
        ("r", "a", "c1", "red fish"),
        ("r", "a", "c2", "Behavior high, File a, Repository r, anomaly score"),
        ("r", "a", "c3", "blue fish"),
        ("r", "a", "c4", "green fish"),
        ("r", "b", "c5", "no entity asks for this"),
        ("q", "a", "c6", "another repository"),
    ]
    documents = spark.createDataFrame(rows, "repo string, file string, commit string, document string")
    corpus = explain.hash_embedding(documents, "document")
    entity = "repo_name string, file_path string, churn_label string, anomaly_score double"
    flat = spark.createDataFrame([("r", "a", "high", 0.5), ("r", "a", "high", 0.5), ("r", "none", None, None)], entity)

    def ranked(inflections=None, k=3):
        found = explain.retrieve_evidence(flat, corpus, inflections=inflections, k=k).collect()
        assert {(r.repo, r.file) for r in found} <= {("r", "a")}
        return [r.commit for r in sorted(found, key=lambda r: r["rank"])]

    assert ranked(k=1) == ["c2"]
    assert sorted(ranked(k=9)) == ["c1", "c2", "c3", "c4"]
    named = spark.createDataFrame([("r", "a", ["c3", "c1", "gone"])], "repo string, file string, inflection_commits array<string>")
    assert ranked(named) == ["c1", "c3"]
    assert len(ranked(named, k=1)) == 1
    assert explain.retrieve_evidence(flat, corpus.limit(0)).count() == 0


def test_run_with_its_own_retrieval(spark, folder):
    from evolens.catalog import text_queries as t

    corpus, _ = t._change_corpus(spark, folder)
    flat = t.flat(spark, folder)
    clusters = t.summary.cluster_summary(t.add_rule_labels(a.analysed(spark, folder)))
    embedded = explain.hash_embedding(corpus.drop("embedding"), "document")
    explanations, report = explain.explain_corpus(flat, embedded, clusters, lambda batch: [p for p in batch], k=4)
    rows = explanations.collect()
    assert len(rows) == 4 and report.count() == 1
    own = embedded.groupBy("repo", "file").agg(F.collect_set(F.substring("commit", 1, 8)).alias("commits"))
    own = {(r.repo, r.file): r.commits for r in own.collect()}
    made_by = {(r.repo, r.file): re.findall(r"\[change \d+, made by (.*?)\]", r.explanation) for r in rows}
    assert any(made_by.values())
    assert all(set(found) <= set(own.get(key, ())) for key, found in made_by.items())


def test_generator_is_given_few_prompts_at_once(spark):
    def counting(prompts):
        if len(prompts) > explain.SENT_ROWS:
            raise SystemExit(f"{len(prompts)} prompts")
        return [f"{p} of {len(prompts)}" for p in prompts]

    rows = spark.range(2 * explain.SENT_ROWS + 3).coalesce(1).selectExpr("CAST(id AS STRING) AS prompt")
    got = [r["response"] for r in explain.generate(rows, counting).collect()]
    sizes = [explain.SENT_ROWS] * 2 * explain.SENT_ROWS + [3] * 3
    assert got == [f"{i} of {n}" for i, n in enumerate(sizes)]


def test_rows_of_a_large_batch_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(explain, "TASK_ROWS", 10)
    prompts = spark.range(120).selectExpr(
        "'r' AS repo", "CAST(id AS STRING) AS file", "'0' AS cluster", "0.0D AS anomaly_score",
        "CAST(array() AS array<string>) AS provided_commits", "'text' AS prompt",
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = explain.explain_pending(prompts, lambda texts: texts, str(tmp_path / "t"), batch_rows=60)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found.count() == 120
    (_, _, attempt), = parts.committed(spark, str(tmp_path / "t"), ["plan"])
    plan = spark.read.parquet(f"{tmp_path}/t/parts/{attempt}")
    assert sorted(r["count"] for r in plan.groupBy("_batch").count().collect()) == [60, 60]
    assert plan.select(F.input_file_name()).distinct().count() > 2
