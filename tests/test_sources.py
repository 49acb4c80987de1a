"""Readers, writers, the change log and incremental appends."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from evolens import schemas
from evolens.sources import change_log, readers, split_csv, writers
from evolens.streaming.ingest import append_available, new_files


def test_csv_keeps_everything(spark, tmp_path):
    rows = [(1, 'a "b", c\nd'), (2, ""), (3, None), (4, "  spaces \\ "), (5, "é\t'x'")]
    df = spark.createDataFrame(rows, "id int, t string")
    path = str(tmp_path / "t.csv")
    assert writers.write_csv(df, path)
    back = readers.read_csv(spark, path, "id int, t string")
    assert sorted(map(tuple, back.collect())) == rows
    assert not writers.write_csv(df.limit(0), str(tmp_path / "none.csv"))
    assert not (tmp_path / "none.csv").exists()


def test_csv_written_by_others(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes(b'id,t\r\n1,"say ""hi""\n there"\r\n2,bad \xff byte\r\n')
    got = sorted(map(tuple, readers.read_csv(spark, str(path), "id int, t string").collect()))
    assert got == [(1, 'say "hi"\n there'), (2, "bad � byte")]


@pytest.mark.parametrize("size", [45, 250, 1 << 20])
def test_csv_in_many_tasks(spark, tmp_path, size):
    draw = random.Random(size)
    cells = ["plain", "", None, 'say "hi"', "two\nlines", "a,b", "\n\n", "é\r\nx", '"', "x" * 60 + "\n" + "y" * 60, "  s "]
    rows = [(i, draw.choice(cells), draw.choice(cells)) for i in range(120)]
    (tmp_path / "t").mkdir()
    for name, some in (("a", rows[:90]), ("b", rows[90:])):
        with open(tmp_path / "t" / f"{name}.csv", "w", newline="", encoding="utf-8") as f:
            f.write("\n" if name == "b" else "")
            f.write('id,"t\nt",u\n' if name == "a" else "id,t,u\r\n")
            for i, *texts in some:
                end = draw.choice(["\n", "\r\n", "\n\n"])
                f.write(",".join([str(i), *("" if x is None else '"' + x.replace('"', '""') + '"' for x in texts)]) + end)
    schema = "id int, t string, u string"
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        lines = split_csv._lines(spark, str(tmp_path / "t"))
        assert size > 5_000 or lines.select("_file", "_start").distinct().count() > 10
        got = sorted(map(tuple, readers.read_csv(spark, str(tmp_path / "t"), schema).collect()))
        assert readers.read_csv(spark, str(tmp_path / "t"), schema, ["u"]).columns == ["u"]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == rows


@pytest.mark.parametrize("cell, cuts", [("plain", 1), ("two\nlines", 2)])
def test_csv_without_crossing_records_is_cut_once(spark, tmp_path, cell, cuts):
    path = str(tmp_path / "t")
    writers.append_csv(spark.createDataFrame([(i, cell) for i in range(400)], "id int, t string").coalesce(1), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 1001 if cuts == 2 else before)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        read = readers.read_csv(spark, path, "id int, t string")
        assert read._jdf.queryExecution().logical().toString().count("MapInArrow") == cuts
        assert sorted(map(tuple, read.collect())) == [(i, cell) for i in range(400)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", 4194304)


def test_json_array_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1},\n {"id": 2, "x": 1}]')
    rows = readers.read_json(spark, str(tmp_path / "a.json"), "id int", single_array=True)
    assert sorted(r.id for r in rows.collect()) == [1, 2]
    writers.write_json(rows, str(tmp_path / "lines"))
    assert readers.read_json(spark, str(tmp_path / "lines"), "id int").count() == 2


def test_head_listing(spark, tmp_path):
    for name in ("a.py", "b/c.tsx", "b/d.md", "e.java"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    rows = readers.list_files(spark, str(tmp_path), "r")
    assert sorted(r.file_path for r in rows.collect()) == ["a.py", "b/c.tsx", "e.java"]


def log(spark, rows):
    schema = "repo_name string, commit_hash string, parents array<string>, author string, timestamp timestamp, message string"
    day = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame(
        [("r", h, p, "w", day + datetime.timedelta(days=d), m) for h, p, d, m in rows], schema
    )


def test_cap_counts_merges(spark):
    rows = [
        ("root", [], 0, "m"), ("one", ["root"], 1, " a\nb \n"), ("merge", ["one", "root"], 2, "m"),
        ("two", ["merge"], 3, "m"), ("merge2", ["two", "one"], 4, "m"), ("three", ["merge2"], 5, "m"),
    ]
    kept = change_log.commits(log(spark, rows), max_commits=4)
    assert sorted((r.commit_hash, r.parent_hash) for r in kept.collect()) == [
        ("three", "merge2"), ("two", "merge"),
    ]
    all_of_them = change_log.commits(log(spark, rows))
    assert {r.commit_hash: r.message for r in all_of_them.collect()}["one"] == "a b"


def test_change_paths(spark):
    schema = "repo_name string, commit_hash string, changes array<struct<a_path:string,b_path:string,change_type:string>>"
    df = spark.createDataFrame(
        [("r", "c", [("a", "b", "R"), ("a", "", "D"), (None, None, "M"), ("", "", "M"), (None, "n", "A")])], schema
    )
    got = sorted((r.file_path, r.change_type) for r in change_log.explode_changes(df).collect())
    assert got == [("a", "D"), ("b", "R"), ("n", "A")]


def test_diffs(spark):
    rows = [
        ("r", "c", "a.py", "M", "x" * 9000), ("r", "c", "b.py", "D", "x"), ("r", "c", "c.md", "A", "x"),
        ("r", "c", "d.ts", "A", " \n\t"), ("r", "c", "e.jsx", "A", "y"),
    ]
    df = spark.createDataFrame(rows, "repo_name string, commit_hash string, file_path string, change_type string, diff_text string")
    got = {r.file_path: len(r.diff_text) for r in change_log.diffs(df, max_chars=8000).collect()}
    assert got == {"a.py": 8000, "e.jsx": 1}
    assert {len(r.diff_text) for r in change_log.diffs(df).collect()} == {9000, 1}


def test_latest_snapshot_by_instant(spark):
    changes = spark.createDataFrame(
        [("r", "c1", "f", "M"), ("r", "c2", "f", "M"), ("r", "lost", "f", "M"), ("r", "lost", "g", "M")],
        schemas.FILE_CHANGES,
    )
    commits = spark.createDataFrame(
        [("r", "c1", "w", "2024-01-01T23:00:00-08:00", "m1"), ("r", "c2", "w", "2024-01-02T01:00:00+01:00", "m2")],
        "repo_name string, commit_hash string, author string, timestamp string, message string",
    ).withColumn("timestamp", F.try_to_timestamp("timestamp"))
    diffs = spark.createDataFrame([("r", "c2", "f", "d")], schemas.DIFFS)
    contents = spark.createDataFrame(
        [("r", "c1", "f", "z" * 8001)], "repo_name string, commit_hash string, file_path string, content string"
    )
    row = change_log.snapshots(changes, commits, diffs, contents).collect()
    assert len(row) == 1 and row[0].commit_hash == "c1" and row[0].diff == ""
    assert row[0].content_available and row[0].current_content.endswith("[... content truncated ...]")
    assert [c.name for c in spark.createDataFrame([], schemas.SNAPSHOTS).schema] == list(
        change_log.snapshots(changes, commits, diffs, contents).columns
    )


def test_selection_elements(spark):
    json = '{"r":[{"file_path":"a"},"b",{"file_path":""},{"x":1},""],"s":[]}'
    df = spark.createDataFrame([(json,)], "j string")
    rows = readers.selection_rows(df, F.col("j"), "m").collect()
    assert sorted(map(tuple, rows)) == [("r", "a", "m"), ("r", "b", "m")]


def test_selection_written_both_ways(spark, tmp_path):
    df = spark.createDataFrame([("r", "b", 1.0, "s"), ("r", "a", 2.0, "s")], schemas.SELECTION)
    writers.write_selection(df, str(tmp_path / "sel"))
    stored = spark.read.json(str(tmp_path / "sel.json")).first()
    assert stored.records.index('"a"') < stored.records.index('"b"')
    flat = readers.read_csv(spark, str(tmp_path / "sel.csv"), schemas.SELECTION)
    assert flat.count() == 2


def test_append_takes_each_file_once(spark, tmp_path):
    incoming, table, progress = (str(tmp_path / n) for n in ("in", "table", "progress"))
    schema = "id int, t string"

    def run():
        append_available(new_files(spark, incoming, schema), table, progress).awaitTermination()
        return spark.read.parquet(table).count()

    writers.append_csv(spark.createDataFrame([(1, "a\nb")], schema), incoming)
    assert run() == 1 and run() == 1
    writers.append_csv(spark.createDataFrame([(2, "c")], schema), incoming)
    assert run() == 2


def test_corpus_is_stored_by_repository(spark, tmp_path):
    df = spark.createDataFrame([("r", "f", "c", "diff", "d", [1.0])], schemas.CORPUS)
    writers.save_corpus(df, str(tmp_path / "c"))
    assert (tmp_path / "c" / "repo=r").exists()
    back = writers.load_corpus(spark, str(tmp_path / "c"), schemas.CORPUS)
    assert back.select(*df.columns).collect() == df.collect()
