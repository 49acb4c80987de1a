"""Column functions on hand-made values."""

import pytest
from pyspark.sql import functions as F

from evolens.functions import labels, paths, text, times
from evolens.functions import fixed_values as fv
from evolens.operators import context, source_metrics


def values(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r.x for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def test_churn_edges(spark):
    got = values(spark, [(0.3,), (0.7,), (0.70001,)], "v double", labels.churn_label(F.col("v")))
    assert got == ["low", "moderate", "high"]


def test_trend_and_volatility_edges(spark):
    rows = [(0.01,), (-0.01,), (0.0101,), (-0.0101,)]
    got = values(spark, rows, "v double", labels.trend_label(F.col("v"), 0.01))
    assert got == ["stable", "stable", "increasing", "decreasing"]
    got = values(spark, [(1.0,), (1.01,)], "v double", labels.volatility_label(F.col("v")))
    assert got == ["stable", "oscillating"]


def test_recent_versus_history(spark):
    rows = [(0, 0), (1, 0), (-1, 0), (1.2, 1), (1.21, 1), (0.7, 1), (-2, -1)]
    rows = [(float(a), float(b)) for a, b in rows]
    got = values(spark, rows, "r double, h double", labels.recent_versus_history(F.col("r"), F.col("h")))
    assert got == [
        "unchanged", "regressing", "improving", "unchanged", "regressing", "improving", "improving",
    ]


def test_cluster_label(spark):
    rows = [(0.8, 0.02, 1.5), (0.5, -0.02, 1.0), (0.3, 0.0, 0.0)]
    column = labels.cluster_label(F.col("a"), F.col("b"), F.col("c"))
    assert values(spark, rows, "a double, b double, c double", column) == [
        "high churn, growing complexity, high volatility",
        "moderate churn, declining complexity",
        "low churn, stable complexity",
    ]


@pytest.mark.parametrize(
    "path, expected",
    [
        ("src/tests/a.py", "tests"),
        ("TEST\\a.rb", "tests"),
        ("src/test_a.py", "tests"),
        ("src/a_test.py", "tests"),
        ("x.spec.tsx", "tests"),
        ("a/b.test.jsx", "tests"),
        ("docs/conf.py", "docs"),
        ("CHANGES.rst", "docs"),
        ("requirements/dev.txt", "docs"),
        ("requirements.txt", "docs"),
        ("requirements/dev.in", "deps"),
        ("a.lock", "deps"),
        ("PyProject.toml", "deps"),
        ("setup.py", "deps"),
        (".github/workflow.yml", "deps"),
        ("src/core/setup.pyx", "code"),
        ("src/latest/a.ts", "code"),
        ("a.ts", "code"),
    ],
)
def test_file_type(spark, path, expected):
    assert values(spark, [(path,)], "p string", paths.file_type(F.col("p"))) == [expected]


def test_component_and_names(spark):
    rows = [("a/b/c.py",), ("a.py",), ("a/b",)]
    assert values(spark, rows, "p string", paths.component(F.col("p"))) == ["b", "root", "b"]
    rows = [("a\\b/c.py",), ("x",)]
    assert values(spark, rows, "p string", paths.file_name(F.col("p"))) == ["c.py", "x"]
    rows = [("a.py",), ("a.tsx",), ("a.java",)]
    assert values(spark, rows, "p string", paths.language(F.col("p"))) == ["python", "js", None]


def test_cap_marked(spark):
    column = text.cap_marked(F.col("t"), 3, "...", "none")
    assert values(spark, [("abc",), ("abcd",), ("",), (None,)], "t string", column) == [
        "abc", "abc...", "none", "none",
    ]


def test_one_line(spark):
    column = text.one_line(F.col("t"))
    assert values(spark, [(" a\nb\t\n ",), ("\u00a0x\u2003",)], "t string", column) == ["a b", "x"]


def test_hash_tokens(spark):
    rows = [
        ("123456 1234567 12345678",),
        ("a" * 40 + " " + "b" * 41,),
        ("ABCDEF0 abcdef0 xabcdef0 \u00e9abcdef0 abcdef0_ (abcdef0)",),
        ("",),
    ]
    assert values(spark, rows, "t string", text.hash_tokens(F.col("t"))) == [
        ["1234567", "12345678"], ["a" * 40], ["abcdef0", "abcdef0"], [],
    ]


def test_grounding(spark):
    valid = ["abcdef0123456789", "1234567890"]
    rows = [
        ("see abcdef0 and 12345678 and abcdef0ff, not fffffff", valid),
        ("fffffff", []),
        ("abcdef0\nabcdef0123 fffffff.", valid),
        ("none", valid),
    ]
    schema = "t string, v array<string>"
    masked = values(spark, rows, schema, text.mask_ungrounded(F.col("t"), F.col("v")))
    assert masked == [
        "see abcdef0 and 12345678 and abcdef0ff, not [commit]",
        "fffffff",
        "abcdef0\nabcdef0123 [commit].",
        "none",
    ]
    found = values(spark, rows, schema, text.referenced_commits(F.col("t"), F.col("v")))
    assert found == [valid, [], [valid[0]], []]


def test_replace_phrases(spark):
    rows = [("It Suggests That x APPEARS TO be",), ("has undergone, may have",)]
    assert values(spark, rows, "t string", text.replace_phrases(F.col("t"))) == [
        "It reflects x shows be", "experienced, likely",
    ]


def test_validation(spark):
    good = "\n".join(f"### {s}\nwords" for s in fv.REQUIRED_SECTIONS) + " abcdef0"
    long = good + " word" * 250
    bad = "This HAS UNDERGONE change 9999999"
    rows = [(good, ["abcdef0123"]), (long, ["xabcdef0"]), (bad, ["abcdef0"])]
    schema = "t string, v array<string>"
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    checked = text.with_validation(df, F.col("t"), F.col("v")).orderBy("i").collect()
    got = [r.validation for r in checked]
    assert got[0].valid and got[0].violations == []
    assert got[1].violations == [f"Exceeded word limit: {got[1].word_count} words (max 250)"]
    assert got[1].word_count == len(long.split())
    assert got[2].violations == [
        *[f"Missing required section: '{s}'" for s in fv.REQUIRED_SECTIONS],
        "Contains banned pattern: 'has undergone'",
        "References unknown commit: 9999999",
    ]


def test_sections(spark):
    rows = [
        ("### Why This File Stands Out\n a \n\nb\n### Next\nc",),
        ("x\n## Why This File Stands Out",),
        ("## Other\nx\n### Why This File Stands Out\none\n### Why This File Stands Out\ntwo",),
        ("no heading",),
    ]
    assert values(spark, rows, "t string", text.attention_signal(F.col("t"))) == [
        "a b", fv.NO_SIGNAL, "one two", fv.NO_SIGNAL,
    ]
    rows = [("## Change Summary\nx",), ("y" * 300,)]
    assert values(spark, rows, "t string", text.change_summary(F.col("t"))) == ["x", "y" * 200]


def test_instants_not_strings(spark):
    rows = [
        ("2024-01-01T10:00:00-08:00",), ("2024-01-01T12:00:00+01:00",), ("soon",), ("",), (None,),
    ]
    column = times.iso_utc(times.parse_instant(F.col("t")))
    assert values(spark, rows, "t string", column) == [
        "2024-01-01T18:00:00", "2024-01-01T11:00:00", None, None, None,
    ]


def test_instants_without_offset_are_utc(spark):
    rows = [("2024-07-01T12:00:00",), ("2024-07-01 12:00:00.5",), ("2024-07-01",), ("2024-07-01T12:00:00Z",)]
    column = F.unix_millis(times.parse_instant(F.col("t")))
    before = spark.conf.get("spark.sql.session.timeZone")
    noon = 1719835200000
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            found = values(spark, rows, "t string", column)
            assert found == [noon, noon + 500, noon - 12 * 3600 * 1000, noon]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_suffix_before_line_break(spark):
    assert values(spark, [("a.py",), ("a.py\n",), (None,)], "p string", paths.has_suffix(F.col("p"), [".py", ".js"])) == [
        True, False, None,
    ]


def test_numbers(spark):
    assert values(spark, [("1.5",), ("x",), ("",)], "t string", times.parse_number(F.col("t"))) == [
        1.5, None, None,
    ]


def test_code_lines(spark):
    rows = [
        ("/* a */ x\nx /* open\ninside\n*/ y\n// c\n\n/* a */ // b",),
        ("/*\n/* still */ z\ninside\n*/\ncode",),
        ("",),
        ("*/ a */ b\n  x  ",),
    ]
    # In the second text a line with both marks leaves the comment open.
    column = source_metrics.code_line_count(F.col("t"))
    assert values(spark, rows, "t string", column) == [3, 2, 0, 2]


def test_script_metrics(spark):
    source = (
        "import a from 'a'\nconst b = require('b')\n// if (x)\n"
        "function f(x) { if (x && y) { return x ? 1 : 2 } }\nconst g = (x) => x?.y\n"
        "class A {\n  run(x) {\n    for (;;) {}\n  }\n}\n"
    )
    df = source_metrics.with_script_metrics(spark.createDataFrame([(source,)], "s string"), "s")
    row = df.first()
    assert row.function_count == 3 and row.import_count == 2
    # 1 + if, &&, ?:, ?., for = 6 over 3 functions
    assert row.cc == 2.0 and row.mi is None and row.loc == 9


def test_python_metrics(spark):
    source = (
        "import os\nfrom a import b\ndef f(x):\n    if x and y:\n        return [i for i in x if i]\n"
        "class C:\n    def m(self):\n        def inner():\n            while 1: pass\n        return 1\n"
    )
    df = spark.createDataFrame([(1, source), (2, "def ("), (3, ""), (4, None)], "id int, s string")
    rows = {r.id: r for r in source_metrics.with_python_metrics(df, ["id"], "s").collect()}
    assert set(rows) == {1, 3, 4}
    # f: 1 + if + and + comprehension with one condition; m with its inner loop: 2
    assert (rows[1].function_count, rows[1].import_count, rows[1].cc) == (2, 2, 3.5)
    assert rows[3].function_count == 0 and rows[3].cc == 0
    empty = source_metrics.with_python_metrics(df.limit(0), ["id"], "s")
    assert empty.count() == 0


def test_before_after(spark):
    schema = (
        "repo_name string, commit_hash string, file_path string, side string, loc int, cc double, "
        "mi double, function_count int, import_count int"
    )
    rows = [
        ("r", "c", "both", "parent", 10, 2.0, 50.0, 1, 1),
        ("r", "c", "both", "commit", 12, 1.5, None, 3, 0),
        ("r", "c", "added", "commit", 1, 1.0, None, 0, 0),
        ("r", "c", "gone", "parent", 1, 1.0, None, 0, 0),
    ]
    paired = source_metrics.before_after(spark.createDataFrame(rows, schema)).collect()
    assert [r.file_path for r in paired] == ["both"]
    row = paired[0]
    assert (row.loc_delta, row.cc_delta, row.mi_delta) == (2, -0.5, None)
    assert (row.func_delta, row.imports_delta) == (2, -1)


def test_context_texts(spark):
    column = context.anomaly_context(F.col("p"), F.col("t"))
    rows = [(100, 0), (95, 5), (85, 15), (60, 40)]
    assert values(spark, rows, "p int, t int", column) == [
        "Top 0% most atypical (extreme outlier)",
        "Top 5% most atypical (extreme outlier)",
        "Top 15% most atypical",
        "60th percentile",
    ]
    rows = [(0.79,), (0.8,), (1.2,), (2.0,)]
    got = values(spark, rows, "r double", context.churn_comparison(F.col("r")))
    assert [g.split("(")[1] for g in got] == [
        "lower than cluster median (more stable)".split("(")[0],
        "similar to cluster median)",
        "moderately higher than cluster median)",
        "significantly higher than cluster median)",
    ]
    rows = [(0.02, 0.01), (0.01, 0.01), (0.5, 0.001), (-0.03, 0.01)]
    column = context.complexity_comparison(F.col("s"), F.col("m"))
    assert values(spark, rows, "s double, m double", column) == [
        "2.0x faster than cluster median",
        "1.0x slower than cluster median",
        "slope 0.5000",
        "3.0x faster than cluster median",
    ]
