"""Random texts: native expressions against the standard library, and round trips."""

import random
import re

import pytest
from pyspark.sql import functions as F

from evolens.functions import text
from evolens.operators import quantiles, source_metrics
from evolens.operators.history import with_positions

PIECES = (
    ["a", "é", "_", "Ω", "7", "٣", "²", "́", " ", "\n", "\t", " ", " ", "\x1f", "\x85", ".", "/", "-"]
    + ["abcdef0", "1234567", "deadbeef" * 5, "deadbeef" * 5 + "1", "ABCDEF0", "# Head", "## Why This File Stands Out"]
)


def random_texts(count, pieces, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(14))) for _ in range(count)]


@pytest.fixture(scope="module")
def texts(spark):
    rows = random_texts(3000, PIECES, 7)
    return rows, spark.createDataFrame(list(enumerate(rows)), "i int, t string")


def column(df, expression):
    return [r.x for r in df.select("i", expression.alias("x")).orderBy("i").collect()]


def test_words_and_strip(texts):
    rows, df = texts
    assert column(df, text.word_count(F.col("t"))) == [len(t.split()) for t in rows]
    assert column(df, text.strip(F.col("t"))) == [t.strip() for t in rows]


def test_hash_tokens(texts):
    rows, df = texts
    # Combining marks are not word characters in either.
    expected = [re.findall(r"\b[a-f0-9]{7,40}\b", t) for t in rows]
    assert column(df, text.hash_tokens(F.col("t"))) == expected
    assert sum(map(len, expected)) > 500


def test_masking_keeps_everything_else(texts):
    rows, df = texts
    valid = F.array(F.lit("abcdef0123"))
    masked = column(df, text.mask_ungrounded(F.col("t"), valid))
    for before, after in zip(rows, masked):
        assert re.sub(r"\b(?!abcdef0)[a-f0-9]{7,40}\b", "[commit]", before) == after


def test_code_lines(spark):
    pieces = ["/*", "*/", "//", "x", " ", "\n", "\n", "\t"]
    rows = random_texts(3000, pieces, 3)
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")

    def expected(source):
        total, hidden = 0, False
        for line in (raw.strip() for raw in source.split("\n")):
            marks = ("/*" in line, "*/" in line)
            code = {
                (True, True): re.sub(r"/\*.*?\*/", "", line).strip(),
                (True, False): line.partition("/*")[0].strip(),
                (False, True): (line.split("*/") + [""])[1].strip(),
                (False, False): "" if hidden else line,
            }[marks]
            comment_counts = marks == (True, False)
            total += bool(code) and (comment_counts or not code.startswith("//"))
            hidden = {(True, False): True, (False, True): False}.get(marks, hidden)
        return total

    assert column(df, source_metrics.code_line_count(F.col("t"))) == [expected(t) for t in rows]


def test_positions_on_random_histories(spark):
    rng = random.Random(11)
    rows = [(rng.choice("aaab"), rng.randrange(50), i, rng.choice([None, 1.0])) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, t int, i int, v double")
    order = sorted(rows, key=lambda r: (r[0], r[1], r[2]))
    expected, seen, known = {}, {}, {}
    for k, t, i, v in order:
        seen[k] = seen.get(k, 0) + 1
        known[k] = known.get(k, 0) + (v is not None)
        expected[i] = (seen[k], known[k])
    for limit in (10**6, 200, 0):
        numbered = with_positions(df, ["k"], ["t", "i"], ["v"], rows_above=limit)
        got = {r.i: (r.position, r.position_v) for r in numbered.collect()}
        assert got == expected


def test_percentile_ranks_on_random_scores(spark):
    rng = random.Random(5)
    scores = [round(rng.random() ** 3, 2) for _ in range(500)]
    df = spark.createDataFrame([(s,) for s in scores], "s double")
    got = {r.s: r.percentile for r in quantiles.percentile_ranks(df, "s").collect()}
    for s in set(scores):
        below, upto = sum(v < s for v in scores), sum(v <= s for v in scores)
        assert got[s] == pytest.approx((below + upto + 1) * 50 / len(scores))
