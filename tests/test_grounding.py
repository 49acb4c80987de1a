"""References by join and sketches of counts."""

import random

import pytest
from pyspark.sql import functions as F

from evolens.operators import grounding, selection
from evolens.operators import joins


def test_references_by_join(spark, monkeypatch):
    draw = random.Random(3)
    valid = ["".join(draw.choice("abcdef01") for _ in range(n)) for n in [40] * 60 + [8] * 10 + [7, 5, 3]] + [None]
    tokens = [v[:n] for v in valid[:60] for n in (7, 12, 40)] + ["".join(draw.choice("abcdef01") for _ in range(draw.randint(7, 40))) for _ in range(200)]
    texts = [(i, " and ".join(draw.choices(tokens, k=draw.randint(0, 6)))) for i in range(80)] + [(80, None), (81, ""), (82, tokens[0] + " " + tokens[0])]
    rows = spark.createDataFrame(texts, "id int, t string")
    hashes = spark.createDataFrame([(v,) for v in valid], "commit_hash string")

    def supported(token):
        return [v for v in valid if v and (v.startswith(token) or token.startswith(v[:7]))]

    for most in (joins.BROADCAST_ROWS, 0):
        monkeypatch.setattr(grounding, "lookup_join", lambda *x, **y: joins.lookup_join(*x, **y, max_rows=most))
        got = {r["id"]: (r.tokens, r.grounded, r.hashes) for r in grounding.grounded_references(rows, "id", "t", hashes).collect()}
        for i, text in texts:
            mine = set((text or "").split(" and ")) - {""} if i != 82 else {tokens[0]}
            named = [min(supported(x)) for x in mine if supported(x)]
            assert got[i] == (len(mine), len(named), len(set(named))), text
    none = grounding.grounded_references(rows, "id", "t", hashes.limit(0)).agg(F.sum("grounded")).first()[0]
    assert none == 0


def test_sketches_of_increments(spark):
    changes = spark.range(60_000).select(
        F.lit("r").alias("repo_name"), F.when(F.col("id") < 59_000, "big").otherwise(F.concat(F.lit("f"), F.col("id") % 9)).alias("file_path"), F.md5((F.col("id") % 40_000).cast("string")).alias("commit_hash")
    )
    exact = {r.file_path: r.n_commits for r in selection.commit_counts(changes).collect()}
    parts = [selection.commit_sketches(changes.where(F.xxhash64("commit_hash") % 3 == i)) for i in (-2, -1, 0, 1, 2)]
    parts.append(parts[0])  # an increment that comes twice counts once
    got = {r.file_path: r.n_commits for r in selection.merged_counts(*parts).collect()}
    assert got.keys() == exact.keys()
    for path, n in exact.items():
        assert got[path] == pytest.approx(n, rel=4 * selection.sketch_error())
