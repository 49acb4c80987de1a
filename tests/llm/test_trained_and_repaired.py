"""Quality embeddings, centroid search and conversation repair against plain versions."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from check import compare, connect
from evolens.llm import centroids, conversations, quality, queries

TEXTS = ["abc", "", "a b", "ünï cödé  x\n yy\tverylongword", None, "  ", "z" * 50, "a a a b b", "a"]


@pytest.mark.parametrize("size", [1 << 20, 16, 1])
def test_quality_features(monkeypatch, size):
    monkeypatch.setattr(quality, "SLICE", size)
    found = [[] for _ in TEXTS]
    for buckets, which in quality.features(TEXTS, 17):
        for x, text in zip(buckets.tolist(), which.tolist()):
            found[text].append(x)
    for text, got in zip(TEXTS, found):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        want = [quality.word_bucket(None, w, 17) for w in words] + [quality.word_bucket(a, b, 17) for a, b in zip(words, words[1:])]
        for w in (f" {w} " for w in words):
            want += [quality.bucket_of(w[i : i + n], 17) for n in quality.NGRAMS for i in range(len(w) - n + 1)]
        assert sorted(got) == sorted(want)
    assert quality.word_bucket("x", "x", 17) == quality.word_bucket("yy", "yy", 17) != quality.word_bucket("x", "y", 17)
    assert list(quality.features([""], 17)) == [] and list(quality.features([], 17)) == []


def test_quality_descent_is_the_softmax_gradient():
    draw = np.random.RandomState(3)
    buckets = [np.unique(draw.randint(0, 64, 9)).astype(np.int32) for _ in range(6)]
    counts = [draw.randint(1, 4, len(b)).astype(np.float32) for b in buckets]
    labels, weights = np.array([0, 1, 0, 1, 1, 0]), np.array([1.0, 0.5], np.float32)
    vectors, output = quality.descend(labels, buckets, counts, weights, bits=6, epochs=2, seed=7)
    draw = np.random.RandomState(7)
    v = draw.uniform(-1 / quality.WIDTH, 1 / quality.WIDTH, (64, quality.WIDTH))
    u, b, done = np.zeros((quality.WIDTH, 2)), np.zeros(2), 0
    for _ in range(2):
        for i in draw.permutation(6):
            share = counts[i] / counts[i].sum()
            mean = sum(s * v[x] for s, x in zip(share, buckets[i]))
            odds = np.exp(mean @ u + b)
            step = quality.STEP * (1 - done / 12) * weights[labels[i]]
            error = odds / odds.sum() - np.eye(2)[labels[i]]
            back = u @ error
            for s, x in zip(share, buckets[i]):
                v[x] -= step * back * s / (share**2).sum()
            u -= step * np.outer(mean, error)
            b -= step * error
            done += 1
    assert np.allclose(vectors, v, atol=1e-5) and np.allclose(output, np.vstack([u, b]), atol=1e-5)
    values = vectors @ (output[:-1, 1] - output[:-1, 0])  # one number per bucket scores as the whole model does
    for x, n in zip(buckets, counts):
        odds = np.exp((n / n.sum()) @ vectors[x] @ output[:-1] + output[-1])
        assert 1 / (1 + np.exp(-(output[-1, 1] - output[-1, 0] + (n / n.sum()) @ values[x]))) == pytest.approx(odds[1] / odds.sum(), abs=1e-5)


def test_quality(spark, odd):
    draw = np.random.RandomState(1)
    words = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join(draw.choice(words, 40)) + (" ### $$$" * 5 if i % 4 == 0 else "")) for i in range(600)]
    docs = spark.createDataFrame([*rows, (2, "another text of a repeated id"), (700, None), (701, " \n")], "doc_id bigint, text string")
    labels = spark.createDataFrame([*((i, int(i % 4 > 0)) for i in range(400)), (5, 0), (6, None), (7, 9), (None, 1)], "doc_id bigint, quality int")
    model = quality.train(docs, labels)
    found = {r["doc_id"]: r["score"] for r in quality.scores(docs, model).collect()}
    assert all((found[i] >= 0.3) == bool(i % 4) for i in range(400, 600))
    assert found[700] == found[701] == model.prior and 0.7 < model.prior < 0.8
    assert np.array_equal(model.values, quality.train(docs.repartition(5), labels.repartition(3)).values)
    scored = quality.scores(odd, model)
    assert scored.columns == ["doc_id", "score"] and scored.count() == odd.count()
    assert all(0 <= r["score"] <= 1 for r in scored.collect())
    one = quality.train(docs, labels.where("quality = 1"))
    assert one.values is None and {r["score"] for r in quality.scores(odd, one).collect()} == {one.prior}
    empty = quality.train(docs.limit(0), labels)
    assert {r["score"] for r in quality.scores(odd, empty).collect()} == {empty.prior}
    assert quality.scores(odd.limit(0), model).count() == 0 and quality.train(docs, labels.limit(0)).prior == 0.5


def test_quality_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = queries.op11_quality_subword_embeddings(spark, folder).collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def plain_clusters(rows, k, rounds, width):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        where = [nearest(v)[1] for _, v in kept]
        for n in set(where):
            mine = [v for (_, v), w in zip(kept, where) if w == n]
            centres[n] = [sum(xs) // len(mine) for xs in zip(*mine)]
    most, found = (1 << 63) - 1, []
    for i, v in kept:
        distance, n = nearest(v)
        found.append((i, n, min(distance, most), ",".join(map(str, centres[n]))))
    return found


@pytest.mark.parametrize("large", [1.0, 1e30])
def test_centroids(spark, large):
    draw = random.Random(4)
    width = 8
    rows = [(i, [draw.choice([-2.0, -0.5, 0.0, 0.25, 3.0]) + (i % 3) for _ in range(width)]) for i in range(150)]
    rows += [rows[3], rows[3], (None, [1.0] * width), (200, None), (201, []), (202, [1.0] * 3), (203, [1.0] * 7 + [None]), (204, [float("nan")] * width), (205, [float("inf")] * width)]
    rows += [(206, [large] * width), (207, [0.0] * width), (208, [0.0] * width)]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<double>, cluster string").repartition(5)
    got = centroids.cluster(table, k=6, rounds=3, dimensions=width).collect()
    want = plain_clusters(rows, 6, 3, width)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"], r["centroid"]) for r in got), key=str) == sorted(want, key=str)
    most = (1 << 63) - 1
    for r in got:
        assert r["cluster_inertia"] == min(most, sum(w[2] for w in want if w[1] == r["cluster"])) and r["inertia"] == min(most, sum(w[2] for w in want))
    assert centroids.cluster(table.limit(0), k=6, dimensions=width).count() == 0
    few = centroids.cluster(table.where("vec_id < 2"), k=6, dimensions=width).collect()
    assert len(few) == 2 and {r["distance"] for r in few} == {0}


def test_centroid_search_equals_measuring_all():
    draw = np.random.RandomState(2)
    for spread in (1, 50, 10_000, 1 << 24):
        values = draw.randint(-spread, spread + 1, (16, 64))
        values[5] = values[9]
        values[6] = spread  # no deviation at all
        x = np.concatenate([draw.randint(-spread, spread + 1, (400, 64)), values, np.full((3, 64), spread)])
        who, distance = centroids.Centroids(values.tolist()).nearest(x)
        every = ((x[:, None, :] - values[None]) ** 2).sum(2)
        assert np.array_equal(who, every.argmin(1)) and np.array_equal(distance, every.min(1))


@pytest.mark.parametrize("name", ["op12_centroids_equal_average", "op13_conversation_repair"])
def test_sql(spark, folder, name):
    ok, note = compare(connect(folder), queries.QUERIES[name](spark, folder), queries.ORACLES[name])
    assert ok, note


def cheapest_repair(rows):
    """Dijkstra's search over (row, state), by (cost, audit); rows: role, text and fault."""
    steps = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, q, out = heapq.heappop(heap)
        if i == len(rows) and q in (0, 3):
            return cost, audit, out
        if (i, q) in done:
            continue
        done.add((i, q))
        for x, name in (("u", "user"), ("a", "assistant")):
            if (q, x) in steps:
                heapq.heappush(heap, (cost + 5, audit + "I", i, steps[q, x], (*out, f"{name}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, q, out))
            if fault in ("okay", "truncated"):
                more = cost + 5 * (fault == "truncated")
                if (q, role[:1]) in steps:
                    heapq.heappush(heap, (more, audit + "K", i + 1, steps[q, role[:1]], (*out, f"{role}:{text}")))
                for x, name in (("u", "user"), ("a", "assistant")):
                    if (q, x) in steps:
                        heapq.heappush(heap, (more + 1, audit + "R", i + 1, steps[q, x], (*out, f"{name}:{text}")))


def test_parse_is_cheapest():
    draw = random.Random(9)
    for n in [*range(9), *[draw.randint(2, 40) for _ in range(150)]]:
        kinds = [(draw.choice("ssuuuaaa-"), draw.choice(["okay"] * 4 + ["blank", "duplicate", "truncated"])) for _ in range(n)]
        text = "".join(chr(65 + 4 * conversations.INITIALS.index(x) + conversations.FAULTS.index(f)) for x, f in kinds)
        assert conversations.parse(text) == cheapest_repair([(x, "", f) for x, f in kinds])[:2]
        left, right = conversations.span_cell(text[: n // 3]) if n > 2 else conversations.INSERTED, conversations.span_cell(text[n // 3 :] if n > 2 else text)
        assert not text or conversations.cheapest(conversations.join_cells(left, right)) == conversations.parse(text)  # any split


def plain_repair(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), []
    for _, _, role, text in rows:
        trimmed = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not trimmed else "duplicate" if (role, text) in seen else "okay" if trimmed[-1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, out = cheapest_repair([(r[2], r[3], f) for r, f in zip(rows, faults)])
    counts = [faults.count(x) for x in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def plain_damage(rows):
    found = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        role = "user" if hit == 4 else role
        found[conv] += [(conv, turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return found


@pytest.mark.parametrize("block, fan", [(conversations.BLOCK, conversations.FAN), (2, 2)])
def test_repair(spark, monkeypatch, block, fan):
    monkeypatch.setattr(conversations, "BLOCK", block)
    monkeypatch.setattr(conversations, "FAN", fan)
    draw = random.Random(block)
    texts = ["Yes.", "No!", "cut off", "", " \n", "So?  ", "x" * 200 + "a.", "x" * 200 + "b.", None]
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "", "u", None]
    rows = [(conv, turn, draw.choice(roles), draw.choice(texts)) for conv in range(30) for turn in range(draw.randint(1, 9))]
    rows += [(50, turn, "user" if turn % 2 else "assistant", f"turn {turn}.") for turn in range(120)]  # one long conversation
    rows += [(51, 3, "user", "Same.")] * 7 + [(None, 2, "user", "Hi."), (None, None, "assistant", "Yes."), (52, None, None, None), (53, -(1 << 63), "user", "A."), (53, (1 << 63) - 1, "user", "B.")]
    dropped = next(n for n in range(1000, 2000) if zlib.crc32(f"{n}:0".encode()) % 20 == 0)
    rows += [(dropped, 0, "user", "gone.")]
    table = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, cost int, audit string").repartition(7)
    got = {r[0]: tuple(r)[1:] for r in conversations.repair(conversations.damage(table)).collect()}
    want = {conv: plain_repair(mine) for conv, mine in plain_damage(rows).items()}
    if 53 in want:
        want[53] = (min(want[53][0], (1 << 63) - 1), *want[53][1:])
    assert got == want
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conversations.repair(conversations.damage(table.limit(0))).count() == 0
