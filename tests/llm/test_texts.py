"""Word hashes, language, secrets, tokens, toxicity and LM scores against plain versions."""

import hashlib
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evolens.llm import bpe, language, lm_scoring, queries, secrets, toxicity
from evolens.llm.words import ALNUM, SPACED, previous, text_bytes, word_hashes

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, "One  two\tONE", "ünï-cödé, 42!", "a" * 5000 + " b", "\x00x\x7fy"]


@pytest.mark.parametrize("inside, pattern", [(SPACED, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words(inside, pattern):
    hashes, counts = word_hashes(*text_bytes(pa.array(TEXTS)), inside)
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = [re.findall(pattern, (t or "").translate(lower)) for t in TEXTS]
    assert counts.tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))
    assert np.array_equal(word_hashes(*text_bytes(pa.array(["one"])), SPACED)[0], word_hashes(*text_bytes(pa.array(["ONE"])), SPACED)[0])


def test_tokens(spark, docs, odd):
    library = Tokenizer.from_file(PATH)
    for table in (docs, odd):
        rows = table.select("doc_id", "text").collect()
        want = []
        for r in rows:
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids
            text = library.decode(ids, skip_special_tokens=False)
            want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        got = [tuple(r) for r in bpe.encode_decode(table, PATH, outputs=()).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_long_words_take_the_heap():
    codec = bpe.encoder(PATH)
    for word in (b"ab" * 90, b"thethe" * 40, bytes(range(97, 123)) * 8):
        ids = [codec.inner[b] for b in word]
        ids[-1] = codec.last[word[-1]]
        assert codec._heap(list(ids)) == codec._scan(list(ids))
    special = "<|endoftext|>x<|startoftext|>ΑΣ it's"
    assert np.frombuffer(codec.encode(special), "<u4").tolist() == Tokenizer.from_file(PATH).encode(special, add_special_tokens=False).ids


def test_language(spark, folder, docs, odd):
    rows = queries.op8_language_ppm(spark, folder).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(r["held_out"] for r in held) and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    model = language.train(docs)
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(odd, model).collect()}
    assert [found[k] for k in (1, 2, 3, 6)] == ["und"] * 4 and found[5] != "und"
    assert language.keep_identified(odd, model).columns == odd.columns
    assert language.keep_identified(odd, model).count() == odd.count() - 4
    assert {r["lang_pred"] for r in language.identify(odd, language.train(docs.limit(0))).collect()} == {"und"}


def test_code_lengths_are_whole(docs):
    model = language.train(docs, sample=20)
    whole = np.frombuffer("the and of\n".encode() * 200_000, np.uint8)
    pieces = np.array([0, len(whole) // 2, len(whole)])
    assert np.allclose(model.code_lengths(whole, np.array([0, len(whole)])).sum(0), model.code_lengths(whole, pieces).sum(0), rtol=1e-4)


BASE = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def test_secrets(spark, folder, docs, odd, tmp_path):
    order = list(BASE)
    want = {}
    for r in docs.collect():
        found = []
        for kind, rule in BASE.items():
            for m in rule.finditer(r["text"]):
                size = len(m[2]) if kind == "assign" else len(m[0])
                if size >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                    found.append((m.start(), order.index(kind), f"{kind}:{m.start()}:{m.end()}"))
        want[r["doc_id"]] = hashlib.sha256(",".join(x[2] for x in sorted(found)).encode()).hexdigest()
    assert {r["doc_id"]: r["base_sha256"] for r in queries.op9_secret_ledger(spark, folder).collect()} == want
    ledger = f"{tmp_path}/ledger"
    first = secrets.scan_increment(odd, ledger).collect()
    assert len(first) == odd.count()
    more = odd.unionByName(odd.limit(1).withColumn("text", F.lit("token = abcdefgh")))
    assert secrets.unseen_blobs(more, spark.read.parquet(ledger)).count() == 1
    assert secrets.unseen_blobs(more, spark.read.parquet(ledger), "2").count() > 1
    assert sum(r["n_assign"] for r in secrets.scan_increment(more, ledger).collect()) == 1


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id bigint, toxic int")
    words = [f"word{k}" for k in range(300)]  # a word counts once for each word before it, so there must be many
    draw = np.random.RandomState(1)
    rows = [(i, " ".join(draw.choice(words, 30)) + (f" {draw.choice(words)} scum {draw.choice(words)} scum" if i % 2 else "")) for i in range(500)]
    texts = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id bigint, text string")
    found = {r["doc_id"]: r["score"] for r in toxicity.scores(texts, toxicity.train(texts, labels)).collect()}
    assert all((found[i] >= 0.5) == bool(i % 2) for i in range(400, 500)) and found[1000] < 0.5 and found[1001] < 0.5
    none = toxicity.train(texts, labels.where("toxic = 0"))
    assert all(r["score"] < 0.5 for r in toxicity.scores(texts, none).collect())


def test_lm_scores(spark, odd):
    texts = spark.createDataFrame([(i, "the cat sat on the mat" if i % 2 else "stocks fell as bonds rose") for i in range(200)], "doc_id bigint, text string")
    models = lm_scoring.train(texts, texts.where("doc_id % 2 = 1").select("doc_id"))
    found = {r["doc_id"]: r["score"] for r in lm_scoring.cross_entropy_difference(texts, models).collect()}
    assert min(found[i] for i in range(1, 200, 2)) > 0 > max(found[i] for i in range(0, 200, 2))
    scores = {r["doc_id"]: r["score"] for r in lm_scoring.cross_entropy_difference(odd, models).collect()}
    assert scores[1] == scores[2] == 0
    nothing = lm_scoring.train(texts, texts.limit(0).select("doc_id"))
    assert {r["score"] for r in lm_scoring.cross_entropy_difference(texts, nothing).collect()} == {0.0}


@pytest.mark.parametrize("bits", [lm_scoring.HOT_BITS, 3])
def test_lm_scores_count_every_pair(spark, monkeypatch, bits):
    monkeypatch.setattr(lm_scoring, "HOT_BITS", bits)  # few bits: pairs are joined, not looked up
    draw = np.random.RandomState(5)
    texts = [" ".join(f"w{x}" for x in draw.zipf(1.3, 40) % 3000) for _ in range(120)]
    texts = [*texts, texts[0], "", None]
    good = set(range(0, len(texts), 3))
    counts = [{}, {}]
    for i, text in enumerate(texts):
        words = (text or "").split()
        for h, w in zip(["", *words], words):
            for side in [0, 1] if i in good else [1]:
                counts[side][h, w] = counts[side].get((h, w), 0) + 1
    totals = [sum(c.values()) for c in counts]
    vocabulary = len({w for _, w in counts[1]})

    def plain(text):
        words, found = (text or "").split(), 0.0
        for h, w in zip(["", *words], words):
            for side, sign in ((0, 1), (1, -1)):
                scale = totals[0] / totals[side]
                n = {k: scale * sum(v for p, v in counts[side].items() if p[k] == x) for k, x in ((0, h), (1, w))}
                share = (n[1] + 1) / (totals[0] + vocabulary)
                pair = scale * counts[side].get((h, w), 0)
                found += sign * np.log((pair + lm_scoring.WEIGHT * share) / (n[0] + lm_scoring.WEIGHT))
        return found / max(1, len(words))

    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    models = lm_scoring.train(table, table.where("doc_id % 3 = 0"))
    found = {r["doc_id"]: (r["n_words"], r["score"]) for r in lm_scoring.cross_entropy_difference(table, models).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        assert found[i][0] == len((text or "").split()) and found[i][1] == pytest.approx(plain(text), abs=1e-6)
    new = spark.createDataFrame([(1, "w1 unseen w1 w2 w2 w1 other")], "doc_id bigint, text string")
    assert lm_scoring.cross_entropy_difference(new, models).first()["score"] == pytest.approx(plain("w1 unseen w1 w2 w2 w1 other"), abs=1e-6)


def test_lm_chunks_and_buckets_change_nothing(spark, monkeypatch):
    draw = np.random.RandomState(3)
    rows = [(i % 150, " ".join(f"w{x}" for x in draw.zipf(1.3, 50) % 2000)) for i in range(200)]
    table = spark.createDataFrame([*rows, *rows[:5], (None, "w1 w2"), (7, None)], "doc_id bigint, text string").repartition(3)

    def scores():
        models = lm_scoring.train(table, table.where("doc_id % 3 = 0").select("doc_id"))
        return sorted(((r["doc_id"], r["n_words"], round(r["score"], 7)) for r in lm_scoring.cross_entropy_difference(table, models).collect()), key=str)

    def pairs_of(k):
        models = lm_scoring.Models(True, None, hot=np.empty(0, np.uint64), hot_counts=np.empty((0, 4)))
        part = (np.array([5, 6, 5, 6, 5], np.uint64), np.array([0, 5, 6, 5, 0], np.uint64), np.array([4, 1]), np.array([1, 2]), np.array([5, 4], np.int8))
        monkeypatch.setattr(lm_scoring.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
        moved = list(lm_scoring._dealt(models, k, 0, [part]))
        monkeypatch.undo()
        return sum(len(r.column("befores")[0]) for r in moved), sum(sum(r.column("times")[0].as_py()) for r in moved)

    assert pairs_of(1) == pairs_of(7) == (3, 5)  # three different pairs move once each, for all five places
    want = scores()
    monkeypatch.setattr(lm_scoring, "GATHERED", 500)
    monkeypatch.setattr(lm_scoring, "BUCKET_WORDS", 300)
    monkeypatch.setattr(lm_scoring, "CHUNK_TEXTS", 16)
    monkeypatch.setattr(lm_scoring, "HOT_BITS", 5)
    monkeypatch.setattr(lm_scoring, "MOST_BROADCAST", 3)
    assert scores() == want and len(want) == 207


def test_lm_chunks_are_sorted_in_portions(monkeypatch):
    monkeypatch.setattr(lm_scoring.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    draw = np.random.RandomState(5)
    n, texts = 1 << 20, 3000
    words = draw.randint(1, 1 << 62, 50_000).astype(np.uint64)[draw.zipf(1.3, n) % 50_000]
    counts = draw.multinomial(n, np.ones(texts) / texts)
    hot, n_hot = np.unique(words, return_counts=True)
    hot = hot[n_hot > n >> 8]
    models = lm_scoring.Models(True, None, hot=hot, hot_counts=draw.randint(1, 1000, (len(hot), 4)))
    parts = [(words, previous(words, counts, 1), counts, np.arange(texts), np.full(texts, 5, np.int8))]
    del words
    tracemalloc.start()
    moved = sum(int(r.column("times")[0].values.to_numpy().sum()) for r in lm_scoring._dealt(models, 40, 0, parts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert moved == n and peak < 70 * n  # all at once they took 131 bytes a word


def test_lm_target_is_not_sampled(spark, folder, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(lm_scoring, "train", lambda docs, target: seen.append(target.count()))
    monkeypatch.setattr(lm_scoring, "cross_entropy_difference", lambda docs, models: docs)
    spark.range(50_000).selectExpr("id as doc_id", "1 as quality", "0 as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    spark.range(1).selectExpr("id as doc_id", "'x' as text").write.parquet(f"{tmp_path}/documents.parquet")
    queries.op1_cross_entropy_difference(spark, str(tmp_path))
    assert seen == [50_000]


def test_toxicity_is_kneser_ney(spark):
    toxic = ["you scum go now", "you scum go", "old scum ran"]  # three predecessors of `scum` were too few to count
    ordinary = ["you cats go now", "you cats go", "old dogs ran"]
    texts = spark.createDataFrame(list(enumerate(toxic + ordinary)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 3)) for i in range(6)], "doc_id bigint, toxic int")
    model = toxicity.train(texts, labels)

    def likelihoods(before, words):
        text = " ".join(f"{before} {w}" if before else w for w in words).encode()
        found = model.likelihoods(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
        return found[1::2] if before else found

    known = sorted({w for t in toxic + ordinary for w in t.split()})
    for before in ("you", "scum", "cats"):
        assert (likelihoods(before, known).sum(0) < 1).all()
        assert np.allclose(likelihoods(before, [*known, "unknown"]).sum(0), 1, atol=1e-5)  # a model is a distribution
    after = likelihoods("you", ["scum", "cats"])
    assert after[0, 1] > 5 * after[0, 0] and after[1, 0] > 5 * after[1, 1]
    # toxic pairs: 4 seen once (start old, old scum, scum ran, go now), 3 twice (start you, you scum, scum go)
    assert model.pairs(word_pair("you", "scum"))[0].tolist() == pytest.approx([0, (2 - 4 / (4 + 2 * 3)) / 2])


def word_pair(before, word):
    from evolens.llm.words import combine

    text = f"{before} {word}".encode()
    words, _ = word_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]), ALNUM)
    return combine(words[:1], words[1:])


def test_private_keys_of_any_length():
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    key = begin + "\nA/+z\n" * 50_000 + end
    assert [f for f in secrets.find(f"x {key} y {end} {begin}") if f[2] == "private_key"] == [(2, 2 + len(key), "private_key")]
    assert [f[:2] for f in secrets.find(begin + key + key) if f[2] == "private_key"] == [(len(begin), len(begin + key)), (len(begin + key), len(begin + 2 * key))]
