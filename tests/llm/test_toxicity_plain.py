"""The Kneser-Ney models against plain ones over dictionaries, with and without each training text's own counts."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from evolens.llm import toxicity
from evolens.llm.words import ALNUM, word_hashes
from pyspark.sql import functions as F

STEM = toxicity.STEM


def pairs_of(text):
    words = (text or "").split()
    return list(zip(["", *words], words))


class Plain:
    def __init__(self, texts, classes):
        self.vocabulary = {w for t in texts for _, w in pairs_of(t)}
        self.pairs = [Counter(p for t, c in zip(texts, classes) if c == k for p in pairs_of(t)) for k in (0, 1)]
        self.discounts = [[self.discount(self.order(p, o)) for p in self.pairs] for o in range(3)]

    @staticmethod
    def order(pairs, o):
        if o == 0:
            return Counter({p: n for p, n in pairs.items() if n > 0})
        return Counter(w if o == 1 else w[:STEM] for (_, w), n in pairs.items() if n > 0)

    @staticmethod
    def discount(counts):
        once, twice = (sum(n == k for n in counts.values()) for k in (1, 2))
        return once / (once + 2 * twice) if once and twice else toxicity.DISCOUNT

    def models(self, own=(), c=0):
        """p(word | before) of each class, without the pairs `own` in class c."""
        pairs = [Counter(p) for p in self.pairs]
        pairs[c].subtract(own)
        words, stems = ([self.order(p, o) for p in pairs] for o in (1, 2))
        forms = Counter(w[:STEM] for w in self.vocabulary)
        every = sum(sum(w.values()) for w in words) + len(self.vocabulary) + 1

        def p(k, h, w):
            total, s = max(1, sum(words[k].values())), w[:STEM]
            d_pair, d_word, d_stem = (d[k] for d in self.discounts)
            shared = (words[0][w] + words[1][w] + 1) / every
            base = max(1, stems[0][s] + stems[1][s] + forms[s]) / every
            stem = max(stems[k][s] - d_stem, 0) / total / base + d_stem * len(stems[k]) / total
            word = max(words[k][w] - d_word, 0) / total + d_word * len(words[k]) / total * stem * shared
            after = [n for (x, _), n in pairs[k].items() if x == h and n > 0]
            if not after:
                return word
            return max(pairs[k][h, w] - d_pair, 0) / sum(after) + d_pair * len(after) / sum(after) * word

        return p

    def difference(self, text, without=None):
        own = pairs_of(text)
        p = self.models(own if without is not None else (), without or 0)
        return sum(np.log(p(1, h, w)) - np.log(p(0, h, w)) for h, w in own) / max(1, len(own)) ** 0.5


@pytest.fixture(scope="module")
def corpus():
    draw = np.random.RandomState(7)
    texts = [" ".join(f"{'bad' if i % 3 == 0 and x % 4 == 0 else 'word'}{x}" for x in draw.zipf(1.4, 1 + i % 30) % 300) for i in range(60)]
    texts += [texts[0], texts[1], ""]
    return texts, [int(i % 3 == 0) for i in range(len(texts))]


def test_scores_are_those_of_plain_models(spark, corpus, monkeypatch):
    monkeypatch.setattr(toxicity, "PART", 100)
    texts, classes = corpus
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame(list(enumerate(classes)), "doc_id bigint, toxic int")
    plain = Plain(texts, classes)
    model = toxicity.train(docs, labels)
    new = ["word1 unseen bad4", "badly wordy word2 word2", "x"]
    asked = spark.createDataFrame(list(enumerate(texts + new)), "doc_id bigint, text string")
    found = {r["doc_id"]: r["difference"] for r in toxicity.scores(asked, model).collect()}
    for i, text in enumerate(texts + new):
        assert found[i] == pytest.approx(plain.difference(text), abs=1e-4)


def test_own_counts_are_left_out(spark, corpus):
    texts, classes = corpus
    rows = spark.createDataFrame([(c, t) for c, t in zip(classes, texts)], "toxic int, text string")
    kept = "word bigint, before bigint"
    counted = rows.mapInArrow(toxicity._pairs, f"{kept}, n0 bigint, n1 bigint").groupBy("word", "before").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    stems = rows.mapInArrow(toxicity._stems, "word bigint, stem bigint").distinct()
    model, made_of = toxicity._fit(counted, stems)
    data = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(d) for d in data])))
    shares, counts = made_of.without_own(model, np.frombuffer(b"".join(data), np.uint8), offsets, np.array(classes))
    assert counts.tolist() == [len(t.split()) for t in texts]
    means, _ = toxicity._differences(shares, counts)
    plain = Plain(texts, classes)
    for i, (text, c) in enumerate(zip(texts, classes)):
        assert means[i] == pytest.approx(plain.difference(text, without=c), abs=1e-4)


def test_odd_rows(spark):
    texts = ["you scum", "you scum", "nice cats here", None, "", "other nice cats", "you scum"]
    ids = [1, 1, 2, 3, None, 4, None]
    docs = spark.createDataFrame([(i, t, 0.5, 0.5, 1) for i, t in zip(ids, texts)], "doc_id bigint, text string, score double, difference double, toxic int")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (4, 0), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    rows = toxicity.scores(docs, model).collect()
    assert len(rows) == 7 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 1}) == 1
    assert toxicity.scores(docs.limit(0), model).count() == 0
    nothing = toxicity.train(docs.limit(0), labels)
    assert all(r["score"] < 0.5 for r in toxicity.scores(docs, nothing).collect())


def test_large_models_are_the_same(spark, corpus, monkeypatch):
    texts, classes = corpus
    rows = [*enumerate(texts), (1, texts[1]), (None, texts[2]), (900, None), (901, "never seen word1"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).withColumn("toxic", F.lit("x"))
    labels = spark.createDataFrame([*enumerate(classes[:-10]), (900, 1), (None, 1), (901, 0), (901, 1)], "doc_id bigint, toxic int")
    new = spark.createDataFrame([(1, "word1 unseen bad4"), (2, "badly wordy word2 word2"), (2, texts[3]), (3, "")], "doc_id bigint, text string")

    def rated():
        model = toxicity.train(docs, labels)
        found = [sorted((tuple(r) for r in toxicity.scores(d, model).collect()), key=str) for d in (docs, new)]
        return model, [(i, pytest.approx(d, abs=1e-4), pytest.approx(x, abs=1e-4)) for f in found for i, d, x in f], [x for f in found for x in f]

    model, want, _ = rated()
    for name, value in {"LOCAL_BYTES": 0, "CHUNK_BYTES": 300, "BUCKET_PAIRS": 20, "MOST_BROADCAST": 3}.items():
        monkeypatch.setattr(toxicity, name, value)
    large, _, found = rated()
    assert model.shared and large.large and large.pairs is None
    assert sorted((str(x[0]) for x in found)) == sorted(str(x[0]) for x in want)
    assert sorted(found, key=lambda x: (str(x[0]), x[1])) == sorted(want, key=lambda x: (str(x[0]), x[1].expected))
    assert (large.middle, large.width) == pytest.approx((model.middle, model.width), abs=1e-4)
    none = toxicity.train(docs, labels.where("toxic = 0"))
    assert all(r["score"] < 0.5 for r in toxicity.scores(docs, none).collect())


def test_every_labelled_text_is_learned(spark):
    docs = spark.range(24_000).selectExpr("id as doc_id", "concat('word', id) as text")
    model = toxicity.train(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic"))
    assert len(model.words.keys) == len(model.pairs.keys) == 24_000  # about 10,000 of each class were


def test_large_models_leave_little_on_disk(spark, tmp_path, monkeypatch):
    """Shuffled at once were all texts and pairs; now a share of either, and files go with the step they were written for."""
    for name, value in {"LOCAL_BYTES": 0, "CHUNK_BYTES": 2000, "BUCKET_PAIRS": 500, "PORTION_CHUNKS": 1}.items():
        monkeypatch.setattr(toxicity, name, value)
    docs = spark.range(400).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 60), x -> concat('w', hash(id, x) % 500))) as text")
    docs.repartition(4).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) as toxic")
    rated, rate = [], toxicity._rate_portion
    monkeypatch.setattr(toxicity, "_rate_portion", lambda totals, texts, *a: (rated.append(texts.count()), rate(totals, texts, *a))[1])
    kept = {k: spark.conf.get(k, None) for k in toxicity.LEAN}
    model = toxicity.train(docs, labels)
    assert toxicity.scores(docs, model).count() == sum(rated) == 400
    assert len(rated) > 2 and max(rated) < 200
    assert {k: spark.conf.get(k, None) for k in toxicity.LEAN} == kept


def test_a_pass_deals_its_share_of_the_buckets():
    rows = pa.RecordBatch.from_pydict({"chunk": pa.array([1, 1, 1]), "toxic": pa.array([0, 1, None], pa.int32()), "text": ["a b c d e f g", "b c d a", "x y z a b"]})

    def dealt(*share):
        found = [r for b in toxicity._deal(8, *share, iter([rows])) for r in b.to_pylist()]
        return [(r["bucket"], sorted(zip(r["words"], r["befores"], r["pair0"], r["pair1"])), sorted(r["keys"])) for r in found]

    whole, parts = dealt(1, 0), [dealt(4, turn) for turn in range(4)]
    assert sorted(r for p in parts for r in p) == whole
    assert all(r[0] % 4 == turn for turn, p in enumerate(parts) for r in p)
    assert max(map(len, parts)) < len(whole)
