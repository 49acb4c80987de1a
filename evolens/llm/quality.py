"""Document quality by supervised subword embeddings.

A text's features are its words (runs without white space, case and punctuation kept), pairs of neighbouring words, and
the character n-grams of NGRAMS code points of each word with a space at both ends, hashed into `2**bits` buckets; all
pairs of a word with itself are one feature. Every bucket has a learned vector; the mean of a text's vectors goes through
a softmax over the classes. Buckets and output are trained together by stochastic gradient descent on the cross-entropy,
in numpy, text by text in a fixed random order, with a step that falls linearly.

Since the output is linear in the mean, a trained model scores a text as the mean of one number per bucket (its vector
times the difference of the classes' output weights); this is the same score, and what the executors need is one array.

Training takes at most `sample` labelled texts of each class, drawn by hash of their id: one text an id (the one with the
smallest hash, if an id has several), ids labelled both ways and other labels left out, null ids and texts too. Features
are extracted where the rows are; the bounded sample of feature counts is trained in one task, and the classes count by
their share of the labelled ids, so that scores are shares of label 1 and not of a balanced sample. Texts without words
(null, empty, white space) get the share of label 1 among the labelled ids; so do all texts when a class has no rows.
Very long texts are worked through in slices; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evolens.llm.words import slices
from evolens.session import materialise

NGRAMS = (3, 4, 5)
WIDTH = 10
EPOCHS = 3
STEP = 0.5
SLICE = 1 << 20  # code points worked on at once
_MIX = np.uint32(0x9E3779B1)
_UNMIX = np.uint32(pow(0x9E3779B1, -1, 1 << 32))
#: Set the hashes of words and of a word after itself apart from those of characters.
WORD, REPEAT = np.uint32(0x51ED270B), np.uint32(0x2545F491)


def _scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return h ^ (h >> np.uint32(13))


def bucket_of(feature: str, bits: int) -> int:
    """The bucket of a character n-gram."""
    with np.errstate(over="ignore"):
        return int(_bucket(_hash(feature), bits)[0])


def word_bucket(before: str | None, word: str, bits: int) -> int:
    """The bucket of a word, or of the pair with the word before."""
    with np.errstate(over="ignore"):
        of_word = _hash(f" {word} ")
        return int(_bucket(of_word + WORD if before is None else _pairs(_hash(f" {before} "), of_word), bits)[0])


def _hash(text: str) -> np.ndarray:
    h = np.zeros(1, dtype=np.uint32)
    for c in text:
        h = (h + np.uint32(ord(c) + 1)) * _MIX
    return h


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return _scrambled(h) >> np.uint32(32 - bits)


def _pairs(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return np.where(before == word, REPEAT, (before + WORD) * _MIX ^ word)


def _ngrams(codes: np.ndarray, space: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes and places of the n-grams with no white space but at their first and last character."""
    n = len(codes)
    h, inner = codes * _MIX, np.ones(n, dtype=bool)
    for length in range(2, min(max(NGRAMS), n) + 1):
        m = n - length + 1
        h = (h[:m] + codes[length - 1 :]) * _MIX
        inner = inner[:m] if length == 2 else inner[:m] & ~space[length - 2 : n - 1]
        if length in NGRAMS:
            at = np.flatnonzero(inner)
            yield h[at], at


def _words(codes: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the words, with a space at both ends, as `_hash` gives them."""
    starts = np.flatnonzero(space[:-1] & ~space[1:])
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 2
    # The hash is the sum of codes * MIX^(characters to the end): a difference of sums over the whole run.
    up, down = (np.cumprod(np.concatenate((np.ones(1, np.uint32), np.full(len(codes), x))), dtype=np.uint32) for x in (_MIX, _UNMIX))
    sums = np.concatenate((np.zeros(1, np.uint32), np.cumsum(codes * down[:-1], dtype=np.uint32)))
    return (sums[ends] - sums[starts]) * up[ends], starts


def features(texts: list[str | None], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the features of the texts, and which text each is of, in slices cut at white space."""
    joined = " " + " ".join(t or "" for t in texts) + " "
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    ends = np.cumsum([len(t or "") + 1 for t in texts])
    last, last_text = np.zeros(1, np.uint32), -1
    at = 0
    while at < len(points) - 1:
        to = min(len(points), at + SLICE)
        spaces = np.flatnonzero(_white(points[at + 1 : to]))
        while not len(spaces):  # one word is longer than a slice
            more = min(len(points), to + SLICE)
            spaces, to = np.flatnonzero(_white(points[to:more])) + (to - at - 1), more
        to = at + 2 + int(spaces[-1])
        space = _white(points[at:to])
        codes = np.where(space, np.uint32(33), points[at:to] + np.uint32(1))
        with np.errstate(over="ignore"):
            found = list(_ngrams(codes, space))
            words, places = _words(codes, space)
            if len(words):
                which = np.searchsorted(ends, places + at, side="right")
                before, before_text = np.concatenate((last, words[:-1])), np.concatenate(([last_text], which[:-1]))
                same = before_text == which
                found += [(words + WORD, places), (_pairs(before[same], words[same]), places[same])]
                last, last_text = words[-1:], which[-1]
            if found:
                places = np.concatenate([x for _, x in found]) + at
                yield _bucket(np.concatenate([x for x, _ in found]), bits), np.searchsorted(ends, places, side="right")
        at = to - 1


def _white(points: np.ndarray) -> np.ndarray:
    return (points == 32) | ((points >= 9) & (points <= 13))


def _counted(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text's buckets and how often it has them."""
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            keys = [(which.astype(np.int64) << bits) | buckets for buckets, which in features(texts, bits)]
            keys, n = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64),) * 2
            offsets = np.searchsorted(keys >> bits, np.arange(len(texts) + 1)).astype(np.int32)
            buckets = pa.ListArray.from_arrays(pa.array(offsets), pa.array((keys & ((1 << bits) - 1)).astype(np.int32)))
            counts = pa.ListArray.from_arrays(pa.array(offsets), pa.array(n.astype(np.float32)))
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("spot"), buckets, counts], ["label", "spot", "buckets", "counts"])

    return run


def descend(labels: np.ndarray, buckets: list[np.ndarray], counts: list[np.ndarray], weights: np.ndarray, bits: int, epochs: int = EPOCHS, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Bucket vectors and output weights (WIDTH + 1 by 2, the last row a bias) after stochastic gradient descent.

    weights: what a text of class 0 and of class 1 counts.
    """
    draw = np.random.RandomState(seed)
    vectors = draw.uniform(-1 / WIDTH, 1 / WIDTH, (1 << bits, WIDTH)).astype(np.float32)
    output = np.zeros((WIDTH + 1, 2), dtype=np.float32)
    steps, done = epochs * len(labels), 0
    for _ in range(epochs):
        for i in draw.permutation(len(labels)):
            share = counts[i] / counts[i].sum()
            own = vectors[buckets[i]]
            hidden = np.append(share @ own, np.float32(1))
            scores = np.exp(hidden @ output - (hidden @ output).max())
            error = scores / scores.sum()
            error[labels[i]] -= 1
            error *= np.float32(STEP * (1 - done / steps)) * weights[labels[i]]
            # The text moves its vectors so far that its own mean moves by the whole step, however many they are.
            vectors[buckets[i]] = own - np.outer(share / (share @ share), output[:WIDTH] @ error)
            output -= np.outer(hidden, error)
            done += 1
    return vectors, output


@dataclass
class Model:
    """One number per bucket and a bias: a text's log-odds of label 1 are the bias and the mean of its buckets' numbers."""

    values: np.ndarray | None
    bias: float
    prior: float
    bits: int

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.values is None:
            return np.full(len(texts), self.prior)
        sums, n = np.zeros(len(texts)), np.zeros(len(texts))
        for buckets, which in features(texts, self.bits):
            sums += np.bincount(which, self.values[buckets], len(texts))
            n += np.bincount(which, minlength=len(texts))
        found = 1 / (1 + np.exp(-np.clip(self.bias + sums / np.maximum(n, 1), -700, 700)))
        return np.where(n > 0, found, self.prior)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 2_000, bits: int = 17, epochs: int = EPOCHS) -> Model:
    """docs: doc_id and text; labels: doc_id and `label` (0 or 1)."""
    rated = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id")
    agreed = rated.agg(F.min(label).alias("label"), F.max(label).alias("_most")).where("label = _most").drop("_most")
    sizes = {r["label"]: r["count"] for r in agreed.groupBy("label").count().collect()}
    prior = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)
    if len(sizes) < 2:
        return Model(None, 0.0, prior, bits)
    spot = F.xxhash64(F.lit("quality"), "doc_id")
    share = F.when(F.col("label") == 1, sample / sizes[1]).otherwise(sample / sizes[0])
    chosen = agreed.where(F.pmod(spot, F.lit(1 << 30)) / (1 << 30) < share)
    # About 2 * sample ids, by the share drawn; then one text for each.
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    one = texts.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("label", F.xxhash64("doc_id").alias("spot"), "text")
    counted = materialise(one.mapInArrow(_counted(bits), "label int, spot bigint, buckets array<int>, counts array<float>"))
    total = sum(sizes.values())
    balance = np.array([2 * sizes[0] / total, 2 * sizes[1] / total], dtype=np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).sort_by("spot") if (batches := list(batches)) else None
        if rows is None:
            return
        rows = rows.filter(pc.greater(pc.list_value_length(rows["buckets"]), 0))
        classes = rows["label"].to_numpy()
        if len(np.unique(classes)) < 2:
            return
        parts = [np.split(col.values.to_numpy(), col.offsets.to_numpy()[1:-1]) for col in (rows[c].combine_chunks() for c in ("buckets", "counts"))]
        own = np.array([(classes == k).mean() for k in (0, 1)], dtype=np.float32)
        vectors, output = descend(classes, *parts, balance / (2 * own), bits, epochs)
        apart = output[:, 1] - output[:, 0]
        values = vectors @ apart[:WIDTH]
        yield pa.RecordBatch.from_arrays([pa.array([values.tobytes()], pa.binary()), pa.array([float(apart[WIDTH])])], ["values", "bias"])

    found = counted.coalesce(1).mapInArrow(run, "values binary, bias double").collect()  # one model
    if not found:
        return Model(None, 0.0, prior, bits)
    return Model(np.frombuffer(found[0]["values"], dtype=np.float32), found[0]["bias"], prior, bits)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = shared.value.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
