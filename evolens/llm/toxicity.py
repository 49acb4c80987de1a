"""Toxicity by class-conditional Kneser-Ney models of words.

Two interpolated Kneser-Ney models, of toxic and of ordinary texts. A class's p(word | word before) is its raw count of
the pair less a discount, over its count of the word before; the mass taken off goes to the word's continuation
probability: how many different words come before it in the class, less a discount; that mass goes to the same of all
words with the word's first STEM bytes (for rare forms), and last to the unigram of continuations that both classes
share. Every order interpolates with the next, so each model gives all words a probability and sums to 1. Discounts are
n1 / (n1 + 2 n2) of each class and order (n1 and n2: what was counted once and twice). A text's score is the difference
of the two log-likelihoods, added up over its words and divided by the square root of their number (what chance adds
grows with that root, so that texts of all lengths compare), on a scale whose middle (0.5) is the best threshold on the
training texts, each scored by the models without what the text itself was counted for (its pairs, and the continuations
that only it has); discounts and vocabulary stay.

Training takes every labelled text. Up to LOCAL_BYTES of them, every task holds the models. Beyond, the models stay in
tables: texts are taken in chunks of about CHUNK_BYTES, a chunk's different pairs are dealt into buckets by hash, where
all chunks' pairs meet and are counted, and each chunk gets back the counts of its pairs, if others add to its own, and of
its words and stems: the part of the models that its texts ask for. To need less disk at a time, pairs are dealt in PASSES
over the texts, each for a share of the buckets, chunks are rated in PORTIONS, and shuffle files go with the step they were
written for. Discounts and totals are sums over the tables, and the threshold is found from running
totals of all training texts. Both ways give the same scores. Texts without words, and all texts if a class has no training rows, score as texts that say nothing. Rows that
repeat are scored each; rows without an id are scored and train nothing; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evolens.llm.words import ALNUM, combine, previous, slices, text_bytes, text_sums, word_hashes
from evolens.operators.joins import lookup_join
from evolens.operators.ordering import running_totals
from evolens.session import materialise

STEM = 4
STEEPNESS = 4.0
DISCOUNT = 0.75  # where nothing was counted once, or nothing twice
PART = 1 << 19  # pairs that the driver works on at once
LOCAL_BYTES = 24 << 20  # of labelled texts whose models the driver and every task hold
CHUNK_BYTES = 8 << 20
BUCKET_PAIRS = 1 << 20
PASSES = 4  # over the texts, each for a share of the buckets
PORTIONS = 16  # of chunks, rated one after the other
PORTION_CHUNKS = 5  # at least in a portion
LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}
BYTES_A_WORD = 6
MOST_BROADCAST = 1_000_000  # labels
WORD, STEM_OF, PAIR = range(3)


@dataclass
class Table:
    """Values of sorted keys, a row of `other` for keys that are not there."""

    keys: np.ndarray
    values: np.ndarray
    other: np.ndarray

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the asked keys are, and which of them are missing."""
        if not len(self.keys):
            return np.zeros(len(asked), np.int64), np.arange(len(asked))
        some, _, place = _unique(asked)  # sorted keys are found several times faster
        at = np.searchsorted(self.keys, some)
        at[at == len(self.keys)] = 0
        return at[place], np.flatnonzero((self.keys[at] != some)[place])

    def take(self, at: np.ndarray, missing: np.ndarray) -> np.ndarray:
        """Values at what `find` of a table with the same keys returned."""
        if not len(self.keys):
            return np.tile(self.other, (len(at), 1))
        found = np.take(self.values, at, axis=0).astype(np.result_type(self.values, self.other), copy=False)
        found[missing] = self.other
        return found

    def __call__(self, asked: np.ndarray) -> np.ndarray:
        return self.take(*self.find(asked))


class Found:
    """The words of some texts, and where the tables of a model have them."""

    def __init__(self, model: Model, data: np.ndarray, offsets: np.ndarray):
        self.words, self.counts = word_hashes(data, offsets, ALNUM)
        self.stems, _ = word_hashes(data, offsets, ALNUM, STEM)
        self.before = previous(self.words, self.counts, 1)
        self.pair = combine(self.before, self.words)
        self.shares = model.pairs(self.pair)
        self.at_before, self.at_word, self.at_stem = model.befores.find(self.before), model.words.find(self.words), model.stems.find(self.stems)


@dataclass
class Model:
    """Discounted shares of ordinary and toxic by pair, word and stem; the differences that score 0.5 and as saying nothing."""

    pairs: Table | None = None  # share of the pair after the word before
    befores: Table | None = None  # mass that the word before leaves to continuations
    words: Table | None = None  # share of continuations; shared unigram
    stems: Table | None = None  # probability of the stem over its shared probability
    left: np.ndarray = field(default_factory=lambda: np.ones(2))  # mass that words leave to stems
    middle: float = 0.0
    width: float = 1.0
    shared: Broadcast | None = None  # these tables and their Counts in every task
    large: Large | None = None  # instead of all these tables

    def likelihoods(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """p(word | word before) under both models, a row for each word; words per text."""
        found = Found(self, data, offsets)
        return self.likelihoods_of(found), found.counts

    def likelihoods_of(self, found: Found) -> np.ndarray:
        word = self.words.take(*found.at_word)
        continued = word[:, :2] + self.left * self.stems.take(*found.at_stem) * word[:, 2:]
        return found.shares + self.befores.take(*found.at_before) * continued

    def differences(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length-normalised difference of the log-likelihoods and number of words of each text."""
        if self.pairs is None:
            _, counts = word_hashes(data, offsets, ALNUM)
            return np.zeros(len(counts)), np.zeros_like(counts)
        return _differences(*self.likelihoods(data, offsets))


def _differences(shares: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return text_sums(np.log(shares[:, 1]) - np.log(shares[:, 0]), counts) / np.sqrt(np.maximum(counts, 1)), counts


def _unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted different keys, a row of each (not always the first), and the place of each row's key."""
    order = np.argsort(keys)
    ordered = keys[order]
    begins = np.ones(len(keys), dtype=bool)
    begins[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(keys), dtype=np.int64)
    place[order] = np.cumsum(begins) - 1
    return ordered[begins], order[begins], place


class Groups:
    """Rows with equal keys, and sums and distinct counts over them, each given back to its rows."""

    def __init__(self, *keys: np.ndarray):
        _, self.first, self.place = _unique(combine(*keys))

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.place, weights=values, minlength=len(self.first))[self.place]

    def once(self) -> np.ndarray:
        """1 in one row of each group, else 0."""
        marks = np.zeros(len(self.place))
        marks[self.first] = 1
        return marks


@dataclass
class Counts:
    """What the model was made of; kept while the training texts are scored."""

    befores: Table  # occurrences and different pairs after the word before, by class
    words: Table  # continuations by class
    stems: Table  # continuations by class, words
    total: np.ndarray  # continuations of each class
    kinds: np.ndarray  # words of each class
    forms: np.ndarray  # stems of each class
    every: float
    discounts: tuple[list[float], list[float], list[float]]  # of pairs, words, stems

    def without_own(self, model: Model, data: np.ndarray, offsets: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As Model.likelihoods, each text under the models without its own counts. toxic: class of each text."""
        found = Found(model, data, offsets)
        return self.without_own_of(model, found, toxic), found.counts

    def without_own_of(self, model: Model, found: Found, toxic: np.ndarray) -> np.ndarray:
        words, stems, before, pair, counts = found.words, found.stems, found.before, found.pair, found.counts
        text = np.repeat(np.arange(len(counts)).astype(np.uint64), counts)
        mine = np.eye(3, 2)[np.repeat(toxic, counts)]  # a row for each word, 1 under the class of its text (no 1, if that is -1)
        d_pair, d_word, d_stem = (np.array(d) for d in self.discounts)
        shares, after = found.shares.astype(np.float64), self.befores.take(*found.at_before)
        n = np.where(shares > 0, np.rint(shares * after[:, :2] + d_pair), 0.0)
        pairs, befores, same, like = Groups(text, pair), Groups(text, before), Groups(text, words), Groups(text, stems)
        ones = np.ones(len(words))
        own = pairs.sums(ones)[:, None] * mine
        only = (pairs.once()[:, None] * mine) * (n == own)  # marks each pair that no other text of the class has

        def less(counted: np.ndarray, groups: Groups) -> np.ndarray:
            return counted - sum(groups.sums(only[:, c])[:, None] * np.eye(2)[c] for c in (0, 1))

        def by_text(values: np.ndarray) -> np.ndarray:
            return np.stack([np.repeat(text_sums(values[:, c], counts), counts) for c in (0, 1)], axis=1)

        n = n - own
        all_after = after[:, :2] - befores.sums(ones)[:, None] * mine
        kinds_after = less(after[:, 2:], befores)
        word, stem = self.words.take(*found.at_word), self.stems.take(*found.at_stem)
        of_word, of_stem = less(word, same), less(stem[:, :2], like)
        total = np.maximum(self.total - by_text(only), 1)
        every = self.every - by_text(only).sum(1, keepdims=True)
        kinds = self.kinds - by_text(same.once()[:, None] * ((of_word <= 0) & (word > 0)))
        forms = self.forms - by_text(like.once()[:, None] * ((of_stem <= 0) & (stem[:, :2] > 0)))
        base = np.maximum(of_stem.sum(1, keepdims=True) + stem[:, 2:], 1) / every
        low = np.maximum(of_stem - d_stem, 0) / total / base + d_stem * forms / total
        shared = (of_word.sum(1, keepdims=True) + 1) / every
        continued = np.maximum(of_word - d_word, 0) / total + d_word * kinds / total * low * shared
        handed = np.where(all_after > 0, d_pair * kinds_after / np.maximum(all_after, 1), 1.0)
        return np.maximum(np.maximum(n - d_pair, 0) / np.maximum(all_after, 1) + handed * continued, np.finfo(float).tiny)


def _classes(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("toxic").to_pylist(), dtype=np.int64)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        words, counts = word_hashes(*text_bytes(batch.column("text")), ALNUM)
        before = previous(words, counts, 1)
        toxic = np.repeat(_classes(batch) == 1, counts)
        _, first, place = np.unique(combine(before, words), return_index=True, return_inverse=True)
        n1 = np.bincount(place[toxic], minlength=len(first))
        n0 = np.bincount(place, minlength=len(first)) - n1
        arrays = [pa.array(x[first].view(np.int64)) for x in (words, before)] + [pa.array(n) for n in (n0, n1)]
        yield pa.RecordBatch.from_arrays(arrays, ["word", "before", "n0", "n1"])


def _stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        data, offsets = text_bytes(batch.column("text"))
        words, first = np.unique(word_hashes(data, offsets, ALNUM)[0], return_index=True)
        stems = word_hashes(data, offsets, ALNUM, STEM)[0][first]
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (words, stems)], ["word", "stem"])


def _discounts(counts: DataFrame) -> list[float]:
    seen = [F.sum((F.col(f"n{c}") == k).cast("bigint")).alias(f"s{c}{k}") for c in (0, 1) for k in (1, 2)]
    row = counts.agg(*seen).first()
    return [row[f"s{c}1"] / (row[f"s{c}1"] + 2 * row[f"s{c}2"]) if row[f"s{c}1"] and row[f"s{c}2"] else DISCOUNT for c in (0, 1)]


def _table(rows: DataFrame, key: str, columns: list[Column], other: list[float], kind: str = "float") -> Table:
    found = rows.select(key, *(c.cast(kind).alias(f"_{i}") for i, c in enumerate(columns))).toArrow()
    keys = found.column(0).to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return Table(keys[order], np.stack([found.column(i + 1).to_numpy()[order] for i in range(len(columns))], axis=1), np.array(other))


def _pair_shares(counted: DataFrame, befores: Table, discounts: list[float]) -> Table:
    """LOCAL_BYTES bounds both tables; shares are worked out here, part by part, so that no pair is shuffled for them."""
    size = counted.count()
    keys, shares = np.empty(size, np.uint64), np.empty((size, 2), np.float32)
    at, parts = 0, -(-size // PART)
    for part in range(parts):
        some = counted.where(F.pmod(F.col("word"), F.lit(parts)) == part)
        rows = some.select("before", "word", F.col("n0").cast("int"), F.col("n1").cast("int")).toArrow()
        before, word = (rows.column(c).to_numpy().view(np.uint64) for c in (0, 1))
        n = np.stack([rows.column(c).to_numpy() for c in (2, 3)], axis=1)
        to = at + len(rows)
        keys[at:to] = combine(before, word)
        shares[at:to] = np.maximum(n - np.array(discounts), 0) / np.maximum(befores(before)[:, :2], 1)
        at = to
    del rows, before, word, n
    pa.default_memory_pool().release_unused()
    order = np.argsort(keys)
    return Table(keys[order], shares[order], np.zeros(2))


def _fit(counted: DataFrame, stem_of: DataFrame) -> tuple[Model, Counts | None]:
    """counted: word, before, n0 and n1 (ordinary and toxic occurrences), a row for each pair; stem_of: word and stem."""
    n = [F.col("n0"), F.col("n1")]
    kinds = [F.sum((x > 0).cast("bigint")) for x in n]
    words = materialise(counted.groupBy("word").agg(*(k.alias(f"n{c}") for c, k in enumerate(kinds))).join(stem_of, "word"))
    total = words.agg(F.sum("n0"), F.sum("n1"), F.count("*"), *kinds).first()
    if not total[0] or not total[1]:
        return Model(), None
    every = total[0] + total[1] + total[2] + 1  # one more for all unknown words
    stems = materialise(words.groupBy("stem").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.count("*").alias("_words")))
    forms = stems.agg(*kinds).first()
    befores = [F.sum(f"n{c}").alias(f"all{c}") for c in (0, 1)] + [k.alias(f"kinds{c}") for c, k in enumerate(kinds)]
    befores = materialise(counted.groupBy("before").agg(*befores))
    d_pair, d_word, d_stem = _discounts(counted), _discounts(words), _discounts(stems)

    def left(x: Column, discount: float) -> Column:
        return F.greatest(x - discount, F.lit(0.0))

    handed = [F.coalesce(d_pair[c] * F.col(f"kinds{c}") / F.nullif(F.col(f"all{c}"), F.lit(0)), F.lit(1.0)) for c in (0, 1)]
    shared = (n[0] + n[1] + 1) / every
    of_word = [left(n[c], d_word[c]) / total[c] for c in (0, 1)]
    base = (n[0] + n[1] + F.col("_words")) / every
    rest = [d_stem[c] * forms[c] / total[c] for c in (0, 1)]
    of_stem = [left(n[c], d_stem[c]) / total[c] / base + rest[c] for c in (0, 1)]
    of_befores = _table(befores, "before", [F.col(c) for c in ("all0", "all1", "kinds0", "kinds1")], [0.0] * 4, "double")
    made_of = Counts(
        of_befores,
        _table(words, "word", n, [0.0, 0.0], "double"),
        _table(stems, "stem", [*n, F.col("_words")], [0.0, 0.0, 0.0], "double"),
        np.array(total[:2], dtype=float),
        np.array(total[3:5], dtype=float),
        np.array(forms[:2], dtype=float),
        float(every),
        (d_pair, d_word, d_stem),
    )
    model = Model(
        _pair_shares(counted, of_befores, d_pair),
        _table(befores, "before", handed, [1.0, 1.0]),
        _table(words, "word", [*of_word, shared], [0.0, 0.0, 1 / every]),
        _table(stems, "stem", of_stem, rest),
        np.array([d_word[c] * total[3 + c] / total[c] for c in (0, 1)]),
    )
    return model, made_of


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """docs: doc_id and text; labels: doc_id and toxic (0 or 1; others, and ids labelled both ways, are left out)."""
    rated = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id")
    agreed = rated.agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most")).where("toxic = _most").drop("_most")
    marked = lookup_join(docs.select("doc_id", "text"), materialise(agreed), ["doc_id"], "left", max_rows=MOST_BROADCAST)
    marked = marked.select(F.col("toxic").cast("int").alias("toxic"), "text")
    size = F.octet_length("text")
    all_bytes, labelled = marked.agg(F.sum(size), F.sum(F.when(F.col("toxic").isNotNull(), size))).first()
    if (labelled or 0) > LOCAL_BYTES:
        return _train_large(docs, marked, all_bytes)
    texts = marked.where(F.col("toxic").isNotNull())
    found = texts.mapInArrow(_pairs, "word bigint, before bigint, n0 bigint, n1 bigint")
    stem_of = materialise(texts.mapInArrow(_stems, "word bigint, stem bigint").distinct())
    counted = materialise(found.groupBy("word", "before").agg(*(F.sum(c).alias(c) for c in ("n0", "n1"))))
    model, made_of = _fit(counted, stem_of)
    if made_of is None:
        return model
    model.shared = shared = docs.sparkSession.sparkContext.broadcast((model, made_of))
    del made_of

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, made_of = shared.value
        for batch in slices(batches):
            differences, _ = _differences(*made_of.without_own(model, *text_bytes(batch.column("text")), _classes(batch)))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(differences)], ["toxic", "difference"])

    rated = texts.mapInArrow(rate, "toxic int, difference double").toArrow()
    toxic, differences = (rated.column(c).to_numpy() for c in ("toxic", "difference"))
    model.middle = _best_middle(toxic, differences)
    ordinary = differences[(toxic == 0) & (differences < model.middle)]
    model.width = max(model.middle - float(np.median(ordinary)), 1e-9) if len(ordinary) else 1.0
    return model


@dataclass
class Totals:
    """What all words of the models share."""

    total: np.ndarray
    kinds: np.ndarray
    forms: np.ndarray
    every: float
    discounts: tuple[list[float], list[float], list[float]]

    def part(self, keys: np.ndarray, n: np.ndarray, stats: dict[int, Table], words: np.ndarray, before: np.ndarray, toxic: np.ndarray) -> tuple[Model, Counts]:
        """The models of a chunk's words. keys, n: pairs that other chunks add to, and all their counts; stats: of words (as such,
        then as word before) and stems; toxic: class of each word's text, or another number."""
        d_pair, d_word, d_stem = (np.array(d) for d in self.discounts)
        word, stem = stats[WORD], stats[STEM_OF]
        befores = Table(word.keys, word.values[:, 2:], np.zeros(4))
        pair, first, place = _unique(combine(before, words))
        counts = np.stack([np.bincount(place[toxic == c], minlength=len(pair)) for c in (0, 1)], axis=1)
        counts[np.searchsorted(pair, keys)] = n
        shares = np.maximum(counts - d_pair, 0) / np.maximum(befores(before[first])[:, :2], 1)
        after, kinds_after = befores.values[:, :2], befores.values[:, 2:]
        handed = np.where(after > 0, d_pair * kinds_after / np.maximum(after, 1), 1.0)
        rest = d_stem * self.forms / self.total
        shared = (word.values[:, :2].sum(1, keepdims=True) + 1) / self.every
        of_word = np.maximum(word.values[:, :2] - d_word, 0) / self.total
        base = np.maximum(stem.values[:, :3].sum(1, keepdims=True), 1) / self.every
        of_stem = np.maximum(stem.values[:, :2] - d_stem, 0) / self.total / base + rest
        model = Model(
            Table(pair, shares.astype(np.float32), np.zeros(2)),
            Table(befores.keys, handed.astype(np.float32), np.ones(2)),
            Table(word.keys, np.concatenate((of_word, shared), axis=1).astype(np.float32), np.array([0.0, 0.0, 1 / self.every])),
            Table(stem.keys, of_stem.astype(np.float32), rest),
            d_word * self.kinds / self.total,
        )
        made_of = Counts(
            befores, Table(word.keys, word.values[:, :2], np.zeros(2)), Table(stem.keys, stem.values[:, :3], np.zeros(3)),
            self.total, self.kinds, self.forms, self.every, self.discounts,
        )
        return model, made_of


@dataclass
class Large:
    """Models too large for a task: the corpus they were made of, in chunks, and what its texts were rated."""

    docs: DataFrame
    texts: DataFrame
    size: int
    found: DataFrame | None = None

    def of(self, docs: DataFrame) -> DataFrame:
        """_key, n_words and difference of the texts of `docs`, and maybe of others."""
        if docs is self.docs:
            return self.found
        more = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        with _lean(docs.sparkSession):
            added = _chunks(docs.select(F.lit(None).cast("int").alias("toxic"), "text")).withColumn("chunk", -1 - F.col("chunk"))
            return _by_key(_rate(self.texts.unionByName(added), self.size + more))


_STATS = ["n0", "n1", "all0", "all1", "kinds0", "kinds1"]


@contextmanager
def _lean(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as the table they were written for is there, and tables take less room."""
    before = {k: spark.conf.get(k, None) for k in LEAN}
    for k, v in LEAN.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _chunks(texts: DataFrame) -> DataFrame:
    """texts: toxic (null, if not labelled) and text."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, chunk = 0, TaskContext.get().partitionId() << 32
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, chunk)), *batch.columns], ["chunk", "key", "toxic", "text"])
            size += 64 * batch.num_rows + (pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0)
            if size >= CHUNK_BYTES:
                size, chunk = 0, chunk + 1

    return materialise(texts.select(F.xxhash64("text").alias("key"), "toxic", "text").mapInArrow(dealt, "chunk bigint, key bigint, toxic int, text string"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Neighbouring rows of a chunk."""
    for batch in batches:
        chunks = batch.column("chunk").to_numpy()
        cuts = np.flatnonzero(np.diff(chunks)) + 1
        for low, high in zip([0, *cuts], [*cuts, len(chunks)]):
            if high > low:
                yield int(chunks[low]), batch.slice(low, high - low)


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(values, kind))


def _classes_of_words(rows: pa.RecordBatch | pa.Table, counts: np.ndarray) -> np.ndarray:
    """Class of each word's text, -1 if not labelled."""
    return np.repeat(np.array([-1 if x is None else x for x in rows.column("toxic").to_pylist()], dtype=np.int8), counts)


def _deal(buckets: int, passes: int, turn: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk's different pairs by bucket, those of every `passes`-th bucket from `turn` on: pairs of labelled texts with their
    occurrences in either class, of the others the keys."""
    for chunk, rows in _runs(batches):
        words, counts = word_hashes(*text_bytes(rows.column("text")), ALNUM)
        before, toxic = previous(words, counts, 1), _classes_of_words(rows, counts)
        keys = combine(before, words)
        now = np.flatnonzero(keys % np.uint64(buckets) % np.uint64(passes) == turn)
        words, before, toxic = words[now], before[now], toxic[now]
        keys, first, place = _unique(keys[now])
        n = [np.bincount(place[toxic == c], minlength=len(keys)) for c in (0, 1)]
        words, before = words[first], before[first]
        bucket = (keys % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)  # two bytes are sorted faster
        known = n[0] + n[1] > 0
        order, others = np.flatnonzero(known), np.flatnonzero(~known)
        order = order[np.argsort(words[order])]
        order, others = (x[np.argsort(bucket[x], kind="stable")] for x in (order, others))
        found = np.unique(bucket)
        ends, other_ends = (np.searchsorted(bucket[x], found, side="right") for x in (order, others))
        arrays = [pa.array(found, pa.int64()), pa.array(np.full(len(found), chunk))]
        arrays += [_lists(x[order].view(np.int64), ends, pa.int64()) for x in (words, before)] + [_lists(x[order], ends, pa.int32()) for x in n]
        arrays.append(_lists(keys[others].view(np.int64), other_ends, pa.int64()))
        yield pa.RecordBatch.from_arrays(arrays, ["bucket", "chunk", "words", "befores", "pair0", "pair1", "keys"])


def _count(rows: pa.Table) -> pa.Table:
    """For every chunk the counts of its pairs in a bucket, if others add to its own; in the row without a chunk, each labelled pair."""

    def joined(name: str) -> np.ndarray:
        return np.concatenate([x.values.to_numpy() for x in rows.column(name)])

    words, befores, others = (joined(c).view(np.uint64) for c in ("words", "befores", "keys"))
    chunks, chunk = np.unique(rows.column("chunk").to_numpy(), return_inverse=True)
    chunk = np.concatenate([np.repeat(chunk, [len(x) for x in rows.column(c)]) for c in ("words", "keys")])
    keys, _, place = _unique(np.append(combine(befores, words), others))
    first = np.zeros(len(keys), np.int64)
    first[place[: len(words)]] = np.arange(len(words))
    own = [np.append(joined(c), np.zeros(len(others))) for c in ("pair0", "pair1")]
    n = [np.bincount(place, weights=x, minlength=len(keys)).astype(np.int64) for x in own]
    asked, _, at = _unique(chunk * len(keys) + place)  # by chunk
    own = [np.bincount(at, weights=x, minlength=len(asked)) for x in own]
    of = asked % max(1, len(keys))
    sent = (own[0] != n[0][of]) | (own[1] != n[1][of])
    of, ends = of[sent], np.searchsorted(asked[sent], (np.arange(len(chunks)) + 1) * len(keys))
    known = np.flatnonzero(n[0] + n[1])
    only = np.append(np.zeros(len(chunks), np.int64), len(known))
    columns = [pa.array([*chunks.tolist(), None], pa.int64()), _lists(keys[of].view(np.int64), np.append(ends, len(of)), pa.int64())]
    columns += [_lists(np.append(x[of], x[known]), np.append(ends, len(of) + len(known)), pa.int32()) for x in n]
    columns += [_lists(x[first[known]].view(np.int64), only, pa.int64()) for x in (words, befores)]
    return pa.table(columns, ["chunk", "keys", "pair0", "pair1", "words", "befores"])


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a bucket's pairs add to their words, as such and as word before; as kind PAIR, how many were counted once and twice."""
    for batch in batches:
        for row in range(batch.num_rows):
            words, befores, n0, n1 = (batch.column(c)[row].values.to_numpy() for c in ("words", "befores", "pair0", "pair1"))
            found, _, place = _unique(np.concatenate((words, befores)))
            sides = place[: len(words)], place[len(words) :]
            sums = [np.bincount(at, weights=x, minlength=len(found)) for at, x in zip([sides[0]] * 2 + [sides[1]] * 4, [n0 > 0, n1 > 0, n0, n1, n0 > 0, n1 > 0])]
            pairs = [(n0 == 1).sum(), (n1 == 1).sum(), (n0 == 2).sum(), (n1 == 2).sum(), 0, 0]
            values = [pa.array(np.append(x, p).astype(np.int64)) for x, p in zip(sums, pairs)]
            kinds = np.append(np.full(len(found), WORD), PAIR).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.append(found, 0)), *values], ["kind", "key", *_STATS])


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk's words, with that before all, and their stems."""
    for chunk, rows in _runs(batches):
        data, offsets = text_bytes(rows.column("text"))
        words = np.unique(np.append(word_hashes(data, offsets, ALNUM)[0], np.uint64(0)))
        stems = np.unique(word_hashes(data, offsets, ALNUM, STEM)[0])
        kinds = np.repeat([WORD, STEM_OF], [len(words), len(stems)]).astype(np.int32)
        keys = np.append(words, stems).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), chunk)), pa.array(kinds), pa.array(keys)], ["chunk", "kind", "key"])


def _rate_chunk(totals: Totals, rows: pa.Table, answers: pa.Table) -> pa.Table:
    """Differences of a chunk's texts, and of labelled ones without their own counts. rows: texts, and lists of counted pairs."""
    stats, kinds = {}, answers.column("kind").to_numpy()
    for kind in (WORD, STEM_OF):
        some = answers.filter(pa.array(kinds == kind))
        keys, first = np.unique(some.column("key").to_numpy().view(np.uint64), return_index=True)
        values = [some.column(c).to_numpy().astype(np.float64)[first] for c in _STATS]
        stats[kind] = Table(keys, np.stack(values, axis=1), np.zeros(6))
    pairs = rows.column("pairs").to_numpy()
    lists = [[x.values.to_numpy() for x in rows.filter(pa.array(pairs)).column(c)] for c in ("keys", "pair0", "pair1")]
    keys, n0, n1 = (np.concatenate([np.empty(0, np.int64), *x]) for x in lists)
    texts = rows.filter(pa.array(~pairs)).select(["key", "toxic", "text"])
    del rows, answers, lists
    words, counts = word_hashes(*text_bytes(texts.column("text").combine_chunks()), ALNUM)
    before, toxic = previous(words, counts, 1), _classes_of_words(texts, counts)
    model, made_of = totals.part(keys.view(np.uint64), np.stack((n0, n1), axis=1), stats, words, before, toxic)
    del n0, n1, words, before, toxic
    parts = []
    for batch in slices(texts.combine_chunks().to_batches()):
        found = Found(model, *text_bytes(batch.column("text")))
        differences, counts = _differences(model.likelihoods_of(found), found.counts)
        classes = np.array([-1 if x is None else x for x in batch.column("toxic").to_pylist()])
        own, _ = _differences(made_of.without_own_of(model, found, classes), counts)
        arrays = [batch.column("key"), batch.column("toxic"), *map(pa.array, (counts, differences, own))]
        parts.append(pa.RecordBatch.from_arrays(arrays, ["key", "toxic", "n_words", "difference", "own"]))
    return pa.Table.from_batches(parts, pa.schema([("key", pa.int64()), ("toxic", pa.int32()), ("n_words", pa.int64()), ("difference", pa.float64()), ("own", pa.float64())]))


def _added_up(stats: DataFrame) -> DataFrame:
    return materialise(stats.groupBy("kind", "key").agg(*(F.sum(c).alias(c) for c in _STATS)))


def _rate(texts: DataFrame, size: int) -> DataFrame | None:
    """key, toxic, n_words, difference and own (that without own counts) of all texts of all chunks; None, if a class has no words."""
    buckets = 1 + size // (BYTES_A_WORD * BUCKET_PAIRS)
    lists = "words array<bigint>, befores array<bigint>, pair0 array<int>, pair1 array<int>, keys array<bigint>"
    of_chunk = "chunk bigint, keys array<bigint>, pair0 array<int>, pair1 array<int>, words array<bigint>, befores array<bigint>"
    own, added, passes = [], [], min(PASSES, buckets)
    for turn in range(passes):
        deal = partial(_deal, buckets, passes, turn)
        dealt = texts.select("chunk", "toxic", "text").mapInArrow(deal, f"bucket bigint, chunk bigint, {lists}")
        counted = dealt.groupBy("bucket").applyInArrow(_count, of_chunk).persist(StorageLevel.MEMORY_AND_DISK)
        own.append(materialise(counted.where(F.col("chunk").isNotNull()).select("chunk", "keys", "pair0", "pair1")))
        each = counted.where(F.col("chunk").isNull()).select("words", "befores", "pair0", "pair1")
        added.append(_added_up(each.mapInArrow(_sum_up, "kind int, key bigint, " + ", ".join(f"{c} bigint" for c in _STATS))))
        counted.unpersist()
    own = reduce(DataFrame.unionByName, own)
    stats = _added_up(reduce(DataFrame.unionByName, added))
    stem_of = texts.where(F.col("toxic").isNotNull()).select("text").mapInArrow(_stems, "word bigint, stem bigint").distinct()
    words = stats.where(f"kind = {WORD} and n0 + n1 > 0").select(F.col("key").alias("word"), "n0", "n1")
    stems = materialise(words.join(stem_of, "word").groupBy("stem").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.count("*").alias("all0")))
    kinds = [F.sum((F.col(c) > 0).cast("bigint")) for c in ("n0", "n1")]
    total = words.agg(F.sum("n0"), F.sum("n1"), F.count("*"), *kinds).first()
    if not total[0] or not total[1]:
        return None
    pairs = stats.where(f"kind = {PAIR}").first()
    d_pair = [pairs[f"n{c}"] / (pairs[f"n{c}"] + 2 * pairs[f"all{c}"]) if pairs[f"n{c}"] and pairs[f"all{c}"] else DISCOUNT for c in (0, 1)]
    every = float(total[0] + total[1] + total[2] + 1)  # one more for all unknown words
    forms = np.array(stems.agg(*kinds).first()[:2], dtype=float)
    totals = Totals(np.array(total[:2], dtype=float), np.array(total[3:5], dtype=float), forms, every, (d_pair, _discounts(words), _discounts(stems)))
    empty = [F.lit(0).cast("bigint").alias(c) for c in _STATS[3:]]
    known = stats.where(f"kind = {WORD}").unionByName(stems.select(F.lit(STEM_OF).alias("kind"), F.col("stem").alias("key"), "n0", "n1", "all0", *empty))
    known = materialise(known)
    rated = [_rate_portion(totals, texts.where(here), own.where(here), known) for here in _portions(texts)]
    return reduce(DataFrame.unionByName, rated)


def _portions(texts: DataFrame) -> list[Column]:
    """Ranges of chunks; those of a range are neighbours in the table, of which the other parts are not read."""
    chunks = sorted(r[0] for r in texts.select("chunk").distinct().collect())
    parts = np.array_split(chunks, max(1, min(PORTIONS, len(chunks) // PORTION_CHUNKS)))
    return [F.col("chunk").between(int(part[0]), int(part[-1])) for part in parts]


def _rate_portion(totals: Totals, texts: DataFrame, own: DataFrame, known: DataFrame) -> DataFrame:
    """own: chunk, and keys and counts (pair0, pair1) of pairs that other chunks add to; known: stats of words and stems."""
    answers = texts.select("chunk", "text").mapInArrow(_ask, "chunk bigint, kind int, key bigint").join(known, ["kind", "key"])
    lists = {"keys": "array<bigint>", "pair0": "array<int>", "pair1": "array<int>"}
    rows = texts.withColumns({"pairs": F.lit(False), **{c: F.array().cast(t) for c, t in lists.items()}})
    rows = rows.unionByName(own.withColumn("pairs", F.lit(True)), allowMissingColumns=True)
    both = rows.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    rated = both.applyInArrow(lambda x, y: _rate_chunk(totals, x, y), "key bigint, toxic int, n_words bigint, difference double, own double")
    return materialise(rated)


def _by_key(rated: DataFrame) -> DataFrame:
    """Texts that are equal have one key and one difference."""
    return materialise(rated.groupBy(F.col("key").alias("_key")).agg(F.max("n_words").alias("_n_words"), F.max("difference").alias("difference")))


def _train_large(docs: DataFrame, marked: DataFrame, size: int) -> Model:
    with _lean(docs.sparkSession):
        texts = _chunks(marked)
        rated = _rate(texts, size)
        if rated is None:
            return Model()
        model = Model(large=Large(docs, texts, size, _by_key(rated)))
        model.middle, model.width = _middle_of_all(rated.where(F.col("toxic").isNotNull()))
    return model


def _middle_of_all(rated: DataFrame) -> tuple[float, float]:
    """As _best_middle, and the way from there to the median of ordinary texts below, of any number of texts."""
    values = rated.groupBy("own").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o"))
    values = running_totals(running_totals(values, ["own"], "t", "t_before", "t_all"), ["own"], "o", "o_before", "o_all")
    hits = (1 - (F.col("t_before") + F.col("t")) / F.greatest("t_all", F.lit(1))) + (F.col("o_before") + F.col("o")) / F.greatest("o_all", F.lit(1))
    values = materialise(values.withColumn("_hits", hits))
    last = values.agg(F.max("own")).first()[0]
    best = values.where(F.col("own") < last).orderBy(F.desc("_hits"), "own").first()
    if best is None:
        middle = last + 1e-9
    else:
        middle = (best["own"] + values.where(F.col("own") > best["own"]).agg(F.min("own")).first()[0]) / 2
    below = values.where(F.col("own") < middle)
    n = below.agg(F.sum("o")).first()[0]
    if not n:
        return middle, 1.0
    halves = [below.where((F.col("o_before") <= r) & (F.col("o_before") + F.col("o") > r)).first()["own"] for r in ((n - 1) // 2, n // 2)]
    return middle, max(middle - sum(halves) / 2, 1e-9)


def _best_middle(toxic: np.ndarray, differences: np.ndarray) -> float:
    """The threshold with the best mean of both classes' hit rates, half way between the neighbouring texts."""
    order = np.argsort(differences, kind="stable")
    toxic, differences = toxic[order] == 1, differences[order]
    caught = 1 - np.cumsum(toxic) / max(1, toxic.sum())
    spared = np.cumsum(~toxic) / max(1, (~toxic).sum())
    cut = np.flatnonzero(np.diff(differences) > 0)
    if not len(cut):
        return float(differences[-1]) + 1e-9 if len(differences) else 0.0
    best = cut[np.argmax((caught + spared)[cut])]
    return float(differences[best] + differences[best + 1]) / 2


def scores(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, difference (of the log-likelihoods, length-normalised) and score (0 to 1) of every row."""
    if model.large:
        steps = F.greatest(F.least(STEEPNESS * (F.col("difference") - model.middle) / model.width, F.lit(700.0)), F.lit(-700.0))
        steps = F.when(F.col("_n_words") > 0, steps).otherwise(F.lit(-STEEPNESS))
        asked = docs.select(*keep, F.xxhash64("text").alias("_key"))
        found = lookup_join(asked, model.large.of(docs), ["_key"], salt_on=["_key", *keep])
        return found.select(*keep, "difference", (1 / (1 + F.exp(-steps))).alias("score"))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", difference double, score double"
    shared = model.shared or docs.sparkSession.sparkContext.broadcast((model, None))
    middle, width = model.middle, model.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _ = shared.value
        for batch in slices(batches):
            differences, counts = model.differences(*text_bytes(batch.column("text")))
            steps = np.where(counts > 0, np.clip(STEEPNESS * (differences - middle) / width, -700, 700), -STEEPNESS)
            arrays = [*(batch.column(c) for c in keep), pa.array(differences), pa.array(1 / (1 + np.exp(-steps)))]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "difference", "score"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)
