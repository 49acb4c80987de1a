"""Cross-entropy difference of a target and a background n-gram model.

Both models count words and pairs of words by their 64-bit hashes, in tables: the background counts all documents, the
target all chosen documents. The models are matched: background counts are scaled to the number of words of the target,
so that both are smoothed by the same amount. A word costs -log p(word | word before), where
p(w | h) = (n(h, w) + WEIGHT * p(w)) / (n(h) + WEIGHT), n(h) is the number of words after h (0 is the text's start), and
p(w) = (n(w) + 1) / (words + vocabulary), with one vocabulary for both, so that no word is unknown to one model only.
A document's score is the mean over its words of background cost minus target cost: higher means more like the target.

Texts are taken together in chunks of about GATHERED words. A chunk's different pairs, with the places of their texts in
it, are dealt into buckets by the hash of their word; in a bucket the chunks' pairs meet, are counted, and what each pair
adds is summed up for every text of every chunk, so that a pair moves once for each chunk, to be counted and scored, and
one number for each text and bucket moves back. Words that each make up more than a share of 1 / 2**HOT_BITS of all are
known to every task, and their pairs are dealt by the hash of the pair. Sums are of whole numbers, so that scores depend
on no order. Texts without words score 0; without target or background words every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evolens.llm.words import ALNUM, combine, previous, slices, text_bytes, word_hashes
from evolens.operators.joins import lookup_join
from evolens.session import materialise

WEIGHT = 20.0
HOT_BITS = 16  # 40 bytes for each hot word
MOST_BROADCAST = 200_000  # ids of target documents
GATHERED = 1 << 21  # words of a chunk
BUCKET_WORDS = 1 << 20  # words of all chunks that meet in a bucket
CHUNK_TEXTS = 32_000
PORTIONS = 16  # of a chunk, sorted one after the other
STRETCH = 1 << 18  # words looked up at once
UNIT = 2.0**-32  # of what a pair adds to a score
COUNTED, WANTED, SCORED = 1, 2, 4  # what a text is for

_LISTS = {"words": "bigint", "pairs_of": "int", "befores": "bigint", "texts_of": "int", "texts": "smallint", "times": "int"}
_COLD = {"cold": "bigint", "cold_texts_of": "int", "cold_texts": "smallint", "cold_times": "int"}
_OF_TEXTS = {"roles": "tinyint", "keys": "bigint", "n_words": "bigint", "sums": "bigint"}
_ROW = "bucket bigint, chunk bigint, " + ", ".join(f"{c} array<{t}>" for c, t in {**_LISTS, **_COLD, **_OF_TEXTS}.items())
_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}


@dataclass
class Models:
    """The counted texts, what all their words sum up to, and the hot words with their counts (n0, n1, then as word before)."""

    ready: bool
    counted: DataFrame | None
    marked: DataFrame | None = None
    scale: float = 1.0
    mass: float = 1.0
    n_words: int = 0
    hot: np.ndarray | None = None
    hot_counts: np.ndarray | None = None

    def shares(self, n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """p(w) of words in target and background."""
        return (n0 + 1) / self.mass, (n1 * self.scale + 1) / self.mass

    def of_pairs(self, n0: np.ndarray, n1: np.ndarray, of_word: np.ndarray) -> np.ndarray:
        """What pairs add by themselves, in UNITs, from their counts and those of the word."""
        share0, share1 = self.shares(of_word[:, 0], of_word[:, 1])
        return np.rint((np.log(n0 + WEIGHT * share0) - np.log(n1 * self.scale + WEIGHT * share1)) / UNIT).astype(np.int64)

    def of_befores(self, n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
        """What the word before adds, from its counts as such."""
        return -np.rint((np.log(n0 + WEIGHT) - np.log(n1 * self.scale + WEIGHT)) / UNIT).astype(np.int64)

    def find_hot(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are hot, and their places."""
        if not len(self.hot):
            return np.zeros(len(words), dtype=bool), np.zeros(len(words), dtype=np.int64)
        at = np.searchsorted(self.hot, words)
        at[at == len(self.hot)] = 0
        return self.hot[at] == words, at


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each word and of the word before (0 at the text's start); words per text."""
    words, counts = word_hashes(*text_bytes(batch.column("text")), ALNUM)
    return words, previous(words, counts, 1), counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        words, before, counts = _words(batch)
        wanted = np.repeat(np.asarray(batch.column("wanted").to_pylist(), dtype=bool), counts)
        found, place = np.unique(np.concatenate((words, before)), return_inverse=True)
        sides = [place[: len(words)], place[len(words) :]]
        n = [np.bincount(x, minlength=len(found)) for side in sides for x in (side[wanted], side)]
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), *map(pa.array, n)], ["word", "n0", "n1", "b0", "b1"])


def train(docs: DataFrame, target: DataFrame) -> Models:
    """docs: doc_id and text of the whole corpus; target: doc_id of the target texts."""
    wanted = materialise(target.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()).withColumn("wanted", F.lit(True))
    marked = lookup_join(docs.select("doc_id", "text"), wanted, ["doc_id"], "left", max_rows=MOST_BROADCAST)
    marked = marked.select("text", F.coalesce("wanted", F.lit(False)).alias("wanted"))
    sums = [F.sum(c).alias(c) for c in ("n0", "n1", "b0", "b1")]
    words = materialise(marked.mapInArrow(_count, "word bigint, n0 bigint, n1 bigint, b0 bigint, b1 bigint").groupBy("word").agg(*sums))
    n0, n1, vocabulary = words.agg(F.sum("n0"), F.sum("n1"), F.count_if(F.col("n1") > 0)).first()
    if not n0 or not n1:
        return Models(False, docs)
    hot = words.where(F.greatest("n1", "b1") > (n1 >> HOT_BITS)).toArrow()
    names = hot.column("word").to_numpy().view(np.uint64)
    order = np.argsort(names)
    counts = np.stack([hot.column(c).to_numpy()[order] for c in ("n0", "n1", "b0", "b1")], axis=1)
    return Models(True, docs, marked, n0 / n1, float(n0 + vocabulary), n1, names[order], counts)


def _row(bucket: int, chunk: int, lists: dict[str, np.ndarray]) -> pa.RecordBatch:
    columns = [pa.array([x], pa.int64()) for x in (bucket, chunk)]
    for name, kind in {**_LISTS, **_COLD, **_OF_TEXTS}.items():
        values = pa.array(lists.get(name, np.empty(0, np.int64)).astype(_TYPES[kind].to_pandas_dtype()))
        columns.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
    return pa.RecordBatch.from_arrays(columns, ["bucket", "chunk", *_LISTS, *_COLD, *_OF_TEXTS])


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins, and the end."""
    n = len(sorted_keys[0])
    if not n:
        return np.zeros(1, dtype=np.int64)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)


def _sorted(bucket: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Order by bucket, then keys from first to last, then as given."""
    order = np.arange(len(bucket))
    for k in (*keys[::-1], bucket.astype(np.uint32)):
        order = order[np.argsort(k[order], kind="stable")]
    return order


def _dealt(models: Models, buckets: int, number: int, parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """A chunk's rows: one of its texts, and one for each bucket. Empties `parts`."""
    words, before, counts, keys, roles = (np.concatenate(x) for x in zip(*parts))
    parts.clear()
    text = np.repeat(np.arange(len(counts), dtype=np.int16), counts)
    with np.errstate(over="ignore"):
        content = int(combine(keys.view(np.uint64), np.arange(len(keys), dtype=np.uint64)).sum())
    chunk = int(combine(*(np.array([x], np.uint64) for x in (TaskContext.get().partitionId(), number, content))).view(np.int64)[0])
    scored = (roles & SCORED) > 0
    bucket, cold_bucket, sums = _buckets(models, buckets, words, before, text, len(counts))
    yield _row(-1 - chunk % buckets, chunk, {"keys": keys[scored], "n_words": counts[scored], "sums": sums[scored]})
    step = -(-buckets // PORTIONS)
    for low in range(0, buckets, step):
        high = min(low + step, buckets)
        inside, cold_inside = (np.flatnonzero((x >= low) & (x < high)) for x in (bucket, cold_bucket))
        yield from _portion(chunk, roles, words, before, text, inside, cold_inside, bucket, cold_bucket)


def _buckets(
    models: Models, buckets: int, words: np.ndarray, before: np.ndarray, text: np.ndarray, texts: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair, its bucket and that of the word before (none, the one past the last, if hot); what hot ones add to each text."""
    kind, size = np.min_scalar_type(buckets), np.uint64(buckets)
    sums = np.zeros(texts, dtype=np.int64)
    bucket, cold_bucket = (np.empty(len(words), dtype=kind) for _ in range(2))
    adds = models.of_befores(*models.hot_counts[:, 2:].T)
    for low in range(0, len(words), STRETCH):
        some = slice(low, low + STRETCH)
        known, at = models.find_hot(before[some])
        np.add.at(sums, text[some][known], adds[at[known]])
        cold_bucket[some] = np.where(known, size, before[some] % size)
        hot = models.find_hot(words[some])[0]
        bucket[some] = np.where(hot, combine(before[some], words[some]), words[some]) % size
    return bucket, cold_bucket, sums


def _portion(
    chunk: int, roles: np.ndarray, words: np.ndarray, before: np.ndarray, text: np.ndarray,
    inside: np.ndarray, cold_inside: np.ndarray, bucket: np.ndarray, cold_bucket: np.ndarray,
) -> Iterator[pa.RecordBatch]:
    """The rows of some buckets. inside: the pairs in these buckets; cold_inside: those whose word before is."""
    order = inside[_sorted(bucket[inside], words[inside], before[inside])]
    bucket_of, w, b, t = bucket[order], words[order], before[order], text[order]
    entries = _starts(bucket_of, w, b, t)
    times, e = np.diff(entries), entries[:-1]
    pairs = _starts(bucket_of[e], w[e], b[e])
    p = e[pairs[:-1]]
    runs = _starts(bucket_of[p], w[p])
    order = cold_inside[_sorted(cold_bucket[cold_inside], before[cold_inside])]
    cb, c, ct = cold_bucket[order], before[order], text[order]
    cold_entries = _starts(cb, c, ct)
    ce = cold_entries[:-1]
    cold = _starts(cb[ce], c[ce])
    cold_at = ce[cold[:-1]]
    of_entry, of_cold = (x.astype(np.int64) for x in (bucket_of[e], cb[ce]))
    for k in np.unique(np.concatenate((of_entry, of_cold))):
        low, high = np.searchsorted(of_entry, [k, k + 1])
        first, last = np.searchsorted(pairs, [low, high])
        run, end = np.searchsorted(runs, [first, last])
        clow, chigh = np.searchsorted(of_cold, [k, k + 1])
        cfirst, clast = np.searchsorted(cold, [clow, chigh])
        yield _row(int(k), chunk, {
            "words": w[p[runs[run:end]]].view(np.int64), "pairs_of": np.diff(runs[run : end + 1]),
            "befores": b[p[first:last]].view(np.int64), "texts_of": np.diff(pairs[first : last + 1]),
            "texts": t[e[low:high]], "times": times[low:high],
            "cold": c[cold_at[cfirst:clast]].view(np.int64), "cold_texts_of": np.diff(cold[cfirst : clast + 1]),
            "cold_texts": ct[ce[clow:chigh]], "cold_times": np.diff(cold_entries)[clow:chigh], "roles": roles,
        })


def _added(place: np.ndarray, size: int, values: np.ndarray) -> np.ndarray:
    return np.bincount(place, weights=values, minlength=size)


def _summed(models: Models, rows: pa.Table) -> pa.Table:
    """What a bucket adds to the scored texts of each chunk; rows of a chunk's texts pass through."""
    parts = {c: [x.values.to_numpy(zero_copy_only=False) for x in rows.column(c)] for c in {**_LISTS, **_COLD, **_OF_TEXTS}}
    if rows.column("bucket")[0].as_py() < 0:
        return rows.select(["chunk", "keys", "n_words", "sums"])
    totals = [np.zeros(len(r), dtype=np.int64) for r in parts["roles"]]
    base = np.cumsum([0, *map(len, totals)])
    every = np.concatenate(totals)
    roles = np.concatenate(parts["roles"])

    def joined(name: str) -> np.ndarray:
        return np.concatenate(parts[name])

    def counted(name: str, of: str, times: str) -> tuple[np.ndarray, ...]:
        """Of each entry: its key's place, text and times; of each key: n0 and n1."""
        place = np.repeat(np.arange(len(joined(of))), joined(of))
        text = np.concatenate([x + np.int64(o) for x, o in zip(parts[name], base)])
        n = joined(times).astype(np.int64)
        size = len(joined(of))
        return place, text, n, _added(place, size, n * ((roles[text] & WANTED) > 0)), _added(place, size, n * ((roles[text] & COUNTED) > 0))

    place, text, n, n0, n1 = counted("texts", "texts_of", "times")
    if len(place):
        word = np.repeat(joined("words"), joined("pairs_of")).view(np.uint64)
        _, first, pair = np.unique(combine(joined("befores").view(np.uint64), word), return_index=True, return_inverse=True)
        names, of = np.unique(word, return_inverse=True)
        known, at = models.find_hot(names)
        of_word = np.stack([_added(of, len(names), x) for x in (n0, n1)], axis=1)
        of_word[known] = models.hot_counts[at[known], :2]
        delta = models.of_pairs(*(_added(pair, len(first), x) for x in (n0, n1)), of_word[of[first]])
        np.add.at(every, text, delta[pair][place] * n)
    place, text, n, n0, n1 = counted("cold_texts", "cold_texts_of", "cold_times")
    if len(place):
        names, of = np.unique(joined("cold"), return_inverse=True)
        delta = models.of_befores(*(_added(of, len(names), x) for x in (n0, n1)))
        np.add.at(every, text, delta[of][place] * n)
    sums = [every[a:b][(r & SCORED) > 0] for a, b, r in zip(base, base[1:], parts["roles"])]
    empty = pa.array([[]] * len(sums), pa.list_(pa.int64()))
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sums)]), pa.int32()), pa.array(np.concatenate(sums)))
    return pa.table([rows.column("chunk").combine_chunks(), empty, empty, lists], ["chunk", "keys", "n_words", "sums"])


def _by_text(rows: pa.Table) -> pa.Table:
    """A chunk's texts with the sums of all buckets."""
    sums = sum(x.values.to_numpy() for x in rows.column("sums"))
    keys, n_words = (max((x.values.to_numpy() for x in rows.column(c)), key=len) for c in ("keys", "n_words"))
    return pa.table([pa.array(x) for x in (keys, n_words, sums)], ["key", "n_words", "sum"])


def cross_entropy_difference(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, n_words and score of every row; repeated rows are scored each."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    if not models.ready:

        def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_words(batch)[2])], ["doc_id", "n_words"])

        return docs.select("doc_id", "text").mapInArrow(lengths, f"doc_id {kind}, n_words bigint").withColumn("score", F.lit(0.0))
    own = models.counted is docs
    lean = Models(True, None, None, models.scale, models.mass, models.n_words, models.hot, models.hot_counts)
    shared = docs.sparkSession.sparkContext.broadcast(lean)
    key = F.xxhash64("text").alias("key")
    role = F.lit(COUNTED) + F.col("wanted").cast("int") * WANTED + (SCORED if own else 0)
    texts = models.marked.select("text", key, role.alias("role"))
    n_words = models.n_words
    if not own:
        texts = texts.unionByName(docs.select("text", key, F.lit(SCORED).alias("role")))
        n_words += (docs.agg(F.sum(F.length("text"))).first()[0] or 0) // 4
    buckets = 1 + n_words // BUCKET_WORDS

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        size = number = rows = 0
        for batch in slices(batches):
            for low in range(0, batch.num_rows, CHUNK_TEXTS):
                some = batch.slice(low, CHUNK_TEXTS)
                if parts and (size >= GATHERED or rows + some.num_rows > CHUNK_TEXTS):
                    yield from _dealt(shared.value, buckets, number, parts)
                    size, number, rows, parts = 0, number + 1, 0, []
                parts.append((*_words(some), some.column("key").to_numpy(), some.column("role").to_numpy().astype(np.int8)))
                size, rows = size + len(parts[-1][0]), rows + some.num_rows
        if parts:
            yield from _dealt(shared.value, buckets, number, parts)

    dealt = texts.mapInArrow(deal, _ROW).groupBy("bucket")
    summed = dealt.applyInArrow(lambda rows: _summed(shared.value, rows), "chunk bigint, keys array<bigint>, n_words array<bigint>, sums array<bigint>")
    found = summed.groupBy("chunk").applyInArrow(_by_text, "key bigint, n_words bigint, sum bigint")
    # texts that are equal have one key and one sum
    found = materialise(found.groupBy("key").agg(F.max("n_words").alias("n_words"), F.max("sum").alias("sum")))
    score = F.col("sum") * UNIT / F.greatest("n_words", F.lit(1))
    return lookup_join(docs.select("doc_id", key), found, ["key"], salt_on=["doc_id"]).select("doc_id", "n_words", score.alias("score"))
