"""Similarity join of texts by the Jaccard index of their word shingles, with prefixes under several token orders.

A text's set is its distinct shingles of `words` words (the whole sequence, if shorter), held as 64-bit hashes. Two sets
with an index of at least `percent` per cent must share a token among the first size - ceil(percent * size) + 1 of each,
whatever the order of tokens, as long as it is the same for all sets. The steps:

1. Texts with equal sets are one class; from here on there is one set for each class.
2. First order: rare before frequent. Tokens found in more than HEAVY texts come last (by number of texts), all others by
   hash. Of the tokens whose hashes come first, somewhat more than prefixes are made of, all are counted; of the others
   those that some slice of a task's texts holds more than once, so that passages which many texts share come last
   wherever they hash, and the rest counts as rare. A bit filter of the tokens counted more than once goes to every task, so that tokens of one text alone are not
   shuffled again; where it is too small for the table, it lets more of them through. Prefixes are longer than needed,
   so that more than one token must be shared; a class with fewer shared prefix tokens has no partner and is done.
3. Under further orders, by other hashes of the shared prefix tokens, classes meet that have the same first. A class is
   compared with others until it is linked. That turns a group of thousands of near copies into one component with a few
   comparisons for each member, instead of all its pairs. Rounds go on until one finds few links, ROUNDS at most; they
   save work but decide nothing.
4. All pairs that share enough prefix tokens under the first order and are still in different components, and whose
   sizes, parities (of the number of tokens in each of PARITIES buckets: two sets differ in at least as many tokens as
   parities) and the tokens' places allow it, are compared by a sketch (token counts by bucket, which bound the overlap from
   above), must also share prefix tokens under two further orders, and are then compared exactly. So every link
   between different components is found, and components are exact.

Hashes make two different shingles equal with a chance of about 2**-64 for each pair. Texts that are null or have no
words have an empty set and are linked with nothing; the rows of an id that occurs more than once are separate texts.
Broadcast are only the heavy tokens, MOST_HEAVY at most (the bound on texts is raised until they fit).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evolens.llm.components import components
from evolens.llm.words import SPACED, _mix, combine, slices, text_bytes, word_hashes
from evolens.session import materialise

HEAVY = 1
MOST_HEAVY = 1 << 20
FILTER_BITS = 8  # of the filter, for each token in it
MOST_WORDS = 23  # the filter has at most 2 ** 23 words of 64 bits (64 MB)
MARKS = (23, 29, 35)  # a token marks the bits of its word that are named by its own six bits from these places
MOST_BROADCAST = 1_000_000  # ids
COUNTED = 1.55  # times the share of a set that a prefix takes: so much of the tokens, by hash, is counted
FURTHER_COMMON = 20  # a prefix is longer by a token for each so many tokens, and as many more tokens must be shared
PARITIES = 512
ROUNDS = 3
GROUP = 500
TRIES = 48
FURTHER_ORDERS = (1, 2)


def shingle_sets(batch: pa.RecordBatch, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text of the batch."""
    hashes, counts = word_hashes(*text_bytes(batch.column("text")), SPACED)
    runs = combine(*(hashes[k : len(hashes) - words + 1 + k] for k in range(words))) if len(hashes) >= words else hashes[:0]
    sets, at = [], 0
    for n in counts.tolist():
        if n >= words:
            sets.append(np.unique(runs[at : at + n - words + 1]))
        else:
            sets.append(combine(*(hashes[at + k : at + k + 1] for k in range(n))) if n else hashes[:0])
        at += n
    return sets


def class_of(tokens: np.ndarray) -> int:
    """A 64-bit name of a set."""
    with np.errstate(over="ignore"):
        mixed = np.array([_mix(tokens).sum(dtype=np.uint64), np.uint64(len(tokens))], dtype=np.uint64)
        return int(combine(mixed[:1], mixed[1:]).view(np.int64)[0])


def _ordered(tokens: np.ndarray, order: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(tokens + np.uint64(order) * np.uint64(0x9E3779B97F4A7C15)) if order else tokens


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def counted_below(percent: int) -> int:
    """The hash below which tokens are counted; those come first under the order by hash."""
    return min((1 << 64) - 1, int((1 << 64) * COUNTED * (100 - percent) / 100))


def first_prefix(tokens: np.ndarray, percent: int, heavy: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Prefix tokens under the order that puts heavy tokens last, longer by size // FURTHER_COMMON."""
    length = prefix_length(len(tokens), percent) + len(tokens) // FURTHER_COMMON
    weight = np.zeros(len(tokens), dtype=np.int64)
    if len(heavy):
        at = np.searchsorted(heavy, tokens)
        at[at == len(heavy)] = 0
        weight = np.where(heavy[at] == tokens, texts[at], 0)
    return tokens[np.lexsort((tokens, weight))[:length]]


def further_prefix(tokens: np.ndarray, percent: int, order: int) -> np.ndarray:
    return np.sort(_ordered(tokens, order))[: prefix_length(len(tokens), percent)]


def filter_marks(tokens: np.ndarray) -> np.ndarray:
    marks = np.zeros(len(tokens), dtype=np.uint64)
    for place in MARKS:
        marks |= np.uint64(1) << ((tokens >> np.uint64(place)) & np.uint64(63))
    return marks


def may_repeat(tokens: np.ndarray, words: np.ndarray) -> np.ndarray:
    """False for tokens that are surely not in the filter."""
    marks = filter_marks(tokens)
    return words[tokens & np.uint64(len(words) - 1)] & marks == marks


def sketch(tokens: np.ndarray) -> bytes:
    """How many tokens fall into each of about half as many buckets, in the narrowest numbers; first byte: their width."""
    bits = min(12, max(4, int(len(tokens) / 2).bit_length()))
    counts = np.bincount((tokens >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    width = 1 if counts.max() < 1 << 8 else 2 if counts.max() < 1 << 16 else 4
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def sketch_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{data[0]}", offset=1).astype(np.int64)


def parities(tokens: np.ndarray) -> np.ndarray:
    """Whether the number of tokens in each of PARITIES buckets is odd, as 64-bit words."""
    bucket = (tokens >> np.uint64(64 - (PARITIES - 1).bit_length())).astype(np.int64)
    return np.packbits(np.bincount(bucket, minlength=PARITIES).astype(np.uint8) & 1).view(np.int64)


_PARITY = [f"parity_{i}" for i in range(PARITIES // 64)]


def can_link(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """False if the sketches show that the sets cannot be linked: no bucket shares more than its smaller count."""
    total = int(a.sum()) + int(b.sum())
    size = min(len(a), len(b))
    most = int(np.minimum(a.reshape(size, -1).sum(1), b.reshape(size, -1).sum(1)).sum())
    return 100 * most >= percent * (total - most)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    least, most = sorted((len(a), len(b)))
    if not least or 100 * least < percent * most:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _classes(docs: DataFrame, words: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch, words)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) for s in sets], pa.int64())],
                ["doc_id", "n_shingles", "class"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles bigint, class bigint")


def _repeated(heavy: DataFrame, n: int) -> np.ndarray:
    """The filter of all tokens of the table."""
    size = 1 << min(MOST_WORDS, max(10, (n * FILTER_BITS // 64).bit_length()))
    marks = "|".join(f"shiftleft(1L, cast(shiftrightunsigned(token, {place}) & 63 as int))" for place in MARKS)
    rows = heavy.groupBy(F.col("token").bitwiseAND(F.lit(size - 1)).alias("word")).agg(F.bit_or(F.expr(marks)).alias("marks")).toArrow()
    found = np.zeros(size, dtype=np.uint64)
    found[rows.column("word").to_numpy()] = rows.column("marks").to_numpy().view(np.uint64)
    return found


def _heavy_tokens(docs: DataFrame, words: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent of the counted tokens with their numbers of texts, and the filter of all below that repeat."""
    below = counted_below(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch, words)
            token, n = np.unique(np.concatenate(sets) if sets else np.empty(0, np.uint64), return_counts=True)
            sent = (token < np.uint64(below)) | (n > 1)
            token, n = token[sent], n[sent]
            yield pa.RecordBatch.from_arrays([_longs(token), pa.array(n.astype(np.int64))], ["token", "n"])

    counted = docs.select("text").mapInArrow(run, "token bigint, n bigint")
    heavy = materialise(counted.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > HEAVY))
    bound, repeated = HEAVY, heavy.count()
    # unsigned order: as signed numbers, those from 2 ** 63 are the negative ones
    low = heavy.where((F.col("token") >= 0) & (F.col("token") < below) if below < 1 << 63 else (F.col("token") >= 0) | (F.col("token") < below - (1 << 64)))
    filtered, n = _repeated(low, low.count()), repeated
    while n > MOST_HEAVY:
        bound *= 2
        n = heavy.where(F.col("n") > bound).count()
    rows = heavy.where(F.col("n") > bound).toArrow()
    if not rows.num_rows:
        return np.empty(0, np.uint64), np.empty(0, np.int64), filtered
    tokens = rows.column("token").to_numpy().view(np.uint64)
    by = np.argsort(tokens)
    return tokens[by], rows.column("n").to_numpy()[by], filtered


def _postings(docs: DataFrame, words: int, percent: int, heavy: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """Prefix tokens of every text that another text may have too."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)
    below = np.uint64(counted_below(percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = {class_of(s): s for s in shingle_sets(batch, words) if len(s)}
            *heaviest, repeated = shared.value
            prefixes = [first_prefix(s, percent, *heaviest) for s in sets.values()]
            if prefixes:
                at = [np.flatnonzero((p >= below) | may_repeat(p, repeated)) for p in prefixes]
                prefixes = [p[kept] for p, kept in zip(prefixes, at)]
                lengths = [len(p) for p in prefixes]
                names = np.repeat(np.array(list(sets), dtype=np.int64), lengths)
                sizes = np.repeat(np.array([len(s) for s in sets.values()], dtype=np.int32), lengths)
                places = np.concatenate(at).astype(np.int32)
                arrays = [_longs(np.concatenate(prefixes)), pa.array(names), pa.array(sizes), pa.array(places)]
                yield pa.RecordBatch.from_arrays(arrays, ["token", "class", "n", "place"])

    return docs.select("text").mapInArrow(run, "token bigint, class bigint, n int, place int")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """class, tokens, sketch and parities of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch, words)
            arrays = [pa.array([class_of(s) for s in sets], pa.int64())]
            arrays += [pa.array([f(s) for s in sets], pa.binary()) for f in (np.ndarray.tobytes, sketch)]
            odd = np.array([parities(s) for s in sets], dtype=np.int64).reshape(len(sets), -1)
            arrays += [pa.array(odd[:, i]) for i in range(len(_PARITY))]
            yield pa.RecordBatch.from_arrays(arrays, ["class", "tokens", "sketch", *_PARITY])

    return docs.select("text").mapInArrow(run, "class bigint, tokens binary, sketch binary, " + ", ".join(f"{c} bigint" for c in _PARITY))


def _with_component(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is None:
        return rows.withColumn("component", F.col("class"))
    named = found.withColumnRenamed("component", "_c")
    return rows.join(named, rows["class"] == named["node"], "left").withColumn("component", F.coalesce("_c", "class")).drop("node", "_c")


def _round(shared: DataFrame, sets: DataFrame, found: DataFrame | None, order: int, percent: int) -> DataFrame:
    """Links (a, b) found inside groups of classes whose first shared token, under this order, is the same.

    A group is dealt to parts of about GROUP classes. In a part, each class is compared with at most TRIES classes of
    every other component until one is linked; those with most shared tokens, which are nearest to the middle, come first.
    """
    first = F.min_by("token", F.xxhash64(F.lit(order), "token"))
    keyed = _with_component(shared.groupBy("class").agg(first.alias("key"), F.count("*").alias("common")), found)
    groups = keyed.groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high"), F.count("*").alias("_n"))
    groups = groups.where("_low <> _high").select("key", F.ceil(F.col("_n") / GROUP).alias("parts"))
    members = keyed.join(groups, "key").withColumn("part", F.pmod(F.xxhash64(F.lit(order), "class"), "parts"))
    rows = members.select("key", "part", "common", "class", "component").join(sets.select("class", "tokens"), "class")
    rows = rows.repartition("key", "part").sortWithinPartitions("key", "part", F.desc("common"), "class")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        root: dict[int, int] = {}
        held: dict[int, list[tuple[int, np.ndarray]]] = {}
        for batch in batches:
            a, b = [], []
            names = ("key", "part", "class", "component")
            for i, (key, part, name, component) in enumerate(zip(*(batch.column(c).to_pylist() for c in names))):
                if (key, part) != at:
                    at, root, held = (key, part), {}, {}
                mine = np.frombuffer(batch.column("tokens")[i].as_py(), dtype=np.uint64)
                own = component
                while own in root:
                    own = root[own]
                for other in [x for x in held if x != own]:
                    near = next((n for n, theirs in held[other][:TRIES] if linked(mine, theirs, percent)), None)
                    if near is not None:
                        a.append(name)
                        b.append(near)
                        low, high = (own, other) if len(held.get(own, ())) < len(held[other]) else (other, own)
                        root[low] = high
                        held[high] = held.get(high, []) + held.pop(low, [])
                        own = high
                held.setdefault(own, []).append((name, mine))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.select("key", "part", "class", "component", "tokens").mapInArrow(compare, "a bigint, b bigint")


def _remaining(shared: DataFrame, sets: DataFrame, found: DataFrame | None, percent: int) -> DataFrame:
    """Links between classes of different components that share a prefix token under the first order."""
    sized = _with_component(shared, found)
    parts = sized.groupBy("token", "component").agg(F.count("*").alias("rows"))
    major = parts.groupBy("token").agg(F.max_by("component", F.struct("rows", "component")).alias("major"), F.count("*").alias("parts"))
    open_ = sized.join(major.where("parts > 1").drop("parts"), "token")
    open_ = materialise(open_.join(sets.select("class", *_PARITY), "class"))
    minor = open_.where("component <> major").select("token", *(F.col(c).alias(f"{c}_a") for c in ("class", "component", "n", "place", *_PARITY)))
    # nothing before the first token they share is shared: the row of that token keeps every pair that can be linked
    most = F.least(F.col("n") - F.col("place"), F.col("n_a") - F.col("place_a")).cast("bigint")
    sizes = 100 * F.least("n", "n_a").cast("bigint") >= percent * F.greatest("n", "n_a").cast("bigint")
    different = F.col("component") != F.col("component_a")
    fits = 100 * most >= percent * (F.col("n") + F.col("n_a") - most)
    once = (F.col("component") == F.col("major")) | (F.col("class_a") < F.col("class"))
    # linked sets of n and m tokens have at least percent * (n + m) / (100 + percent) in common
    apart = reduce(add, (F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_a"))) for c in _PARITY))
    near = (100 + percent) * apart.cast("bigint") <= (100 - percent) * (F.col("n") + F.col("n_a")).cast("bigint")
    pairs = minor.join(open_, "token").where(different & sizes & once & near)
    pairs = pairs.groupBy(F.least("class", "class_a").alias("a"), F.greatest("class", "class_a").alias("b"))
    # each token that two classes share is one row here
    enough = 1 + F.floor(F.min(F.least("n", "n_a")) / FURTHER_COMMON)
    pairs = pairs.agg(F.count("*").alias("_common"), enough.alias("_enough"), F.max(fits).alias("_fits"))
    pairs = materialise(pairs.where("_fits and _common >= _enough").select("a", "b"))

    def beside(pairs: DataFrame, column: str) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
        held = sets.select("class", column).join(_sized(ids), "class", "left_semi")
        left = pairs.join(held.withColumnsRenamed({"class": "a", column: "left"}), "a")
        return left.join(held.withColumnsRenamed({"class": "b", column: "right"}), "b").select("a", "b", "left", "right")

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [[sketch_counts(x) for x in batch.column(c).to_pylist()] for c in ("left", "right")]
            keep = [can_link(x, y, percent) for x, y in zip(*sides)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = beside(materialise(beside(pairs, "sketch").mapInArrow(possible, "a bigint, b bigint")), "tokens")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens: dict[int, np.ndarray] = {}
            prefixes: dict[int, list[frozenset[int]]] = {}
            for side in ("a", "b"):
                data = batch.column("left" if side == "a" else "right")
                names, first = np.unique(batch.column(side).to_numpy(), return_index=True)
                for name, i in zip(names.tolist(), first.tolist()):
                    if name not in tokens:
                        tokens[name] = np.frombuffer(data[i].as_py(), dtype=np.uint64)
                        prefixes[name] = [frozenset(further_prefix(tokens[name], percent, r).tolist()) for r in FURTHER_ORDERS]
            keep = []
            for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                meets = not any(p.isdisjoint(q) for p, q in zip(prefixes[x], prefixes[y]))
                keep.append(meets and linked(tokens[x], tokens[y], percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(verify, "a bigint, b bigint")


def _sized(ids: DataFrame) -> DataFrame:
    """A table of ids, to be broadcast if it is counted to be small, else to be shuffled and hashed."""
    ids = materialise(ids)
    return F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids.hint("shuffle_hash")


def _linked_classes(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_shingles and class of every row; component of every class that is not empty."""
    named = materialise(_classes(docs, words))
    heavy = _heavy_tokens(docs, words, percent)
    postings = materialise(_postings(docs, words, percent, heavy))
    common = postings.groupBy("token").agg(F.min("class").alias("_low"), F.max("class").alias("_high")).where("_low <> _high").select("token")
    shared = postings.join(common, "token", "left_semi").distinct()
    # a partner has at least percent of the size, and shares as many prefix tokens as its and this prefix are longer by
    least = 1 + F.floor(F.ceil(F.max("n") * (percent / 100) - 1e-6) / FURTHER_COMMON)
    shared = materialise(shared)
    counted = shared.groupBy("class").agg(F.count("*").alias("_shared"), least.alias("_least"))
    shared = materialise(shared.join(_sized(counted.where("_shared >= _least").select("class")), "class", "left_semi"))
    owners = named.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("_owner"))
    owners = materialise(owners.join(shared.select("class").distinct(), "class", "left_semi"))
    owned = _sized(owners.where(F.col("_owner").isNotNull()).select("_owner"))
    texts = docs.select("doc_id", "text").join(owned, F.col("doc_id") == F.col("_owner"), "left_semi")
    # a class whose rows have no id at all is loaded by its name
    nameless = _sets(docs.where(F.col("doc_id").isNull()).select("doc_id", "text"), words)
    nameless = nameless.join(_sized(owners.where(F.col("_owner").isNull()).select("class")), "class", "left_semi").dropDuplicates(["class"])
    sets = _sets(texts, words)  # an id that occurs twice may bring a set that no join asks for
    sets = materialise(sets.unionByName(nameless))
    links, found, most = None, None, 0
    for order in range(1, ROUNDS + 1):
        new = materialise(_round(shared, sets, found, order, percent))
        n = new.count()
        most = max(most, n)
        if not n:
            break
        links = new if links is None else materialise(links.unionByName(new))
        found = materialise(components(links))
        if 10 * n < most:
            break
    new = materialise(_remaining(shared, sets, found, percent))
    if not new.isEmpty():
        links = new if links is None else links.unionByName(new)
        found = materialise(components(links))
    return named, _with_component(named.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("_least")), found)


def similarity_components(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; docs: doc_id, text, other columns play no part.

    component_id is the smallest doc_id that can be reached by links, the row's own included.
    """
    named, tied = _linked_classes(docs, words, percent)
    least = tied.groupBy("component").agg(F.min("_least").alias("component_id"))
    tied = tied.select("class", "component").join(least, "component").select("class", "component_id")
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return named.join(tied, "class", "left").select("doc_id", "n_shingles", alone.alias("component_id"))


def _with_class(docs: DataFrame, words: int, name: str) -> DataFrame:
    """docs with the class of each row, null for an empty set."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in docs.columns) + f", `{name}` bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            classes = pa.array([class_of(s) if len(s) else None for s in shingle_sets(batch, words)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, classes], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def keep_one_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component: that of the smallest (doc_id, class), rows without an id last.

    Rows are told apart by id and class, so another text of the same id is decided on its own. Of rows alike in both,
    one stays. Texts without words are linked with nothing: those with an id stay once for each id and text, others all.
    """
    named, tied = _linked_classes(docs, words, percent)
    rows = named.where("n_shingles > 0").groupBy("doc_id", "class").agg(F.count("*").alias("_n"))
    rows = materialise(rows.join(tied.select("class", "component"), "class"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "class")).alias("_first")
    rows = rows.join(rows.groupBy("component").agg(first), "component")
    stays = F.col("doc_id").eqNullSafe(F.col("_first.doc_id")) & (F.col("class") == F.col("_first.class"))
    rows = materialise(rows.select(F.col("doc_id").alias("_id"), F.col("class").alias("_class"), (F.col("_n") > 1).alias("_twice"), stays.alias("_stays")))
    mark = "_" * (1 + max(len(c) for c in docs.columns)) + "class"
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col(mark) == F.col("_class"))
    classed = _with_class(docs, words, mark)
    worded = classed.where(F.col(mark).isNotNull())
    kept = worded.join(_sized(rows.where("not _stays").select("_id", "_class")), same, "left_anti")
    twice = _sized(rows.where("_stays and _twice").select("_id", "_class"))
    once = kept.join(twice, same, "left_anti").select(*docs.columns)

    def one_of(rows: DataFrame, *key: str) -> DataFrame:
        row = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_row")
        return rows.groupBy(*key).agg(row).select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))

    empty = docs.join(_sized(named.where("n_shingles = 0 and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()), F.col("doc_id") == F.col("_id"), "left_semi")
    empty = _with_class(empty, words, mark).where(F.col(mark).isNull()).withColumn(mark + "_text", F.coalesce("text", F.lit("")))
    nameless = _with_class(docs.where(F.col("doc_id").isNull()), words, mark).where(F.col(mark).isNull()).select(*docs.columns)
    several = one_of(kept.join(twice, same, "left_semi"), "doc_id", mark)
    return once.unionByName(several).unionByName(one_of(empty, "doc_id", mark + "_text")).unionByName(nameless)
