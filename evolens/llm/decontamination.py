"""Benchmark passages in documents, by a prefix-filtered join.

Every benchmark item is cut into windows of `window` consecutive words (an item of fewer words is one window). A
document contains a window only if it has all of its words, so one word of each window, the rarest in the documents, is
all that the join needs: the necessary prefix of a containment of 1. Words are counted over all documents; a window with
a word that no document has is dropped. Where a document has a prefix word, the window must fit between the document's
begin and end at that place, and then its words are compared one by one.

DataFrame and SQL functions only. Each document's words are exploded inside the scan and meet the prefix words in a
broadcast join, so that neither words nor texts are shuffled. The broadcast is bounded: windows go in blocks of at most
about `block` rows, one pass over the documents each.

Null texts have no words. Items without words, and items that are null, are nowhere. The same text under the same id
twice gives the same row twice. Other columns of both tables play no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evolens.session import materialise

#: Letters, digits and whatever is not ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F] of lower-cased text.
WORD = r"[a-zA-Z0-9\x{80}-\x{10FFFF}]++"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = 200_000


def words_of(text: Column) -> Column:
    """The words as they are written; `_plain` lower-cases A-Z alone, which costs more and is done for few of them."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _plain(words: Column) -> Column:
    return F.translate(F.concat_ws(" ", words), _UPPER, _LOWER)


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, window): every window of every item, once for each item; words with A-Z in lower case."""
    words = items.where(F.col("item_id").isNotNull()).select("item_id", words_of(F.translate("text", _UPPER, _LOWER)).alias("words"))
    words = words.where(F.size("words") > 0)
    places = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    placed = words.select("item_id", F.explode(F.transform(places, lambda i: F.slice("words", i, F.lit(window)))).alias("window"))
    return placed.distinct()


def _rarest(docs: DataFrame, cut: DataFrame, block: int) -> DataFrame:
    """(window, word, offset): each window's rarest word and where it stands in it."""
    placed = cut.select("window").distinct().select("window", F.posexplode("window").alias("offset", "word"))
    placed = placed.withColumn("word", F.lower("word"))  # meets more words than A-Z in lower case would; compared later
    wanted = materialise(placed.select("word").distinct())
    parts = -(-wanted.count() // block)
    exploded = docs.select(F.explode(words_of(F.col("text"))).alias("word")).select(F.lower("word").alias("word"))
    counts = []
    for part in range(max(1, parts)):
        some = wanted.where(F.pmod(F.xxhash64("word"), F.lit(max(1, parts))) == part)
        counts.append(exploded.join(F.broadcast(some), "word", "left_semi").groupBy("word").count())
    counted = materialise(reduce(DataFrame.unionByName, counts))
    known = placed.join(counted, "word", "left").groupBy("window")
    least = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "word", "offset")).alias("_r")
    return known.agg(least).where("_r.count > 0").select("window", "_r.word", "_r.offset")


def occurrences(docs: DataFrame, items: DataFrame, window: int = 10, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_key, window, start): every occurrence of a window; start counts words from 0."""
    prefixes = materialise(_rarest(docs, windows(items, window), block))
    parts = max(1, -(-prefixes.count() // block))
    words = docs.select("doc_id", _text_key(F.col("text")).alias("text_key"), words_of(F.col("text")).alias("words"))
    exploded = words.select("doc_id", "text_key", "words", F.posexplode("words").alias("place", "word")).withColumn("word", F.lower("word"))
    found = []
    for part in range(parts):
        some = F.broadcast(prefixes.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == part))
        start = F.col("place") - F.col("offset")
        fits = (start >= 0) & (start + F.size("window") <= F.size("words"))
        same = F.when(fits, _plain(F.slice("words", start + 1, F.size("window"))) == F.concat_ws(" ", "window")).otherwise(False)
        found.append(exploded.join(some, "word").where(same).select("doc_id", "text_key", "window", start.alias("start")))
    return reduce(DataFrame.unionByName, found)


def _covered(intervals: Column) -> Column:
    """Length of the union of intervals, which are sorted structs of begin and end."""

    def add(so_far: Column, x: Column) -> Column:
        more = F.greatest(F.lit(0), x["end"] - F.greatest(x["begin"], so_far["upto"]))
        return F.struct((so_far["hit"] + more).alias("hit"), F.greatest(so_far["upto"], x["end"]).alias("upto"))

    return F.aggregate(intervals, F.struct(F.lit(0).alias("hit"), F.lit(0).alias("upto")), add, lambda so_far: so_far["hit"])


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (ids as sorted text, comma-joined) and contaminated of every document."""
    cut = windows(items, window)
    found = materialise(occurrences(docs, items, window, block))
    keys = ["doc_id", "text_key"]
    span = F.struct(F.col("start").alias("begin"), (F.col("start") + F.size("window")).alias("end"))
    hits = found.groupBy(*keys).agg(_covered(F.array_sort(F.collect_set(span))).cast("bigint").alias("n_hit"))
    of_items = found.select(*keys, "window").distinct().join(cut, "window").groupBy(*keys)
    listed = of_items.agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("_items"))
    hits = hits.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    hits = hits.join(listed, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("text_key"))).drop(*keys)
    rows = docs.select(
        "doc_id",
        _text_key(F.col("text")).alias("text_key"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint").alias("n_words"),
    )
    joined = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    items_found = F.coalesce("_items", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return joined.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size(items_found).cast("bigint").alias("n_items"),
        F.concat_ws(",", items_found).alias("items"),
        (hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, block: int = BLOCK) -> DataFrame:
    """The rows, with all their columns, that hold no window of an item."""
    found = materialise(occurrences(docs, items, window, block).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct())
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (_text_key(F.col("text")) == F.col("_key"))
    return docs.join(found, same, "left_anti")
