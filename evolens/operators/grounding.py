"""Commit references against a table of valid hashes of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evolens.functions import text
from evolens.operators.joins import lookup_join
from evolens.session import materialise

#: A token names a hash if both begin with the same characters, so many or as many as the hash has.
PREFIX = 7


def reference_tokens(texts: DataFrame, key: str, column: str) -> DataFrame:
    """key and each different hash-like token of its text."""
    tokens = F.explode(F.array_distinct(text.hash_tokens(F.col(column))))
    return texts.select(key, tokens.alias("token"))


def supporting_hashes(tokens: DataFrame, valid: DataFrame, hash_column: str = "commit_hash") -> DataFrame:
    """token and the least valid hash that it names, for each different token that names one.

    Both sides meet by prefix: a bucket for each PREFIX characters, and one for each shorter hash as it is. Of a bucket
    one hash is kept, as all of them support the same tokens; so no task holds a list of hashes.
    """
    bucket = F.substring(hash_column, 1, PREFIX)
    buckets = valid.where(F.col(hash_column).isNotNull()).groupBy(bucket.alias("_bucket")).agg(F.min(hash_column).alias("hash"))
    buckets = materialise(buckets)
    lengths = [r[0] for r in buckets.select(F.length("_bucket")).distinct().collect()]  # at most PREFIX + 1
    different = tokens.select("token").distinct()
    starts = F.explode(F.array(*[F.substring("token", 1, n) for n in lengths] or [F.lit("")]))
    met = lookup_join(different.select("token", starts.alias("_bucket")), buckets, ["_bucket"], salt_on=["token"])
    return met.groupBy("token").agg(F.min("hash").alias("hash"))


def grounded_references(texts: DataFrame, key: str, column: str, valid: DataFrame, hash_column: str = "commit_hash") -> DataFrame:
    """key, tokens (different ones in its text), grounded (of them, those that name a valid hash) and hashes (named)."""
    tokens = materialise(reference_tokens(texts, key, column))
    named = lookup_join(tokens, materialise(supporting_hashes(tokens, valid, hash_column)), ["token"], "left", salt_on=[key])
    counts = named.groupBy(key).agg(
        F.count("*").alias("tokens"), F.count("hash").alias("grounded"), F.count_distinct("hash").alias("hashes")
    )
    zeros = {c: F.coalesce(c, F.lit(0)) for c in ("tokens", "grounded", "hashes")}
    return texts.select(key).join(counts, key, "left").withColumns(zeros)
