"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evolens.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (a, b); component is the smallest node that can be reached.

    Alternates large-star and small-star steps: every node hands its larger neighbours, then its smaller ones, to the
    smallest it knows, until the edges are stars. Minima are combined before the shuffle and nothing is collected.
    """
    stars = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        larger = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        larger = materialise(larger.where("a <> b").distinct())
        least = larger.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        joined = larger.join(least, F.col("a") == F.col("u"))
        handed = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        stars = materialise(handed.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
