"""Distances between array columns, on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_l2(a: Column, b: Column) -> Column:
    squares = F.zip_with(
        a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    )
    return F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def similarity(distance: Column) -> Column:
    return 1 / (1 + distance)
