"""Global order without a window over the whole table."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evolens.session import materialise


def running_totals(
    df: DataFrame, order: Sequence[str], weight: str | None = None, output: str = "before", total: str | None = None
) -> DataFrame:
    """Adds ``output``: the summed ``weight`` (by default the number) of all rows earlier in the order; as ``total`` that of all.

    Rows should differ in ``order``. The table is range partitioned, every part adds up its own rows, and one number
    per part reaches the driver, where it becomes the offset of the next part.
    """
    order = list(order)
    value = F.lit(1) if weight is None else F.col(weight)
    parts = materialise(df.repartitionByRange(*order).withColumns({"_part": F.spark_partition_id(), "_value": value.cast("bigint")}))
    sums = sorted(parts.groupBy("_part").agg(F.sum("_value")).collect())
    offsets = [0, *accumulate(total for _, total in sums)]
    shift = parts.sparkSession.createDataFrame([(p, o) for (p, _), o in zip(sums, offsets)], "_part int, _offset bigint")
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = parts.withColumn("_within", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    joined = within.join(F.broadcast(shift), "_part")  # a row for each part
    added = joined.withColumn(output, F.col("_within") + F.col("_offset")).drop("_part", "_value", "_within", "_offset")
    return added if total is None else added.withColumn(total, F.lit(offsets[-1]).cast("bigint"))
