"""Putting numbers into context: what an entity's values mean next to its peers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evolens.functions import fixed_values as fv
from evolens.operators.joins import lookup_join
from evolens.operators.quantiles import exact_medians, with_percentile_rank
from evolens.session import materialise

def cluster_medians(analysis: DataFrame) -> DataFrame:
    """Median churn and complexity slope per cluster; a missing value counts as 0."""
    flat = analysis.select(
        F.col("cluster_id").cast("string").alias("cluster_id"),
        F.coalesce("raw_churn_rate", F.lit(0.0)).alias("churn"),
        F.coalesce("hist_cc_value", F.lit(0.0)).alias("cc_slope"),
    )
    return exact_medians(flat, ["cluster_id"], ["churn", "cc_slope"])


def _fixed(value: Column, digits: int) -> Column:
    """A number with a fixed count of decimals, ties to even."""
    return F.format_string(f"%.{digits}f", F.bround(value, digits))


def churn_ratio(churn: Column, median: Column) -> Column:
    return F.when(median > 0, F.try_divide(churn, median)).otherwise(1.0)


def anomaly_context(percentile: Column, top: Column) -> Column:
    return (
        F.when(top <= fv.EXTREME_PERCENT, F.format_string(fv.EXTREME_CONTEXT, top))
        .when(top <= fv.ATYPICAL_PERCENT, F.format_string(fv.ATYPICAL_CONTEXT, top))
        .otherwise(F.format_string(fv.PERCENTILE_CONTEXT, percentile))
    )


def churn_comparison(ratio: Column) -> Column:
    bands = [F.when(ratio < limit, F.lit(words)) for limit, words in fv.CHURN_BANDS]
    band = F.coalesce(*bands, F.lit(fv.CHURN_ABOVE))
    return F.format_string(fv.CHURN_CONTEXT, _fixed(ratio, 2), band)


def complexity_comparison(slope: Column, median: Column) -> Column:
    ratio = F.bround(F.abs(F.try_divide(slope, median)), 2)
    slower, faster = fv.COMPLEXITY_PACE
    pace = F.when(F.abs(slope) > F.abs(median), faster).otherwise(slower)
    versus = F.format_string(fv.COMPLEXITY_CONTEXT, ratio.cast("string"), pace)
    alone = F.format_string(fv.SLOPE_CONTEXT, _fixed(slope, 4))
    return F.when(F.abs(median) > fv.MEDIAN_SLOPE_FLOOR, versus).otherwise(alone)


def with_context(analysis: DataFrame, everyone: DataFrame | None = None) -> DataFrame:
    """Add anomaly, churn and complexity context and the key signals to flat analysis rows.

    Ranks and medians come from ``everyone`` (by default the rows themselves). A
    cluster without medians compares with 0.
    """
    everyone = analysis if everyone is None else everyone
    medians = materialise(cluster_medians(everyone)).withColumnRenamed("cluster_id", "_cluster")
    ranked = with_percentile_rank(analysis, "anomaly_score", everyone=everyone)
    keyed = ranked.withColumn("_cluster", F.col("cluster_id").cast("string"))
    joined = lookup_join(keyed, medians, ["_cluster"], "left")
    churn, slope = F.col("raw_churn_rate"), F.col("hist_cc_value")
    median_churn = F.coalesce("median_churn", F.lit(0.0))
    median_slope = F.coalesce("median_cc_slope", F.lit(0.0))
    ratio = churn_ratio(churn, median_churn)
    return joined.withColumns(
        {
            "anomaly_context": anomaly_context(F.col("percentile"), F.col("top_percent")),
            "churn_comparison": churn_comparison(ratio),
            "complexity_comparison": complexity_comparison(slope, median_slope),
            "churn_vs_cluster": F.format_string(fv.CHURN_SIGNAL, _fixed(ratio, 1)),
            "complexity_trend": F.format_string(
                fv.TREND_SIGNAL, F.col("hist_cc_label"), _fixed(slope, 4)
            ),
            "maintainability_trend": F.col("hist_mi_label"),
            "import_volatility": F.col("imports_volatility_label"),
        }
    ).drop("_cluster", "median_churn", "median_cc_slope")
