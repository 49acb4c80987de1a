"""Rule labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evolens.functions import fixed_values as fv


def churn_label(rate: Column) -> Column:
    (few, some), (low, moderate, high) = fv.CHURN_THRESHOLDS, fv.CHURN_LABELS
    return F.when(rate <= few, low).when(rate <= some, moderate).otherwise(high)


def trend_label(slope: Column, threshold: float) -> Column:
    down, level, up = fv.TREND_LABELS
    return F.when(slope < -threshold, down).when(slope > threshold, up).otherwise(level)


def volatility_label(std: Column) -> Column:
    calm, moving = fv.VOLATILITY_LABELS
    return F.when(std <= fv.VOLATILITY_THRESHOLD, calm).otherwise(moving)


def recent_versus_history(recent: Column, historical: Column) -> Column:
    """unchanged within the band; above it regressing, below it improving."""
    change = F.try_divide(recent - historical, F.abs(historical))
    direction = F.when(historical == 0, recent).otherwise(change)
    band = F.when(historical == 0, F.lit(0.0)).otherwise(F.lit(fv.RECENT_COMPARISON_THRESHOLD))
    better, same, worse = fv.COMPARISON_LABELS
    return F.when(F.abs(direction) <= band, same).when(direction > 0, worse).otherwise(better)


def add_rule_labels(features: DataFrame) -> DataFrame:
    """Nine label columns in one projection."""
    c = F.col
    return features.withColumns(
        {
            "churn_label": churn_label(c("churn_rate")),
            "cc_trend_label": trend_label(c("cc_trend"), fv.CC_TREND_THRESHOLD),
            "mi_trend_label": trend_label(c("mi_trend"), fv.MI_TREND_THRESHOLD),
            "imports_trend_label": trend_label(c("imports_trend"), fv.IMPORTS_TREND_THRESHOLD),
            "cc_volatility_label": volatility_label(c("std_cc_after")),
            "imports_volatility_label": volatility_label(c("std_imports_after")),
            "recent_cc_trend_vs_historical": recent_versus_history(
                c("recent_cc_trend"), c("cc_trend")
            ),
            "recent_imports_trend_vs_historical": recent_versus_history(
                c("recent_imports_trend"), c("imports_trend")
            ),
            "recent_cc_volatility_vs_historical": recent_versus_history(
                c("recent_cc_volatility"), c("std_cc_after")
            ),
        }
    )


def cluster_label(churn: Column, cc_trend: Column, cc_volatility: Column) -> Column:
    """A readable name for a cluster from three of its averages."""
    (few, some), (low, moderate, high) = fv.CHURN_THRESHOLDS, fv.CLUSTER_CHURN
    activity = F.when(churn > some, high).when(churn > few, moderate).otherwise(low)
    down, level, up = fv.CLUSTER_COMPLEXITY
    limit = fv.CC_TREND_THRESHOLD
    complexity = F.when(cc_trend > limit, up).when(cc_trend < -limit, down).otherwise(level)
    volatility = F.when(cc_volatility > fv.VOLATILITY_THRESHOLD, fv.CLUSTER_VOLATILITY)
    return F.concat_ws(", ", activity, complexity, volatility)
