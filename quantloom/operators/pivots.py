"""Pivot highs and lows: a bar whose high is the only maximum of the bars around it; lows mirrored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.expr import series


def with_pivots(bars: DataFrame, left: int = 5, right: int = 5) -> DataFrame:
    """bars with is_high, is_low and pos (0-based bar number); bars without a full window are no pivots."""
    before, after = series().rowsBetween(-left, -1), series().rowsBetween(1, right)
    full = F.count("*").over(series().rowsBetween(-left, right)) == left + right + 1
    high = full & (F.col("h") > F.max("h").over(before)) & (F.col("h") > F.max("h").over(after))
    low = full & (F.col("l") < F.min("l").over(before)) & (F.col("l") < F.min("l").over(after))
    return bars.withColumns({"is_high": F.coalesce(high, F.lit(False)), "is_low": F.coalesce(low, F.lit(False)), "pos": F.row_number().over(series()) - 1})
