"""Prefix sums that do not meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scalars import int_div


def exclusive_prefix(df: DataFrame, by: list[str], order: str, value: str, out: str, width: int = 1 << 16) -> DataFrame:
    """Add out: the sum of value over the rows of the same by with a smaller order.

    order is a non-negative integer, unique within by. The orders are cut into
    ranges of width; one row per range is summed by a window, and each range
    by a window of its own, so no task sees more than a range or the totals.
    """
    ranged = df.withColumn("__range", int_div(F.col(order), width))
    totals = ranged.groupBy(*by, "__range").agg(F.sum(value).alias("__total"))
    upto = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__range").alias("__before_range"), F.coalesce(F.sum("__total").over(upto), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*by, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("__within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    on = F.col("__range") == F.col("__before_range")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return summed.join(before, on).select(*df.columns, (F.col("__before") + F.col("__within")).cast("long").alias(out))
