"""Places in a global order, without a window over all rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.tables import cut

#: Bits of Spark's increasing ids that count within a partition.
BITS = 33


def in_order(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """df dealt to ranges of the order and sorted where it is, nulls first; rows that tie are dealt by where they stand in df."""
    keys = [*order, "__tie"]
    return df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")


def _placed(df: DataFrame, order: list[str | Column], out: str) -> DataFrame:
    """df with out, as numbered() does, and __range: the range that a row was dealt to."""
    table = cut(in_order(df, order).withColumn("__id", F.monotonically_increasing_id()))
    table = table.withColumn("__range", F.shiftright("__id", BITS)).withColumn("__at", F.col("__id").bitwiseAND(F.lit((1 << BITS) - 1)))
    counts = table.groupBy(F.col("__range").alias("__r")).agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each task that wrote
    before = counts.select("__r", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"))
    placed = table.join(F.broadcast(before), F.col("__range") == F.col("__r"))
    return placed.select(*df.columns, "__range", (F.col("__before") + F.col("__at")).alias(out))


def numbered(df: DataFrame, order: list[str | Column], out: str) -> DataFrame:
    """df with out: each row's place from 0 in the order of the given columns, nulls first.

    Rows are dealt to ranges of the order, sorted where they are, and written
    once with their range and their place in it; the ranges' counts, one row
    for each, say what comes before. Neither a frequent key nor equal rows
    meet in one task.
    """
    return _placed(df, order, out).drop("__range")


def groups_within(df: DataFrame, by: list[str], order: list[str | Column], out: str, size: str | None = None) -> tuple[DataFrame, DataFrame]:
    """numbered_within's rows, and a table with a row for each range and by in it: __range, __first and __n of by (as __NAME).

    by's first place and its rows are summed over its ranges, a row for each,
    and go back to the rows by range and by together: a frequent by is as many
    groups as it has ranges, so it does not meet in one task. The table's known
    size lets Spark broadcast it where there are few.
    """
    placed = _placed(df, [*by, *order], "__place")
    keys = [f"__{c}" for c in by]
    pairs = placed.groupBy(F.col("__range").alias("__r"), *(F.col(c).alias(k) for c, k in zip(by, keys, strict=True))).agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__n"))
    every = Window.partitionBy(*keys)
    pairs = cut(pairs.select("__r", *keys, F.min("__first").over(every).alias("__first"), F.sum("__n").over(every).alias("__n")))
    on = F.col("__range") == F.col("__r")
    for c, k in zip(by, keys, strict=True):
        on = on & F.col(c).eqNullSafe(F.col(k))
    return placed.join(pairs, on).select(*df.columns, (F.col("__place") - F.col("__first")).alias(out), *([F.col("__n").alias(size)] if size else [])), pairs


def numbered_within(df: DataFrame, by: list[str], order: list[str | Column], out: str, size: str | None = None) -> DataFrame:
    """df with out: each row's place from 0 among the rows of the same by (nulls are one value), and with size, their number."""
    return groups_within(df, by, order, out, size)[0]
