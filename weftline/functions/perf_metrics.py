"""Measures and summaries of benchmark records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scalars import gflops

#: Colours that charts cycle through.
PALETTE = 40


def valid(perf: DataFrame, strict_names: bool = False) -> DataFrame:
    """Records with MFLOPS of 0 or more, GFLOPS added, without matrices named *_b or *_x.

    The names carry their .mtx suffix, so the literal rule drops none;
    strict_names applies it to the name without the suffix.
    """
    name = F.regexp_replace("Matrix", r"\.mtx$", "") if strict_names else F.col("Matrix")
    return perf.where("MFLOPS >= 0").withColumn("GFLOPS", gflops(F.col("MFLOPS"))).where(~name.rlike(r"^.*(_b|_x)$"))


def select_runs(perf: DataFrame, mode: str, fmt: str | None = None) -> DataFrame:
    runs = perf.where(F.col("Mode") == mode)
    return runs if fmt is None else runs.where(F.col("Format") == fmt)


def serial_reference(perf: DataFrame) -> DataFrame:
    """(Matrix, ref_time): mean time of the serial runs."""
    return select_runs(perf, "SerialRef").groupBy("Matrix").agg(F.avg("Time_s").alias("ref_time"))


def with_speedup(perf: DataFrame, reference: DataFrame, efficiency: bool = False) -> DataFrame:
    """perf with Speedup (0 without a time, null without a reference) and, if wanted, Efficiency per thread."""
    ref = reference.select(F.col("Matrix").alias("__m"), "ref_time")
    joined = perf.join(ref, F.col("Matrix") == F.col("__m"), "left").drop("__m")
    joined = joined.withColumn("Speedup", F.when(F.col("Time_s") > 0, F.try_divide("ref_time", "Time_s")).otherwise(0.0)).drop("ref_time")
    return joined.withColumn("Efficiency", F.when(F.col("Threads") > 0, F.try_divide("Speedup", "Threads")).otherwise(0.0)) if efficiency else joined


def union_formats(csr: DataFrame, hll: DataFrame, needed: list[str]) -> DataFrame:
    """Both formats' records, those with nulls in needed dropped."""
    return csr.unionByName(hll, allowMissingColumns=True).dropna(subset=needed)


def best_configuration(perf: DataFrame, order: list[str]) -> DataFrame:
    """The record with most GFLOPS per (Matrix, Format, HackSize); of ties the first by order.

    An aggregate of structs that are ordered by these fields: the best so far
    of each group is all that a task keeps and shuffles.
    """
    groups = ["Matrix", "Format", "HackSize"]
    rest = [c for c in perf.columns if c not in {*groups, "GFLOPS", *order}]
    least = F.struct(F.col("GFLOPS").isNull().alias("__none"), (-F.col("GFLOPS")).alias("__less"), *order, *rest)
    best = perf.groupBy(*groups).agg(F.min(least).alias("__best"))
    return best.select(*((-F.col("__best.__less")).alias(c) if c == "GFLOPS" else F.col(c) if c in groups else F.col("__best")[c].alias(c) for c in perf.columns))


def hack_sizes(perf: DataFrame) -> DataFrame:
    return perf.where("HackSize <> -1").select("HackSize").distinct().orderBy("HackSize")


def block_sizes(perf: DataFrame) -> DataFrame:
    return perf.select("BlockSize").distinct().orderBy("BlockSize")


def line_series(perf: DataFrame, x: str, y: str) -> DataFrame:
    """(Matrix, x, y): the mean of y at every x, for a line per matrix."""
    return perf.groupBy("Matrix", x).agg(F.avg(y).alias(y))


def bar_means(perf: DataFrame, y: str) -> DataFrame:
    """(Matrix, Format, y): the mean of y, for a bar per matrix and format."""
    return perf.groupBy("Matrix", "Format").agg(F.avg(y).alias(y))


def _ranked(perf: DataFrame) -> DataFrame:
    """The matrices' names, a short list, with their place in order from 0 and their number."""
    names = perf.select("Matrix").distinct()
    place = F.row_number().over(Window.orderBy("Matrix")) - 1
    return names.select("Matrix", place.alias("place"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))


def halves(perf: DataFrame) -> DataFrame:
    """(Matrix, half): the first ceil(n / 2) names are half 1, the others 2."""
    return _ranked(perf).select("Matrix", F.when(F.col("place") * 2 < F.col("n") + F.col("n") % 2, 1).otherwise(2).alias("half"))


def palette(perf: DataFrame) -> DataFrame:
    """(Matrix, colour): colours 0 to PALETTE - 1 in the order of the names."""
    return _ranked(perf).select("Matrix", (F.col("place") % PALETTE).alias("colour"))
