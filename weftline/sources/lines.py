"""Text files as numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.tables import cut


def read_lines(spark: SparkSession, path: str | list[str], glob: str = "*", recursive: bool = False) -> DataFrame:
    """(path, file, line_no, value) of the text files in path whose names match glob (case-sensitive), lines from 1.

    path is the whole path, file the name, which files in several folders may share.
    A large file is read in splits. Increasing ids follow the lines of a split, so
    its first id and the splits' line counts, a row for each, number the lines
    where they are read: no line is shuffled, sorted or held.
    """
    raw = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).text(path)
    split = raw.select(F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__id"), "value")
    counts = split.groupBy("__path", "__start").agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("__first"))
    upto = Window.partitionBy("__path").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)
    before = cut(counts.select(F.col("__path").alias("__p"), F.col("__start").alias("__s"), (F.coalesce(F.sum("n").over(upto), F.lit(0)) + 1 - F.col("__first")).alias("__before")))
    numbered = split.join(before, (F.col("__path") == F.col("__p")) & (F.col("__start") == F.col("__s")))
    return numbered.select(F.col("__path").alias("path"), "file", (F.col("__before") + F.col("__id")).cast("long").alias("line_no"), "value")
