"""Benchmark logs: text lines to records and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.schema import PERF_COLUMNS
from weftline.sources.lines import read_lines

# The format of a record's line and of a log's file name.
RECORD = r"\[PERF\]\s+.*?Threads:([-0-9]+),\s+BlockSize:([-0-9]+),\s+HackSize:([-0-9]+),\s+Time_s:([0-9.]+),\s+MFLOPS:([-0-9.]+),\s+NNZ:([0-9]+),\s*Matrix:([\w.-]+)"
FILE = r"^results_(\w+)_(\w+)\.txt"
TYPES = [("Threads", "int"), ("BlockSize", "int"), ("HackSize", "int"), ("Time_s", "double"), ("MFLOPS", "double"), ("NNZ", "bigint"), ("Matrix", "string")]
#: Mode prefix in file names -> mode in records.
MODES = {"OPENMP": "OpenMP", "CUDA": "CUDA"}


def file_parts(file: Column) -> dict[str, Column]:
    """Format, Mode and HackSize that a log's file name states; all null for other names. HackSize -1: not stated."""
    known = file.rlike(FILE)
    raw = F.upper(F.regexp_extract(file, FILE, 2))
    mode, hack = F.when(raw == "SERIAL", "SerialRef"), F.lit(None).cast("int")
    for prefix, name in MODES.items():
        rest = F.replace(raw, F.lit(prefix), F.lit(""))
        mode = mode.when(raw.startswith(prefix), name)
        hack = F.when(raw.startswith(prefix) & (rest != ""), F.try_to_number(rest, F.lit("999999999")).cast("int")).otherwise(hack)
    return {"Format": F.when(known, F.upper(F.regexp_extract(file, FILE, 1))), "Mode": F.when(known, mode.otherwise(raw)), "HackSize": F.when(known, F.coalesce(hack, F.lit(-1)))}


def parse(lines: DataFrame) -> DataFrame:
    """Records of numbered log lines (file, line_no, value), with file and line_no.

    Lines that do not begin with [PERF], do not match, or stand in a file with
    another kind of name give no record. The file name's Format and Mode, and
    its HackSize if it states one, override the line's.
    """
    parts = file_parts(F.col("file"))
    rows = lines.where(F.col("file").rlike(FILE) & F.col("value").startswith("[PERF]") & F.col("value").rlike(RECORD))
    fields = [F.regexp_extract("value", RECORD, k).try_cast(kind).alias(name) for k, (name, kind) in enumerate(TYPES, 1)]
    rows = rows.select("file", "line_no", *fields, parts["Format"].alias("Format"), parts["Mode"].alias("Mode"), parts["HackSize"].alias("__hack"))
    return rows.withColumn("HackSize", F.when(F.col("__hack") != -1, F.col("__hack")).otherwise(F.col("HackSize"))).drop("__hack")


def read(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Records of all logs in a folder, or with recursive of those of write_logs()."""
    lines = read_lines(spark, path, "*" if recursive else "results_*", recursive)
    if recursive:
        lines = lines.withColumn("file", F.coalesce(F.nullif(F.regexp_extract("path", "/log=([^/]+)/", 1), F.lit("")), "file"))
    return parse(lines.select("file", "line_no", "value"))


def log_name(fmt: Column, mode: Column, hack: Column) -> Column:
    """The name of the log that a record belongs in."""
    kind = F.when(mode == "SerialRef", "serial").otherwise(F.lower(mode))
    return F.concat(F.lit("results_"), F.lower(fmt), F.lit("_"), kind, F.when(hack != -1, hack.cast("string")).otherwise(""), F.lit(".txt"))


def write_logs(perf: DataFrame, path: str) -> None:
    """The records as log lines under path, those of each log in a folder log=NAME, in one pass."""
    lines = format_lines(perf.withColumn("__log", log_name(F.col("Format"), F.col("Mode"), F.col("HackSize"))), "__log")
    lines.withColumnRenamed("__log", "log").write.mode("overwrite").partitionBy("log").text(path)


def format_lines(perf: DataFrame, *beside: str) -> DataFrame:
    """(value): the log line of each record, and the columns named beside; write.text() stores it."""
    number = lambda c: F.coalesce(F.col(c), F.lit(-1))
    line = F.format_string("[PERF] Format:%s, Mode:%s, Threads:%d, BlockSize:%d, HackSize:%d, Time_s:%.8f, MFLOPS:%.2f, NNZ:%d, Matrix:%s", "Format", "Mode", number("Threads"), number("BlockSize"), number("HackSize"), number("Time_s").cast("double"), number("MFLOPS").cast("double"), "NNZ", "Matrix")
    return perf.select(line.alias("value"), *beside)


def write_csv(perf: DataFrame, path: str) -> None:
    """The records as CSV with a header, columns in the order of PERF_COLUMNS."""
    perf.select(*PERF_COLUMNS).write.mode("overwrite").csv(path, header=True)
