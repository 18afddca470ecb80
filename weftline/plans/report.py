"""From benchmark logs to exported records and chart data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import perf_metrics as pm
from weftline.functions.tables import cut
from weftline.schema import PERF_COLUMNS
from weftline.sources import perf_log

EXPORTS = {"openmp_csr_perf": ("OpenMP", "CSR"), "openmp_hll_perf": ("OpenMP", "HLL"), "cuda_csr_perf": ("CUDA", "CSR"), "cuda_hll_perf": ("CUDA", "HLL")}
#: Mode -> x of the line charts, measures, whether the efficiency per thread is one.
CHARTS = {"OpenMP": ("Threads", ["GFLOPS", "Speedup", "Efficiency"], True), "CUDA": ("BlockSize", ["GFLOPS", "Speedup"], False)}
ORDER = ["file", "line_no"]


def exports(perf: DataFrame) -> dict[str, DataFrame]:
    """The four exported tables by name."""
    return {name: pm.select_runs(perf, mode, fmt) for name, (mode, fmt) in EXPORTS.items()}


def chart_data(perf: DataFrame, mode: str) -> DataFrame:
    """(chart, Matrix, x, y) of all charts of a mode, in one plan: lines per format and hack size, bars of the best configurations.

    Empty inputs give empty data; without serial runs the speedups are null
    and leave no bars.
    """
    x, measures, efficiency = CHARTS[mode]
    runs = pm.with_speedup(pm.select_runs(perf, mode).where(F.col("Format").isin("CSR", "HLL")), pm.serial_reference(perf), efficiency)
    every = F.inline(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in measures)))
    place = F.when(F.col("Format") == "CSR", "CSR").otherwise(F.concat(F.lit("HLL/HackSize_"), F.col("HackSize")))
    lines = runs.where("Format = 'CSR' or HackSize <> -1").select(place.alias("place"), "Matrix", F.col(x).cast("string").alias("x"), every)
    best = pm.best_configuration(runs.dropna(subset=measures), ORDER)
    bars = best.select(F.lit("Comparisons").alias("place"), "Matrix", F.col("Format").alias("x"), every)
    chart = F.concat_ws("/", F.lit(mode), "place", "measure").alias("chart")
    return lines.unionByName(bars).groupBy(chart, "Matrix", "x").agg(F.avg("value").alias("y"))


def charts(perf: DataFrame, mode: str) -> dict[str, DataFrame]:
    """Path of a chart -> its data, (Matrix, x, measure). The paths, a short list, come to the driver."""
    return _by_path(cut(chart_data(perf, mode)), mode)


def _by_path(data: DataFrame, mode: str) -> dict[str, DataFrame]:
    x, measures, _ = CHARTS[mode]
    data = data.where(F.col("chart").startswith(f"{mode}/"))
    names = {f"{mode}/{kind}/{y}" for kind in ("CSR", "Comparisons") for y in measures} | {r["chart"] for r in data.select("chart").distinct().collect()}
    found = {}
    for name in sorted(names):
        bar, y = "/Comparisons/" in name, name.rsplit("/", 1)[-1]
        found[name] = data.where(F.col("chart") == name).select("Matrix", F.col("x").alias("Format") if bar else F.col("x").cast("int").alias(x), F.col("y").alias(y))
    return found


def main(spark: SparkSession, logs: str, out: str, recursive: bool = False) -> dict[str, DataFrame]:
    """Read the logs, write the four tables as CSV and all charts' data, and return the chart data.

    The records go to csv/table=NAME and the data of all charts to
    charts/chart=PATH (slashes as %2F), each in one write, whose folders that
    a run makes anew replace those of a run before.
    """
    perf = cut(pm.valid(perf_log.read(spark, logs, recursive)))
    name = F.coalesce(*(F.when((F.col("Mode") == mode) & (F.col("Format") == fmt), n) for n, (mode, fmt) in EXPORTS.items()))
    _written(perf.withColumn("table", name).where("table is not null").select("table", *PERF_COLUMNS), "table", f"{out}/csv")
    data = cut(chart_data(perf, "OpenMP").unionByName(chart_data(perf, "CUDA")))
    _written(data, "chart", f"{out}/charts")
    pm.palette(perf).write.mode("overwrite").csv(f"{out}/palette", header=True)
    return _by_path(data, "OpenMP") | _by_path(data, "CUDA")


def _written(df: DataFrame, by: str, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).csv(path, header=True)
