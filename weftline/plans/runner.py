"""Timed products: sweeps of configurations to benchmark records.

Modes name physical strategies of one logical plan: csr_serial runs it in one
task, or over partitioning.SHARE entries or rows in a task for each SHARE of
them, so that no task takes a large matrix whole; csr_openmp over partitions that own rows of about equal entries and
hll_openmp over partitions that own equal numbers of padded blocks, both
adding up where the rows are; csr_cuda and hll_cuda run numpy kernels in Arrow
batches, a launch's block size being the entries that the kernel takes at a
time (there is no GPU). Times are those of a run whose rows are all made and
none kept, by two clocks: wall-clock seconds, and the CPU seconds of all tasks
of the run's jobs (of their JVM threads; Python workers are not in them). What
a run reads is made and stored before.
"""

from __future__ import annotations

import contextlib
import time
import uuid
from collections.abc import Callable, Iterable
from datetime import datetime
from enum import Enum

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import tables
from weftline.functions.scalars import launch_block, launch_status, mflops
from weftline.functions.tables import append_text, write_text
from weftline.operators import formats, partitioning, spmv
from weftline.sources import perf_log

RUNS = 10
THREADS = tuple(range(1, 41))
BLOCKS = (128, 256, 512, 1024)
HACKS = (16, 32, 64)
DEFAULTS = {"block": 256, "hack": 32}
RECORD = "Format string, Mode string, Threads int, BlockSize int, HackSize int, Time_s double, NNZ bigint, Matrix string, status string, clock string"


class Mode(Enum):
    CSR_SERIAL = "csr_serial"
    CSR_OPENMP = "csr_openmp"
    CSR_CUDA = "csr_cuda"
    HLL_OPENMP = "hll_openmp"
    HLL_CUDA = "hll_cuda"


#: Modes whose kernels check their arguments first.
KERNELS = (Mode.CSR_CUDA, Mode.HLL_CUDA)


CLOCKS = ("wall", "cpu")


def _cpu_seconds(spark: SparkSession, group: str) -> float:
    """CPU seconds of the tasks of a job group, from Spark's own status store."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    tracker, total = spark.sparkContext.statusTracker(), 0
    stages = {s for j in tracker.getJobIdsForGroup(group) if (job := tracker.getJobInfo(j)) for s in job.stageIds}
    for s in stages:
        with contextlib.suppress(Py4JJavaError):  # a stage that was skipped has no attempt
            total += sc.statusStore().lastStageAttempt(s).executorCpuTime()
    return total / 1e9


def timed(df: DataFrame, runs: int = RUNS) -> dict[str, float]:
    """Mean seconds of computing df, by clock."""
    spark, wall = df.sparkSession, 0.0
    group = f"timed-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, "timed product")
    try:
        for _ in range(runs):
            start = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            wall += time.perf_counter() - start
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return {"wall": wall / runs, "cpu": _cpu_seconds(spark, group) / runs}


def _measured(make: Callable[[], DataFrame], runs: int) -> tuple[dict[str, float | None], str]:
    try:
        return timed(make(), runs), "OK"
    except Exception as e:  # a failed configuration is a record, and the sweep goes on
        return dict.fromkeys(CLOCKS), f"E_RUN {type(e).__name__}"


def _stored(df: DataFrame) -> DataFrame:
    df = df.persist()
    df.count()
    return df


class Forms:
    """What runs read, made once by what it is: rows, counts, x and the forms of each matrix, as tables in the shared folder.

    What was written on the way to one is deleted when it is made, and each
    goes when the last run that reads it is over, or at the end.
    """

    def __init__(self) -> None:
        self.made: dict[tuple, object] = {}
        self.paths: dict[tuple, list[str]] = {}

    def __enter__(self) -> Forms:
        return self

    def __exit__(self, *error: object) -> None:
        for key in [*self.paths]:
            self.drop(key)

    def held(self, key: tuple, make: Callable[[], object]) -> object:
        """What make gives, with the tables that it writes."""
        if key not in self.made:
            with tables.written() as paths:
                self.paths[key] = paths
                self.made[key] = make()
        return self.made[key]

    def stored(self, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
        def table() -> DataFrame:
            with tables.scratch() as keep:
                return keep(tables.cut(make()))

        return self.held(key, table)

    def drop(self, key: tuple) -> None:
        df = self.made.pop(key, None)
        if isinstance(df, DataFrame):
            df.unpersist()
        tables.delete(self.paths.pop(key, []))


def run(spark: SparkSession, meta: DataFrame, coo: DataFrame, mode: Mode, threads: Iterable[int] = THREADS, blocks: Iterable[int] = BLOCKS, hack: int = DEFAULTS["hack"], runs: int = RUNS, clocks: Iterable[str] = ("wall",), forms: Forms | None = None) -> DataFrame:
    """Benchmark records of every OK matrix in one mode, x all ones; a record for each of clocks.

    Formats and partitions are built and stored before the clock starts; with
    forms, those that other modes read too stay there for runs on the same
    matrices. The loop over matrices is short: names and sizes come to the driver.
    """
    if forms is None:
        with Forms() as forms:
            return run(spark, meta, coo, mode, threads, blocks, hack, runs, clocks, forms)
    with tables.tidy_shuffles(spark):
        records = _records(spark, meta, coo, mode, threads, blocks, hack, runs, clocks, forms)
    frame = spark.createDataFrame(records, RECORD)
    rate = F.coalesce(mflops(F.col("NNZ"), F.col("Time_s"), -1.0 if mode in KERNELS else 0.0), F.lit(-1.0))
    return frame.withColumn("MFLOPS", rate)


#: Columns of x from which it is dealt by column rather than sorted by it, where it is not small enough to go to every task.
WIDE = 1 << 20


def _records(spark: SparkSession, meta: DataFrame, coo: DataFrame, mode: Mode, threads: Iterable[int], blocks: Iterable[int], hack: int, runs: int, clocks: Iterable[str], forms: Forms) -> list[tuple]:
    records = []
    launch = launch_status(F.col("nrows"), F.col("ncols"), F.col("nnz")).alias("launch")
    shown = F.substring_index("matrix", "/", -1) if "name" not in meta.columns else F.col("name")
    for m in meta.where("status = 'OK'").select("matrix", shown.alias("name"), "nnz", "nrows", "ncols", launch).collect():
        # The name is one value here, so it is no key to sort or deal by, and no column to store.
        name = F.lit(m["matrix"]).cast("string").alias("matrix")
        named = lambda df, name=name: df.select(name, *(c for c in df.columns if c != "matrix"))
        stored = lambda make, *what, m=m, named=named: named(forms.stored((m["matrix"], *what), lambda: make().drop("matrix")))
        own = named(coo.where(F.col("matrix") == m["matrix"]))
        rows = stored(lambda m=m: formats.row_index(meta.where(F.col("matrix") == m["matrix"])), "rows")
        plain = rows.select("i")
        x = forms.stored((m["matrix"], "x"), lambda m=m: spmv.ones(spark, m["ncols"]))

        def add(fmt: str, name: str, t: int, b: int, h: int, make: Callable[[], DataFrame], m=m) -> None:
            if mode in KERNELS and m["launch"] != "RUN":
                seconds, status = (dict.fromkeys(CLOCKS, 0.0), "OK") if m["launch"] == "EMPTY" else (dict.fromkeys(CLOCKS), m["launch"])
            else:
                seconds, status = _measured(make, runs)
            records.extend((fmt, name, t, b, h, seconds[clock], m["nnz"], m["name"], status, clock) for clock in clocks)

        if mode is Mode.CSR_SERIAL:
            shares = max(1, -(-max(m["nnz"] or 0, m["nrows"]) // partitioning.SHARE))
            data = own.select("matrix", "i", "j", "v").coalesce(shares)
            if not tables.is_cut(coo):
                data = forms.held((m["matrix"], "serial"), lambda data=data: _stored(data))
            wide = x.hint("shuffle_hash") if m["ncols"] > WIDE else x
            add("CSR", "SerialRef", -1, -1, -1, lambda data=data, rows=plain, x=wide, shares=shares: spmv.spmv_coo(data, rows, x).coalesce(shares))
            forms.drop((m["matrix"], "serial"))
        elif mode is Mode.CSR_OPENMP:
            placed, most = forms.held((m["matrix"], "placed"), lambda own=own, plain=plain: partitioning.placed_items(own.drop("matrix"), plain))
            for t in threads:
                data = _stored(partitioning.deal_items(named(placed), most, t))
                add("CSR", "OpenMP", t, -1, -1, lambda data=data: spmv.spmv_owned(data))
                data.unpersist()
            forms.drop((m["matrix"], "placed"))
        elif mode is Mode.CSR_CUDA:
            data = stored(lambda own=own: formats.csr_rows(own.drop("matrix")), "csr") if m["launch"] == "RUN" else None
            for b in map(launch_block, blocks):
                add("CSR", "CUDA", -1, b, -1, lambda data=data, rows=plain, x=x, b=b: spmv.spmv_arrow(data, rows, x, b))
            forms.drop((m["matrix"], "csr"))
        else:
            counts = stored(lambda own=own, rows=rows: formats.row_counts(own, rows), "counts")
            data = stored(lambda own=own, counts=counts: formats.hll_blocks(own, counts, hack), "hll", hack)
            if mode is Mode.HLL_OPENMP:
                for t in threads:
                    owned = _stored(partitioning.distribute_blocks(data, t))
                    add("HLL", "OpenMP", t, -1, hack, lambda owned=owned: spmv.spmv_blocks(owned))
                    owned.unpersist()
            else:
                for b in map(launch_block, blocks):
                    add("HLL", "CUDA", -1, b, hack, lambda data=data, rows=plain, x=x, b=b: spmv.spmv_blocks_arrow(data, rows, x, b))
    return records


def single(spark: SparkSession, meta: DataFrame, coo: DataFrame, mode: Mode, threads: int | None = None, block: int = DEFAULTS["block"], hack: int = DEFAULTS["hack"], runs: int = RUNS) -> DataFrame:
    """One configuration of a mode; threads defaults to the session's parallelism."""
    return run(spark, meta, coo, mode, [threads or spark.sparkContext.defaultParallelism], [block], hack, runs)


# The names of a suite's folder and of its log.
FOLDER = "benchmark_results_%Y%m%d_%H%M%S"
LOG = "master_execution_log.txt"


def run_folder(base: str, when: datetime) -> str:
    """The dated folder of a run."""
    return f"{base.rstrip('/')}/{when.strftime(FOLDER)}"


def run_suite(spark: SparkSession, meta: DataFrame, coo: DataFrame, hacks: Iterable[int] = HACKS, out: str | None = None, **options) -> dict[str, DataFrame]:
    """Log name -> records of the nine suites; a suite that fails is left out and the others go on.

    The suites of a hack size come one after the other, so that its blocks are
    stored once and are gone before those of the next one are made.

    out: a folder that each suite's log goes to as a file of lines, with a
    master log of what ran and how it ended.
    """
    suites = [("results_csr_serial.txt", Mode.CSR_SERIAL, DEFAULTS["hack"]), ("results_csr_openmp.txt", Mode.CSR_OPENMP, DEFAULTS["hack"]), ("results_csr_cuda.txt", Mode.CSR_CUDA, DEFAULTS["hack"])]
    suites += [(f"results_hll_{kind}{h}.txt", mode, h) for h in hacks for kind, mode in (("openmp", Mode.HLL_OPENMP), ("cuda", Mode.HLL_CUDA))]
    found, log = {}, []

    def note(*lines: str) -> None:
        log.extend(lines)
        if out:
            append_text(spark, f"{out}/{LOG}", list(lines))
        else:
            print(*lines, sep="\n")

    note(f"suites started at {datetime.now().isoformat(timespec='seconds')}")
    with Forms() as forms:
        for name, mode, hack in suites:
            note(f"{name}: {mode.value} begins")
            try:
                found[name] = run(spark, meta, coo, mode, hack=hack, forms=forms, **options)
                if out:
                    write_text(spark, f"{out}/{name}", [r["value"] for r in perf_log.format_lines(found[name]).collect()])
                note(f"{name}: completed")
            except Exception as e:
                note(f"{name}: failed: {e}")
            if mode is Mode.HLL_CUDA:
                for key in [k for k in forms.made if k[1:] == ("hll", hack)]:
                    forms.drop(key)
    note(f"suites ended at {datetime.now().isoformat(timespec='seconds')}")
    return found
