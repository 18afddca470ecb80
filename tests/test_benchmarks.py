import math
from datetime import datetime
from pathlib import Path

import pytest

from weftline.functions import perf_metrics as pm
from weftline.functions import scalars, tables
from weftline.plans import cli, report, runner
from weftline.sources import matrix_market, perf_log
from tests.test_matrix_market import SYMMETRIC, TINY


def line(matrix="a.mtx", threads=-1, block=-1, hack=-1, time="0.01517020", mflops="406.56", nnz=3083796, mode="X", fmt="X"):
    return f"[PERF] Format:{fmt}, Mode:{mode}, Threads:{threads}, BlockSize:{block}, HackSize:{hack}, Time_s:{time}, MFLOPS:{mflops}, NNZ:{nnz}, Matrix:{matrix}"


LOGS = {
    "results_csr_serial.txt": ["executing in mode", line(), line("foo_b.mtx", time="0.02", mflops="10.00"), line("a.mtx", time="0.03034040", mflops="203.28")],
    "results_csr_openmp.txt": [line(threads=16, time="0.002", mflops="3083.80"), line(threads=8, time="0.004", mflops="1541.90"), line("lone.mtx", threads=4, time="0.1", mflops="5.00"), " " + line()],
    "results_csr_cuda.txt": [line(block=256, time="-1.00000000", mflops="-1.00"), line(block=256, time="0.00000000", mflops="-1.00", nnz=0), line(block=128, time="0.001", mflops="6167.59")],
    "results_hll_openmp16.txt": [line(threads=16, hack=99, time="0.002", mflops="3083.80"), line(threads=2, hack=16, time="0", mflops="0.00")],
    "results_hll_cuda64.txt": [line(block=512, hack=64, time="0.002", mflops="3000.00"), line(block=1024, hack=64, time="0.002", mflops="3000.00")],
    "results.txt": [line()],
    "other_csr_serial.txt": [line()],
}


def write(folder, logs=LOGS):
    for name, text in logs.items():
        (folder / name).write_text("\n".join(text) + "\n")
    return str(folder)


def test_parsing(spark, tmp_path):
    rows = perf_log.read(spark, write(tmp_path)).orderBy("file", "line_no").collect()
    assert len(rows) == 12
    by = {}
    for r in rows:
        by.setdefault((r.Format, r.Mode), []).append(r)
    assert {k: len(v) for k, v in by.items()} == {("CSR", "SerialRef"): 3, ("CSR", "OpenMP"): 3, ("CSR", "CUDA"): 2, ("HLL", "OpenMP"): 2, ("HLL", "CUDA"): 2}
    assert {r.HackSize for r in by["HLL", "OpenMP"]} == {16} and {r.HackSize for r in by["CSR", "CUDA"]} == {-1}
    first = by["CSR", "SerialRef"][0]
    assert (first.Threads, first.BlockSize, first.Time_s, first.MFLOPS, first.NNZ, first.Matrix) == (-1, -1, 0.0151702, 406.56, 3083796, "a.mtx")


def test_a_hack_size_that_is_no_number_is_not_stated(spark, tmp_path):
    got = perf_log.read(spark, write(tmp_path, {"results_hll_cudax.txt": [line(block=512, hack=7)]})).first()
    assert (got.Mode, got.HackSize) == ("CUDA", 7)


def test_filters(spark, tmp_path):
    perf = perf_log.read(spark, write(tmp_path))
    kept = pm.valid(perf)
    assert kept.where("MFLOPS < 0").count() == 0 and kept.where("Matrix = 'foo_b.mtx'").count() == 1
    assert pm.valid(perf, strict_names=True).where("Matrix = 'foo_b.mtx'").count() == 0
    assert kept.where("Matrix = 'a.mtx' and Mode = 'SerialRef'").first().GFLOPS == pytest.approx(0.40656)


def test_speedups(spark, tmp_path):
    perf = pm.valid(perf_log.read(spark, write(tmp_path)))
    ref = pm.serial_reference(perf)
    assert {r.Matrix: r.ref_time for r in ref.collect()} == pytest.approx({"a.mtx": 0.0227553, "foo_b.mtx": 0.02})
    got = {(r.Format, r.Matrix, r.Threads): (r.Speedup, r.Efficiency) for r in pm.with_speedup(pm.select_runs(perf, "OpenMP"), ref, efficiency=True).collect()}
    assert got["CSR", "a.mtx", 16] == pytest.approx((11.37765, 0.711103125))
    assert got["CSR", "lone.mtx", 4] == (None, None) and got["HLL", "a.mtx", 2] == (0.0, 0.0)


def test_report(spark, tmp_path):
    logs, out = tmp_path / "logs", tmp_path / "out"
    logs.mkdir()
    charts = report.main(spark, write(logs), str(out))
    for name, n in (("openmp_csr_perf", 3), ("openmp_hll_perf", 2), ("cuda_csr_perf", 1), ("cuda_hll_perf", 2)):
        frame = spark.read.csv(f"{out}/csv/table={name}", header=True)
        assert frame.columns == perf_log.PERF_COLUMNS and frame.count() == n
    assert set(charts) >= {"OpenMP/CSR/Efficiency", "OpenMP/HLL/HackSize_16/Speedup", "OpenMP/Comparisons/GFLOPS", "CUDA/HLL/HackSize_64/GFLOPS", "CUDA/Comparisons/Speedup"}
    bars = spark.read.csv(f"{out}/charts", header=True).where("chart = 'OpenMP/Comparisons/GFLOPS'").collect()
    assert {(r.Matrix, r.x): float(r.y) for r in bars} == pytest.approx({("a.mtx", "CSR"): 3.0838, ("a.mtx", "HLL"): 3.0838})


def test_ties_go_to_the_first(spark, tmp_path):
    perf = pm.valid(perf_log.read(spark, write(tmp_path)))
    best = pm.best_configuration(pm.select_runs(perf, "CUDA", "HLL"), ["file", "line_no"]).collect()
    assert [r.BlockSize for r in best] == [512]


def test_reports_tolerate_missing_logs(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    write(logs, {"results_csr_openmp.txt": LOGS["results_csr_openmp.txt"]})
    charts = report.main(spark, str(logs), str(tmp_path / "out"))
    assert charts["OpenMP/CSR/GFLOPS"].count() == 3 and charts["OpenMP/Comparisons/GFLOPS"].count() == 0


def test_halves_and_palette(spark):
    perf = spark.createDataFrame([(f"m{i:02d}",) for i in range(43)] * 2, "Matrix string")
    half = {r.Matrix: r.half for r in pm.halves(perf).collect()}
    assert [half[f"m{i:02d}"] for i in range(43)] == [1] * 22 + [2] * 21
    colour = {r.Matrix: r.colour for r in pm.palette(perf).collect()}
    assert colour["m00"] == colour["m40"] == 0 and colour["m39"] == 39


def test_lines_round_trip(spark, tmp_path):
    perf = perf_log.read(spark, write(tmp_path, {"results_csr_serial.txt": LOGS["results_csr_serial.txt"]}))
    text = [r.value for r in perf_log.format_lines(perf).collect()]
    assert line(fmt="CSR", mode="SerialRef") in text


@pytest.mark.parametrize(("nnz", "t", "cpu", "gpu"), [(3083796, 0.0151702, 406.56, 406.56), (0, 1.0, 0.0, -1.0), (5, 0.0, 0.0, -1.0), (5, 1e-9, 0.0, -1.0)])
def test_mflops(spark, nnz, t, cpu, gpu):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(nnz, t)], "n long, t double").select(scalars.mflops(F.col("n"), F.col("t")), scalars.mflops(F.col("n"), F.col("t"), -1.0)).first()
    assert tuple(row) == (pytest.approx(cpu, abs=0.01), pytest.approx(gpu, abs=0.01))


def test_block_sizes():
    assert [scalars.launch_block(n) for n in (0, 1, 100, 1024, 1025)] == [256, 1, 100, 1024, 256]
    assert [scalars.option_block(n) for n in (0, 1, 100, 512, 2048, -4)] == [256, 1, 256, 512, 256, 256]
    assert cli.whole("junk") == 0 and cli.whole("12") == 12


def test_runner(spark, tmp_path):
    (tmp_path / "tiny.mtx").write_text(TINY)
    (tmp_path / "sym.mtx").write_text(SYMMETRIC)
    (tmp_path / "bad.mtx").write_text("nothing")
    meta, coo = matrix_market.read(spark, str(tmp_path))
    coo = coo.persist()
    options = {"threads": [1, 2], "blocks": [128], "runs": 1}
    found = runner.run_suite(spark, meta, coo, hacks=[2], **options)
    assert {k: v.count() for k, v in found.items()} == {"results_csr_serial.txt": 2, "results_csr_openmp.txt": 4, "results_csr_cuda.txt": 2, "results_hll_openmp2.txt": 4, "results_hll_cuda2.txt": 2}
    logs = tmp_path / "logs"
    logs.mkdir()
    write(logs, {name: [r.value for r in perf_log.format_lines(df).collect()] for name, df in found.items()})
    perf = pm.valid(perf_log.read(spark, str(logs)))
    assert perf.count() == 14 and {r.NNZ for r in perf.collect()} == {6}
    assert all(math.isclose(r.MFLOPS, 12 / r.Time_s / 1e6, rel_tol=1e-3, abs_tol=0.006) for r in perf.collect())


def test_empty_matrices_take_no_time_and_a_suite_logs(spark, tmp_path):
    (tmp_path / "none.mtx").write_text("%%MatrixMarket matrix coordinate real general\n2 2 0\n")
    meta, coo = matrix_market.read(spark, str(tmp_path))
    out = runner.run_folder(str(tmp_path / "out"), datetime(2024, 2, 3, 4, 5, 6))
    assert out.endswith("out/benchmark_results_20240203_040506")
    found = runner.run_suite(spark, meta, coo, [2], out=out, threads=[1], blocks=[128], runs=1)
    assert [(r.Time_s, r.MFLOPS, r.status) for r in found["results_csr_cuda.txt"].collect()] == [(0.0, -1.0, "OK")]
    assert [r.MFLOPS for r in found["results_csr_serial.txt"].collect()] == [0.0]
    log = (Path(out) / runner.LOG).read_text()
    assert log.count("completed") == 5 and (Path(out) / "results_hll_cuda2.txt").read_text().startswith("[PERF] Format:HLL, Mode:CUDA")


def test_a_failed_run_is_a_record(spark, tmp_path, monkeypatch):
    (tmp_path / "tiny.mtx").write_text(TINY)
    meta, coo = matrix_market.read(spark, str(tmp_path))
    monkeypatch.setattr(runner.spmv, "spmv_arrow", lambda *a: 1 / 0)
    rows = runner.single(spark, meta, coo, runner.Mode.CSR_CUDA, runs=1).collect()
    assert [(r.Time_s, r.MFLOPS, r.status) for r in rows] == [(None, -1.0, "E_RUN ZeroDivisionError")]


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "tiny.mtx").write_text(TINY)
    cli.main(["hll_openmp", str(tmp_path / "in"), "--threads", "2", "--hack", "junk", "--runs", "1", "--out", str(tmp_path / "out")])
    text = spark.read.text(str(tmp_path / "out")).collect()
    assert len(text) == 1 and text[0].value.startswith("[PERF] Format:HLL, Mode:OpenMP, Threads:2, BlockSize:-1, HackSize:32,")


def test_logs_are_written_by_name_and_read_back(spark, tmp_path):
    perf = perf_log.read(spark, write(tmp_path))
    perf_log.write_logs(perf, str(tmp_path / "logs"))
    again = perf_log.read(spark, str(tmp_path / "logs"), recursive=True)
    columns = ["Threads", "BlockSize", "HackSize", "Time_s", "MFLOPS", "NNZ", "Matrix", "Format", "Mode"]
    assert sorted(map(tuple, again.select(columns).collect())) == sorted(map(tuple, perf.select(columns).collect()))
    assert {r.file for r in again.select("file").distinct().collect()} == {"results_csr_serial.txt", "results_csr_openmp.txt", "results_csr_cuda.txt", "results_hll_openmp16.txt", "results_hll_cuda64.txt", "results_hll_openmp.txt"} - {"results_hll_openmp.txt"}


def test_best_configuration_is_one_aggregate(spark):
    rows = [("m", "CSR", 16, g, f, k) for k, (g, f) in enumerate([(1.0, "b"), (3.0, "c"), (3.0, "a"), (None, "a"), (0.0, "a")])] + [("n", "CSR", -1, None, "z", 9)]
    perf = spark.createDataFrame(rows, "Matrix string, Format string, HackSize int, GFLOPS double, file string, line_no int")
    best = pm.best_configuration(perf, ["file", "line_no"])
    assert best.columns == perf.columns and sorted(map(tuple, best.collect())) == [("m", "CSR", 16, 3.0, "a", 2), ("n", "CSR", -1, None, "z", 9)]
    assert "Window" not in best._jdf.queryExecution().executedPlan().toString()


def test_what_a_run_reads_is_made_before(spark, tmp_path):
    """With a source of half a second a row, no mode's time includes it; and both clocks run."""
    from pyspark.sql import functions as F

    (tmp_path / "tiny.mtx").write_text(TINY)
    meta, coo = matrix_market.read(spark, str(tmp_path))

    @F.udf("float")
    def slow(v):
        import time

        time.sleep(0.5)
        return v

    late = coo.withColumn("v", slow.asNondeterministic()("v"))
    for mode in (runner.Mode.CSR_SERIAL, runner.Mode.CSR_OPENMP, runner.Mode.CSR_CUDA):
        rows = runner.run(spark, meta, late, mode, threads=[1], blocks=[128], runs=2, clocks=runner.CLOCKS).collect()
        assert [r.clock for r in rows] == ["wall", "cpu"] and all(0 < r.Time_s < 2.9 for r in rows)


def test_forms_are_made_once_for_all_modes(spark, tmp_path, monkeypatch):
    (tmp_path / "tiny.mtx").write_text(TINY)
    meta, coo = matrix_market.read(spark, str(tmp_path))
    made = []
    for name in ("hll_blocks", "row_counts"):
        f = getattr(runner.formats, name)
        monkeypatch.setattr(runner.formats, name, lambda *a, f=f, name=name: made.append(name) or f(*a))
    with runner.Forms() as forms:
        found = [runner.run(spark, meta, coo, mode, [1], [128], 2, runs=1, forms=forms) for mode in (runner.Mode.HLL_OPENMP, runner.Mode.HLL_CUDA)]
    assert [r.status for df in found for r in df.collect()] == ["OK", "OK"]
    assert made.count("hll_blocks") == made.count("row_counts") == 1 and not forms.made


def test_a_serial_run_of_a_large_matrix_has_several_tasks(spark, tmp_path, monkeypatch):
    (tmp_path / "tiny.mtx").write_text(TINY)
    meta, coo = matrix_market.read(spark, str(tmp_path))
    monkeypatch.setattr(runner.partitioning, "SHARE", 2)
    seen, product = [], runner.spmv.spmv_coo
    monkeypatch.setattr(runner.spmv, "spmv_coo", lambda data, *a: seen.append(data.rdd.getNumPartitions()) or product(data, *a))
    rows = runner.single(spark, meta, coo.repartition(3), runner.Mode.CSR_SERIAL, runs=1).collect()
    assert [r.status for r in rows] == ["OK"] and seen == [3]


def test_the_parser_of_command_lines_is_made_once():
    assert cli.parser() is cli.parser()


def test_a_sweep_of_threads_places_the_items_once(spark, tmp_path, monkeypatch):
    (tmp_path / "tiny.mtx").write_text(TINY)
    meta, coo = matrix_market.read(spark, str(tmp_path))
    placed, groups_within = [], runner.partitioning.groups_within
    monkeypatch.setattr(runner.partitioning, "groups_within", lambda *a: placed.append(1) or groups_within(*a))
    rows = runner.run(spark, meta, coo, runner.Mode.CSR_OPENMP, [1, 2, 3], runs=1).collect()
    assert [(r.Threads, r.status) for r in rows] == [(1, "OK"), (2, "OK"), (3, "OK")] and len(placed) == 1


def test_a_suite_keeps_one_hack_size_and_leaves_no_tables(spark, tmp_path, monkeypatch):
    (tmp_path / "tiny.mtx").write_text(TINY)
    meta, coo = matrix_market.read(spark, str(tmp_path))
    before, forms, seen = set(tables._written), [], []
    enter, product = runner.Forms.__enter__, runner.spmv.spmv_blocks_arrow
    monkeypatch.setattr(runner.Forms, "__enter__", lambda self: forms.append(self) or enter(self))
    monkeypatch.setattr(runner.spmv, "spmv_blocks_arrow", lambda *a: seen.append([k[1:] for k in forms[0].made if "hll" in k]) or product(*a))
    found = runner.run_suite(spark, meta, coo, [2, 4], threads=[1], blocks=[128], runs=1)
    assert len(found) == 7 and seen == [[("hll", 2)], [("hll", 4)]]
    assert set(tables._written) == before and not forms[0].made


def test_tidy_queries_leave_no_shuffle_files(spark, tmp_path):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    setting = spark.conf.get(tables.CLEANUP)
    with tables.tidy_shuffles(spark):
        before = files()
        spark.range(1000).repartition(3).write.format("noop").mode("overwrite").save()
        assert files() <= before
    assert spark.conf.get(tables.CLEANUP) == setting
