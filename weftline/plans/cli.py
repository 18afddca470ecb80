"""python -m weftline.plans.cli MODE FOLDER [--threads N] [--block N] [--hack N] [--suite] [--out FOLDER]"""

from __future__ import annotations

import argparse
import functools

from pyspark.sql import SparkSession

from weftline.functions.scalars import option_block
from weftline.plans import runner
from weftline.sources import matrix_market, perf_log


def whole(text: str) -> int:
    """A number, 0 for anything else, like the defaults below are meant for."""
    try:
        return int(text)
    except ValueError:
        return 0


@functools.cache
def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftline", description="Time sparse matrix-vector products on Matrix Market files.")
    p.add_argument("mode", choices=[m.value for m in runner.Mode])
    p.add_argument("folder")
    p.add_argument("--threads", type=whole, default=0)
    p.add_argument("--block", type=whole, default=runner.DEFAULTS["block"])
    p.add_argument("--hack", type=whole, default=runner.DEFAULTS["hack"])
    p.add_argument("--runs", type=whole, default=runner.RUNS)
    p.add_argument("--suite", action="store_true", help="sweep all thread counts or block sizes")
    p.add_argument("--out", help="folder for the log lines; without, they are printed")
    return p


def options(argv: list[str] | None) -> dict:
    """The options of a command line, those out of range replaced by their defaults; 0 threads stands for the session's parallelism."""
    args = parser().parse_args(argv)
    return {
        "mode": args.mode, "folder": args.folder, "threads": max(args.threads, 0), "block": option_block(args.block), "hack": args.hack if args.hack > 0 else runner.DEFAULTS["hack"],
        "runs": args.runs if args.runs > 0 else runner.RUNS, "suite": args.suite, "out": args.out,
    }


def main(argv: list[str] | None = None) -> None:
    o = options(argv)
    spark = SparkSession.builder.appName("weftline").getOrCreate()
    meta, coo = matrix_market.read(spark, o["folder"])
    meta.select("matrix", "nrows", "ncols", "nnz", "status").show(100, truncate=False)
    mode, coo = runner.Mode(o["mode"]), coo.persist()
    if o["suite"]:
        perf = runner.run(spark, meta, coo, mode, hack=o["hack"], runs=o["runs"])
    else:
        perf = runner.single(spark, meta, coo, mode, o["threads"] or None, o["block"], o["hack"], o["runs"])
    lines = perf_log.format_lines(perf)
    if o["out"]:
        lines.write.mode("overwrite").text(o["out"])
    else:
        lines.show(1000, truncate=False)
    coo.unpersist()


if __name__ == "__main__":
    main()
