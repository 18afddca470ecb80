"""Scalar functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column | int) -> Column:
    """Whole quotient of non-negative integers, as a long; exact where a double would round."""
    b = b if isinstance(b, Column) else F.lit(b)
    a = a.cast("long")
    return ((a - a % b) / b).cast("long")


def ceil_div(a: Column, b: Column | int) -> Column:
    """Least integer not under a / b for non-negative integers; null for b = 0."""
    b = b if isinstance(b, Column) else F.lit(b)
    quotient = a - F.try_mod(a, b)
    return F.try_divide(quotient, b).cast("long") + F.when(F.try_mod(a, b) > 0, 1).otherwise(0)


def mflops(nnz: Column, seconds: Column, invalid: float = 0.0) -> Column:
    """Millions of floating-point operations a second of one product; invalid where there is no work or no time."""
    return F.when((nnz > 0) & (seconds > 1e-9), 2.0 * nnz / seconds / 1e6).otherwise(F.lit(invalid))


def gflops(mega: Column) -> Column:
    return mega / 1000


def grid_size(rows: Column, block: Column | int) -> Column:
    """Blocks of a launch with one worker per row."""
    return ceil_div(rows, block)


def launch_status(rows: Column, cols: Column, nnz: Column) -> Column:
    """What a kernel does with a matrix before it starts: nothing to do (y is all zeros and takes no time), wrong arguments, or a run."""
    return F.when(rows == 0, "EMPTY").when(cols <= 0, "E_ARGS").when(nnz == 0, "EMPTY").otherwise("RUN")


def launch_block(size: int) -> int:
    """A block size for a kernel: 1 to 1024, else 256."""
    return size if 1 <= size <= 1024 else 256


def option_block(size: int) -> int:
    """A block size from the command line: a power of two from 1 to 1024, else 256."""
    return size if 1 <= size <= 1024 and not size & (size - 1) else 256


def launch_blocks(size: Column) -> Column:
    """launch_block() of a column."""
    return F.when(size.between(1, 1024), size).otherwise(256)


def option_blocks(size: Column) -> Column:
    """option_block() of a column."""
    return F.when(size.between(1, 1024) & (size.bitwiseAND(size - 1) == 0), size).otherwise(256)
