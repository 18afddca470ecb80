"""Tables that cut lineage, and small text files, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []
_written: dict[str, SparkSession] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a folder of our own on a local master; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="weftline-"))
    return _own_dir[0]


def fresh_path(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted by release()."""
    path = f"{shared_dir(spark)}/weftline-{uuid.uuid4().hex}"
    _written[path] = spark
    if (scope := _scope.get()) is not None:
        scope.append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df as a table written once to the shared folder.

    A lost executor costs no recomputation of what stands above, and the
    reread table has sizes that let Spark choose its joins.
    """
    spark = df.sparkSession
    path = fresh_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def _hadoop(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, lines: list[str]) -> None:
    """A small text file under its own name, through Spark's file systems."""
    hadoop, fs = _hadoop(spark, path)
    out = fs.create(hadoop, True)
    out.write(bytearray("".join(f"{x}\n" for x in lines).encode()))
    out.close()


def append_text(spark: SparkSession, path: str, lines: list[str]) -> None:
    """Lines added to the end of a small text file; where the file system cannot append, the file is written anew."""
    hadoop, fs = _hadoop(spark, path)
    if not fs.exists(hadoop):
        return write_text(spark, path, lines)
    try:
        out = fs.append(hadoop)
    except Exception:
        return write_text(spark, path, [r[0] for r in spark.read.text(path).collect()] + lines)
    out.write(bytearray("".join(f"{x}\n" for x in lines).encode()))
    out.close()


def _delete(path: str) -> None:
    spark = _written.pop(path, None)
    with contextlib.suppress(Exception):  # the session may have ended
        hadoop, fs = _hadoop(spark, path)
        fs.delete(hadoop, True)


def release(*tables: DataFrame) -> None:
    """Delete the given tables of cut(), or without any all that is in the shared folder; what reads them is void afterwards."""
    for path in [_paths.pop(t) for t in tables] if tables else list(_written):
        _delete(path)


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables of cut() that are made within are deleted at its end, but for those given to the function it yields."""
    made, kept = [], set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(_paths[table])
        return table

    outer = _scope.set(made)
    try:
        yield keep
    finally:
        _scope.reset(outer)
        for path in made:
            if path not in kept:
                _delete(path)
            elif (scope := _scope.get()) is not None:
                scope.append(path)


@contextlib.contextmanager
def written() -> Iterator[list[str]]:
    """Paths of the tables of cut() that are made within, for delete()."""
    made = []
    outer = _scope.set(made)
    try:
        yield made
    finally:
        _scope.reset(outer)
        if (scope := _scope.get()) is not None:
            scope.extend(made)


def delete(paths: Iterable[str]) -> None:
    """Delete what stands at paths of fresh_path() and cut()."""
    for path in paths:
        _delete(path)


def is_cut(df: DataFrame) -> bool:
    """Whether df is a table of cut(), which costs no more to read again than any copy of it."""
    return df in _paths


#: Spark's own setting: the shuffle files of a query go when it ends, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries within leave no shuffle files behind. One that runs again shuffles again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


atexit.register(release)


def named(column: str) -> Column:
    """A column by its whole name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def carried(df: DataFrame, out: str = "row") -> Column:
    """All columns of df as one struct, so that no name of its own can clash with those beside it."""
    return F.struct(*(named(c).alias(c) for c in df.columns)).alias(out)
