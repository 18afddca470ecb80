"""Matrix Market files as a Spark data source: spark.read.format("matrixmarket").

A file's header is read once, when the read is planned; its body is read in
ranges of bytes, each a task, so one large file is read by many. A range has
the lines that begin in it. relations() makes of the rows what
matrix_market.read makes of text lines. Files are opened by pyarrow's file
systems, by path or URI.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weftline.functions.tables import cut
from weftline.sources import matrix_market as mm

#: Rows of a batch; bytes that are read at a time; bytes of a range, unless the option splitbytes says otherwise.
ROWS, READ, SPLIT = 1 << 16, 1 << 20, 64 << 20
HEADER = [("matrix", pa.string()), ("name", pa.string()), ("fmt", pa.string()), ("field", pa.string()), ("symmetry", pa.string()), ("nrows", pa.int32()), ("ncols", pa.int32()), ("nnz_header", pa.int64()), ("early", pa.string())]
ENTRY = [("split", pa.int32()), ("at", pa.int64()), ("r", pa.int32()), ("c", pa.int32()), ("v", pa.float32())]


@dataclass
class Split(InputPartition):
    uri: str
    head: dict
    number: int
    start: int
    stop: int


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def _whole(text: str | None, bits: int) -> int | None:
    value = int(text) if text else None
    return value if value is not None and -(1 << bits - 1) <= value < 1 << bits - 1 else None


def _lines(stream: pa.NativeFile, at: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines from at on, without their ends."""
    stream.seek(at)
    rest = b""
    while data := stream.read(READ):
        *done, rest = (rest + data).split(b"\n")
        for line in done:
            yield at, line.removesuffix(b"\r")
            at += len(line) + 1
    if rest:
        yield at, rest.removesuffix(b"\r")


def header(stream: pa.NativeFile) -> tuple[dict, int]:
    """A file's header, with the status as far as it decides it, and the offset behind the size line."""
    head = {k: None for k, _ in HEADER[2:]}
    found = _lines(stream, 0)
    first = next(found, None)
    if first is None:
        return head | {"early": "E_EMPTY"}, 0
    banner = re.match(mm._BANNER, first[1].decode(errors="replace"))
    if banner:
        head |= dict(zip(("fmt", "field", "symmetry"), banner.groups(), strict=True))
    size, behind = None, 0
    for at, line in found:
        if not re.match(rb"\s*(%|$)", line):
            size, behind = re.match(mm._SIZE, line.decode(errors="replace")), at + len(line) + 1
            break
    if size:
        head |= {"nrows": _whole(size[1], 32), "ncols": _whole(size[2], 32), "nnz_header": _whole(size[3], 64)}
    m, n, nnz = head["nrows"], head["ncols"], head["nnz_header"]
    faults = [
        ("E_BANNER", not banner), ("E_FORMAT", head["fmt"] != "coordinate"), ("E_FIELD", head["field"] not in mm.FIELDS), ("E_NOSIZE", not behind), ("E_SIZE", None in (m, n, nnz)),
        ("E_DIMS", None not in (m, n, nnz) and (m <= 0 or n <= 0 or nnz < 0)), ("E_NOT_SQUARE", bool(nnz) and head["symmetry"] == "symmetric" and m != n),
    ]
    return head | {"early": next((code for code, wrong in faults if wrong), None)}, behind


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.recursive, self.size = options["path"], options.get("recursive", "false") == "true", max(1, int(options.get("splitbytes", SPLIT)))

    def partitions(self) -> list[Split]:
        fs, root = _opened(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else [f for f in fs.get_file_info(pafs.FileSelector(root, recursive=self.recursive)) if f.is_file and f.base_name.endswith(".mtx") and not f.base_name.startswith((".", "_"))]
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
        splits = []
        for f in sorted(files, key=lambda f: f.path):
            with fs.open_input_file(f.path) as stream:
                head, behind = header(stream)
            starts = range(behind, max(f.size, behind + 1), self.size) if head["early"] is None else [behind]
            stop = f.size if head["early"] is None else behind
            splits += [Split(scheme + f.path, {"matrix": scheme + f.path, "name": f.base_name} | head, k, lo, min(lo + self.size, stop)) for k, lo in enumerate(starts)]
        return splits

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        head = split.head
        if split.number == 0:  # a row for the header, so that files without entries are seen
            yield _batch(head, split.number, [(-1, None, None, None)])
        if split.start >= split.stop:
            return
        entry = re.compile(mm._ENTRY[head["field"]])
        fs, path = _opened(split.uri)
        rows = []
        with fs.open_input_file(path) as stream:
            found = _lines(stream, max(split.start - 1, 0) if split.number else split.start)
            if split.number:
                next(found, None)  # the end of a line that begins before, be it the line end alone
            for k, (at, line) in enumerate(found):
                if at >= split.stop:
                    break
                rows.append((k, *_entry(entry, line.decode(errors="replace"), head["field"])))
                if len(rows) == ROWS:
                    yield _batch(head, split.number, rows)
                    rows = []
        if rows:
            yield _batch(head, split.number, rows)


def _entry(pattern: re.Pattern, line: str, field: str) -> tuple[int | None, int | None, float | None]:
    found = pattern.match(line)
    pair = found or re.match(mm._ENTRY["pattern"], line)
    r, c = (_whole(pair[1], 32), _whole(pair[2], 32)) if pair else (None, None)
    if field == "pattern" or not found:
        return r, c, 1.0 if field == "pattern" else None
    return r, c, float(found[3]) if field == "real" else _whole(found[3], 32)


def _batch(head: dict, split: int, rows: list[tuple]) -> pa.RecordBatch:
    same = [pa.array([head[k]] * len(rows), t) for k, t in HEADER]
    own = [pa.array([split] * len(rows), pa.int32()), *(pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), ENTRY[1:], strict=True))]
    return pa.RecordBatch.from_arrays([*same, *own], [k for k, _ in HEADER + ENTRY])


class MatrixMarketSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "matrixmarket"

    def schema(self) -> str:
        return "matrix string, name string, fmt string, field string, symmetry string, nrows int, ncols int, nnz_header bigint, early string, split int, at bigint, r int, c int, v float"

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def load(spark: SparkSession, path: str, recursive: bool = False, split: int = SPLIT) -> DataFrame:
    """The rows of all *.mtx files in a folder, or of one file: at counts the lines of a range of bytes from 0, and is -1 for the header alone."""
    spark.dataSource.register(MatrixMarketSource)
    return spark.read.format("matrixmarket").options(recursive=str(recursive).lower(), splitbytes=str(split)).load(path)


def relations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(meta, coo) of load()'s rows, like matrix_market.read's. A file is read once, into a table; the ranges' line counts say where each line stands."""
    rows = cut(rows)
    names = rows.where("at < 0").select(F.col("matrix").alias("__m"), F.col("name").alias("__name"))
    counts = rows.groupBy("matrix", "split").agg(F.count_if(F.col("at") >= 0).alias("n"))
    upto = Window.partitionBy("matrix").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("matrix").alias("__m"), F.col("split").alias("__s"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    placed = rows.where("at >= 0").join(before, (F.col("matrix") == F.col("__m")) & (F.col("split") == F.col("__s")))
    read = placed.select("matrix", "symmetry", "nrows", "ncols", "nnz_header", (F.col("before") + F.col("at")).alias("p"), "r", "c", "v").where("p < nnz_header").drop("nnz_header")
    heads = rows.where("at < 0").select("matrix", "fmt", "field", "symmetry", "nrows", "ncols", "nnz_header", "early")
    meta, coo = mm.judged(heads, read)
    named = meta.join(names, F.col("matrix") == F.col("__m"))
    return named.select(*(F.col("__name").alias(c) if c == "name" else c for c in meta.columns)), coo
