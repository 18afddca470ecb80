"""Matrix Market coordinate files as validated relations.

A file is known by its whole path, which is its matrix in all relations; name
is its file name, which files in several folders may share. A file is taken as a whole or not at all: meta.status says OK or why not, and
coo has the entries of OK files only. Entries keep the file's order in pos; a
mirrored entry follows its original. Columns are not sorted, equal cells are
not merged and explicit zeros stay.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import schema
from weftline.functions.places import numbered
from weftline.functions.tables import cut
from weftline.sources.lines import read_lines

_INT = r"([+-]?\d+)"
_BANNER = r"^%%MatrixMarket\s*matrix\s*(\S+)\s+(\S+)\s+(\S+)"
_SIZE = rf"^\s*{_INT}\s+{_INT}\s+{_INT}"
_REAL = r"([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[+-]?(?i:inf(?:inity)?|nan))"
_ENTRY = {"pattern": rf"^\s*{_INT}\s+{_INT}", "integer": rf"^\s*{_INT}\s+{_INT}\s+{_INT}", "real": rf"^\s*{_INT}\s+{_INT}\s+{_REAL}"}
#: Tasks that write files at most.
FILES = 1 << 12
#: Field -> the type that a value is read as before it becomes a float.
FIELDS = {"real": "float", "integer": "int", "pattern": None}


def _group(pattern: str, n: int, kind: str) -> Column:
    return F.expr(f"try_cast(nullif(regexp_extract(value, r'{pattern}', {n}), '') as {kind})")


def _headers(lines: DataFrame, strict: bool) -> DataFrame:
    """One row per file: banner, size line and the status as far as these two decide it."""
    first = F.min(F.when((F.col("line_no") > 1) & ~F.col("value").rlike(r"^\s*(%|$)"), F.struct("line_no", "value")))
    heads = lines.groupBy("file").agg(F.max(F.when(F.col("line_no") == 1, F.col("value"))).alias("value"), first.alias("size"))
    for k, name in enumerate(("fmt", "field", "symmetry"), 1):
        heads = heads.withColumn(name, F.nullif(F.regexp_extract("value", _BANNER, k), F.lit("")))
    heads = heads.withColumn("value", F.col("size.value"))
    for k, (name, kind) in enumerate((("nrows", "int"), ("ncols", "int"), ("nnz_header", "bigint")), 1):
        heads = heads.withColumn(name, _group(_SIZE, k, kind))
    m, n, nnz = F.col("nrows"), F.col("ncols"), F.col("nnz_header")
    status = F.when(F.col("fmt").isNull(), "E_BANNER").when(F.col("fmt") != "coordinate", "E_FORMAT").when(~F.col("field").isin(*FIELDS), "E_FIELD")
    if strict:
        status = status.when(~F.col("symmetry").isin("general", "symmetric"), "E_SYMMETRY")
    status = status.when(F.col("size").isNull(), "E_NOSIZE").when(m.isNull() | n.isNull() | nnz.isNull(), "E_SIZE").when((m <= 0) | (n <= 0) | (nnz < 0), "E_DIMS")
    status = status.when((nnz > 0) & (F.col("symmetry") == "symmetric") & (m != n), "E_NOT_SQUARE")
    return heads.select(F.col("file").alias("matrix"), "fmt", "field", "symmetry", "nrows", "ncols", "nnz_header", F.col("size.line_no").alias("size_no"), status.alias("early"))


def parse(lines: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(meta, coo) of numbered lines (file, line_no, value).

    Only symmetric files are mirrored; skew-symmetric and hermitian ones are
    read like general ones, or with strict rejected as E_SYMMETRY. Numbers are
    read like scanf reads them: a prefix counts and the rest of a line is
    ignored, as are lines after the last entry. Lines are parsed once, into a
    table that both the status and the entries come from.
    """
    heads = cut(_headers(lines, strict))  # one row per file; its known size lets Spark choose the join
    entries = lines.select("file", "line_no", "value")
    body = entries.join(heads.where("early is null"), F.col("file") == F.col("matrix")).where((F.col("line_no") > F.col("size_no")) & (F.col("line_no") <= F.col("size_no") + F.col("nnz_header")))
    pattern = F.col("field") == "pattern"
    value = F.when(pattern, F.lit(1.0).cast("float")).when(F.col("field") == "integer", _group(_ENTRY["integer"], 3, "int").cast("float")).otherwise(_group(_ENTRY["real"], 3, "float"))
    read = cut(body.select("matrix", "symmetry", "nrows", "ncols", (F.col("line_no") - F.col("size_no") - 1).alias("p"), _group(_ENTRY["pattern"], 1, "int").alias("r"), _group(_ENTRY["pattern"], 2, "int").alias("c"), value.alias("v")))
    return judged(heads, read)


def judged(heads: DataFrame, read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(meta, coo) of headers and read entries (matrix, symmetry, nrows, ncols, p, r, c, v), both tables; null numbers could not be read."""
    inside = F.col("r").between(1, F.col("nrows")) & F.col("c").between(1, F.col("ncols"))
    fault = F.when(F.col("r").isNull() | F.col("c").isNull() | F.col("v").isNull(), "E_ENTRY").when(~inside, "E_OOB")
    found = read.groupBy("matrix").agg(F.count(F.lit(1)).alias("found"), F.min(F.when(fault.isNotNull(), F.struct("p", fault.alias("code")))).alias("bad"), F.sum((F.col("r") != F.col("c")).cast("long")).alias("off"))
    found = found.withColumnRenamed("matrix", "__m")
    late = F.when(F.col("bad").isNotNull(), F.col("bad.code")).when(F.coalesce("found", F.lit(0)) < F.col("nnz_header"), "E_TRUNCATED")
    status = F.coalesce("early", late, F.lit("OK"))
    extra = F.when(F.col("symmetry") == "symmetric", F.coalesce("off", F.lit(0))).otherwise(0)
    meta = heads.join(found, F.col("matrix") == F.col("__m"), "left").withColumn("status", status)
    meta = meta.select("matrix", F.substring_index("matrix", "/", -1).alias("name"), "fmt", "field", "symmetry", "nrows", "ncols", "nnz_header", F.when(F.col("status") == "OK", F.col("nnz_header") + extra).cast("long").alias("nnz"), "status")
    good = meta.where("status = 'OK'").select(F.col("matrix").alias("__ok"))
    coo = read.join(good, F.col("matrix") == F.col("__ok"), "left_semi")
    return meta, expand_symmetric(coo.select("matrix", "symmetry", "p", (F.col("r") - 1).alias("i"), (F.col("c") - 1).alias("j"), "v"))


def expand_symmetric(entries: DataFrame) -> DataFrame:
    """coo of entries (matrix, symmetry, p, i, j, v): in symmetric matrices, every entry off the diagonal is followed by its mirror."""

    def cell(i: str, j: str, turn: int) -> Column:
        return F.struct((F.col("p") * 2 + turn).cast("long").alias("pos"), F.col(i).alias("i"), F.col(j).alias("j"), F.col("v").alias("v"))

    both = (F.col("symmetry") == "symmetric") & (F.col("i") != F.col("j"))
    return entries.select("matrix", F.inline(F.when(both, F.array(cell("i", "j", 0), cell("j", "i", 1))).otherwise(F.array(cell("i", "j", 0)))))


def read(spark: SparkSession, path: str | list[str], strict: bool = False, recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """(meta, coo) of all *.mtx files in the given folders or files; missing paths and empty files have a status too."""
    there, listed, missing = [], set(), []
    for p in [path] if isinstance(path, str) else path:
        try:  # the driver's own listing; a scan leaves empty files out
            listed.update(spark.read.option("pathGlobFilter", "*.mtx").option("recursiveFileLookup", str(recursive).lower()).text(p).inputFiles())
            there.append(p)
        except AnalysisException:
            missing.append((p, p.rstrip("/").rsplit("/", 1)[-1], "E_OPEN"))
    lines = read_lines(spark, there, "*.mtx", recursive).select(F.regexp_replace("path", "^file:/+", "file:///").alias("file"), "line_no", "value") if there else spark.createDataFrame([], schema.LINES)
    meta, coo = parse(lines, strict)
    names = [(re.sub("^file:/+", "file:///", p), unquote(p.rsplit("/", 1)[-1])) for p in sorted(listed)]
    known = spark.createDataFrame(names, "__path string, __name string")
    known = known.join(meta, F.col("__path") == F.col("matrix"), "left")
    meta = known.select(*(F.col("__path").alias(c) if c == "matrix" else F.col("__name").alias(c) if c == "name" else F.coalesce("status", F.lit("E_EMPTY")).alias(c) if c == "status" else c for c in meta.columns))
    return meta.unionByName(spark.createDataFrame(missing, "matrix string, name string, status string"), allowMissingColumns=True), coo


def write(meta: DataFrame, coo: DataFrame, path: str) -> None:
    """The OK matrices as general *.mtx files under path, as write_lines() does."""
    write_lines(format_lines(meta, coo), path)


def write_lines(lines: DataFrame, path: str) -> None:
    """lines (matrix, line_no, value) as *.mtx files under path, one in each folder matrix=NAME. A file is written by one task, in the order of its lines; different ones side by side, up to FILES with a task each."""
    names = cut(numbered(lines.select(F.col("matrix").alias("__m")).distinct(), ["__m"], "__file"))
    files = max(1, min(names.count(), FILES))
    tasked = lines.join(names, F.col("matrix") == F.col("__m")).select("matrix", "line_no", "value", (F.col("__file") % files).cast("int").alias("__task"))
    dealt = tasked.repartitionById(files, "__task").sortWithinPartitions("matrix", "line_no").select("matrix", "value")
    plain = {"sep": "\u0001", "quote": "\u0000", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "extension": "mtx"}
    dealt.write.mode("overwrite").partitionBy("matrix").options(**plain).csv(path)


def format_lines(meta: DataFrame, coo: DataFrame) -> DataFrame:
    """(matrix, line_no, value): the text of general matrices, a sink for write.text per matrix.

    Lines are numbered by pos, whose numbers may have gaps.
    """
    head = meta.where("status = 'OK'")
    banner = head.select("matrix", F.lit(1).cast("long").alias("line_no"), F.format_string("%%%%MatrixMarket matrix coordinate %s general", F.when(F.col("field") == "integer", "integer").when(F.col("field") == "pattern", "pattern").otherwise("real")).alias("value"))
    size = head.select("matrix", F.lit(2).cast("long").alias("line_no"), F.concat_ws(" ", "nrows", "ncols", "nnz").alias("value"))
    kinds = head.select(F.col("matrix").alias("__m"), "field")
    number = F.when(F.col("field") == "integer", F.col("v").cast("int").cast("string")).when(F.col("field") == "pattern", F.lit(None)).otherwise(F.col("v").cast("string"))
    entry = coo.join(kinds, F.col("matrix") == F.col("__m")).select("matrix", (F.col("pos") + 3).alias("line_no"), F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, number).alias("value"))
    return banner.unionByName(size).unionByName(entry)
