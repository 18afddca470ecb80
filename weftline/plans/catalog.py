"""Registered queries of the linear-algebra and benchmark operators, with their SQL.

Matrices come from the driver's tables: A1 is lineitem as orders x parts with
the quantity as value, A3 the embeddings as a dense matrix. Benchmark records
are made from events. The SQL is written for DuckDB.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import perf_metrics as pm
from weftline.functions import tables
from weftline.functions.places import numbered_within
from weftline.functions.scalars import grid_size, launch_blocks, launch_status, mflops, option_blocks
from weftline.operators import formats, partitioning, spmv
from weftline.plans import cli, report, runner
from weftline.sources import lines, matrix_market, mtx_source, perf_log

QUERIES = {}
ORACLES = {}


def query(sql: str):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- matrices --------------------------------------------------------------

#: A1's entries have no position; columns and values order a row.
ORDER = ["j", "v"]
COO = "coo as (select l_orderkey as i, l_partkey as j, cast(l_quantity as bigint) as v from lineitem)"
X = "x as (select p_partkey as j, cast(round(p_retailprice * 100) as bigint) as x from part)"
LEN = "len as (select o_orderkey as i, count(l_orderkey) as n from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey)"
IRP = LEN + ", irp as (select i, n, cast(sum(n) over (order by i) as bigint) - n as irp from len)"


def lineitem_coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.lit("A1").alias("matrix"), F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").cast("long").alias("v"))


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.lit("A1").alias("matrix"), F.col("o_orderkey").alias("i"))


def price_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.round(F.col("p_retailprice") * 100).cast("long").alias("val"))


def counts_a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.row_counts(lineitem_coo(spark, sf_dir), order_rows(spark, sf_dir))


def whole_y(df: DataFrame) -> DataFrame:
    """y of whole numbers, which a double holds exactly, as one."""
    return df.select("i", F.col("y").cast("long").alias("y"))


@query("select l_orderkey as i, l_partkey as j, cast(l_quantity as bigint) as v from lineitem")
def coo_entries(spark, sf_dir):
    return lineitem_coo(spark, sf_dir).select("i", "j", "v")


@query(f"with {LEN} select i, n from len")
def row_nnz(spark, sf_dir):
    return counts_a1(spark, sf_dir).select("i", "n")


@query(f"with {COO} select o_orderkey as i, coalesce(y, 0) as y from orders left join (select i, cast(sum(v) as bigint) as y from coo group by i) on i = o_orderkey")
def spmv_ones(spark, sf_dir):
    return whole_y(spmv.spmv_coo(lineitem_coo(spark, sf_dir), order_rows(spark, sf_dir)))


Y_SQL = f"with {COO}, {X} select o_orderkey as i, coalesce(y, 0) as y from orders left join (select i, cast(sum(v * x) as bigint) as y from coo join x on coo.j = x.j group by i) on i = o_orderkey"


@query(Y_SQL)
def spmv_x(spark, sf_dir):
    return whole_y(spmv.spmv_coo(lineitem_coo(spark, sf_dir), order_rows(spark, sf_dir), price_vector(spark, sf_dir)))


@query(Y_SQL)
def spmv_csr_rows(spark, sf_dir):
    return whole_y(spmv.spmv_csr(formats.csr_rows(lineitem_coo(spark, sf_dir), ORDER), order_rows(spark, sf_dir), price_vector(spark, sf_dir)))


@query(Y_SQL)
def spmv_arrow(spark, sf_dir):
    return whole_y(spmv.spmv_arrow(formats.csr_rows(lineitem_coo(spark, sf_dir), ORDER), order_rows(spark, sf_dir), price_vector(spark, sf_dir)))


@query(Y_SQL)
def spmv_balanced(spark, sf_dir):
    """Over seven partitions of equal numbers of rows and entries, each adding up what it owns."""
    return whole_y(spmv.spmv_owned(partitioning.distribute(lineitem_coo(spark, sf_dir), counts_a1(spark, sf_dir), 7), price_vector(spark, sf_dir)))


@query(
    f"""with {COO}, m as (select 'A' as matrix, i, j, v from coo union all select 'B', i, j, 2 * v from coo),
v as (select 'A' as matrix, p_partkey as j, p_partkey as x from part where p_partkey % 2 = 0 union all select 'B', p_partkey, 1 from part where p_partkey % 3 = 0),
s as (select m.matrix, i, cast(sum(v * x) as bigint) as y from m join v on m.matrix = v.matrix and m.j = v.j group by 1, 2)
select k.matrix, o_orderkey as i, coalesce(y, 0) as y from orders cross join (select unnest(['A', 'B']) as matrix) k left join s on s.matrix = k.matrix and s.i = o_orderkey"""
)
def spmv_keyed_vectors(spark, sf_dir):
    """Two matrices with a vector each, which lack half or two thirds of the columns."""
    coo, part = lineitem_coo(spark, sf_dir), table(spark, sf_dir, "part")
    both = coo.withColumn("matrix", F.lit("A")).unionByName(coo.withColumn("matrix", F.lit("B")).withColumn("v", F.col("v") * 2))
    rows = order_rows(spark, sf_dir).select(F.explode(F.array(F.lit("A"), F.lit("B"))).alias("matrix"), "i")
    x = part.where("p_partkey % 2 = 0").select(F.lit("A").alias("matrix"), F.col("p_partkey").alias("idx"), F.col("p_partkey").alias("val"))
    x = x.unionByName(part.where("p_partkey % 3 = 0").select(F.lit("B").alias("matrix"), F.col("p_partkey").alias("idx"), F.lit(1).cast("long").alias("val")))
    return spmv.spmv_arrow(formats.csr_rows(both, ORDER), rows, x).withColumn("y", F.col("y").cast("long"))


@query(
    f"""with {COO}, {X}, s as (select i, sum(v * x) as y from coo join x on coo.j = x.j group by i),
k as (select unnest(['CSR', 'HLL']) as form), b as (select unnest([128, 256, 512, 1024])::integer as block)
select form, block, (select count(*) from orders) as n, cast((select sum(y) from s) as bigint) as total, cast((select sum((i % 97) * y) from s) as bigint) as mixed from k, b"""
)
def kernel_block_sweep(spark, sf_dir):
    """Both kernels at every block size, as the number of rows and two sums of y."""
    coo, rows, x = lineitem_coo(spark, sf_dir), order_rows(spark, sf_dir), price_vector(spark, sf_dir)
    csr, blocks = tables.cut(formats.csr_rows(coo, ORDER)), tables.cut(formats.hll_blocks(coo, counts_a1(spark, sf_dir), 32, ORDER))
    out = None
    for b in runner.BLOCKS:
        for form, y in (("CSR", spmv.spmv_arrow(csr, rows, x, b)), ("HLL", spmv.spmv_blocks_arrow(blocks, rows, x, b))):
            one = whole_y(y).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("total"), F.sum(F.col("i") % 97 * F.col("y")).alias("mixed"))
            one = one.select(F.lit(form).alias("form"), F.lit(b).alias("block"), "n", "total", "mixed")
            out = one if out is None else out.unionByName(one)
    return out


@query(f"with {COO} select o_orderkey as i, coalesce(y, 0) as y from orders left join (select i, cast(sum(v) as bigint) as y from coo group by i) on i = o_orderkey")
def hll_spmv_owned(spark, sf_dir):
    """Padded blocks dealt to seven owners and added up where they are, x all ones."""
    blocks = formats.hll_blocks(lineitem_coo(spark, sf_dir), counts_a1(spark, sf_dir), 32, ORDER)
    return whole_y(spmv.spmv_blocks(partitioning.distribute_blocks(blocks, 7)))


@query(
    f"""with {COO}, y as (select o_orderkey as i, coalesce(y, 0) as y from orders left join (select i, sum(v) as y from coo group by i) on i = o_orderkey)
select i // 1000 as chunk, string_agg(printf('%.2f ', y::double), '' order by i) as text from y group by 1"""
)
def vector_print(spark, sf_dir):
    """y as printed text, a thousand elements to a line."""
    return spmv.vector_text(spmv.spmv_coo(lineitem_coo(spark, sf_dir), order_rows(spark, sf_dir)), 1000).select("chunk", "text")


@query(f"with {COO} select o_orderkey as i, cast(coalesce(y, 0) as bigint) as y from orders left join (select i, sum(v) as y from coo group by i) on i = o_orderkey")
def spmv_ordered_float(spark, sf_dir):
    return whole_y(spmv.spmv_ordered(lineitem_coo(spark, sf_dir), order_rows(spark, sf_dir), order=("j", "v")))


@query(f"with {COO} select o_orderkey as i, cast(0 as bigint) as y from orders where o_orderkey not in (select i from coo)")
def spmv_empty_rows(spark, sf_dir):
    return whole_y(spmv.spmv_coo(lineitem_coo(spark, sf_dir), order_rows(spark, sf_dir)).where("y = 0"))


@query("select vec_id as i, cast(sum(cast(round(cast(e as double) * 10000) as bigint) * p) as bigint) as y from (select vec_id, unnest(embedding) as e, generate_subscripts(embedding, 1) as p from embeddings) group by vec_id")
def spmv_dense(spark, sf_dir):
    cells = table(spark, sf_dir, "embeddings").select(F.lit("A3").alias("matrix"), F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "e"))
    coo = cells.select("matrix", "i", "j", F.round(F.col("e").cast("double") * 10000).cast("long").alias("v"))
    rows = table(spark, sf_dir, "embeddings").select(F.lit("A3").alias("matrix"), F.col("vec_id").alias("i"))
    x = spark.range(64).select(F.col("id").alias("idx"), (F.col("id") + 1).alias("val"))
    return whole_y(spmv.spmv_coo(coo, rows, x))


@query("select cast(p_partkey as integer) as idx, cast(1 as double) as val from part")
def vector_ones(spark, sf_dir):
    return spmv.ones(spark, table(spark, sf_dir, "part").count())


DENSE = f"""{COO}, dn as (select i, j, v from coo union all select 0, l_partkey, cast(l_quantity as bigint) from lineitem)"""
DENSE_Y = f"with {DENSE}, {X} select o_orderkey as i, coalesce(y, 0) as y from orders left join (select i, cast(sum(v * x) as bigint) as y from dn join x on dn.j = x.j group by i) on i = o_orderkey"


def dense_coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem's matrix, and all its entries once more in row 0, which holds half of all then."""
    coo = lineitem_coo(spark, sf_dir)
    return coo.unionByName(coo.withColumn("i", F.lit(0).cast(coo.schema["i"].dataType)))


@query(DENSE_Y)
def spmv_split_rows(spark, sf_dir):
    """A row with half of all entries, over several owners, whose partial sums are carried out."""
    counts = formats.row_counts(dense_coo(spark, sf_dir), order_rows(spark, sf_dir))
    return whole_y(spmv.spmv_owned(partitioning.distribute(dense_coo(spark, sf_dir), counts, 7), price_vector(spark, sf_dir)))


@query(f"with {DENSE}, c as (select (select count(*) from dn) + (select count(*) from orders) as n) select t::integer as owner, greatest(least((t + 1) * ((n + 6) // 7), n) - t * ((n + 6) // 7), 0) as items from c, (select unnest(range(7)) as t)")
def split_row_loads(spark, sf_dir):
    """Rows and entries of each owner of that matrix."""
    counts = formats.row_counts(dense_coo(spark, sf_dir), order_rows(spark, sf_dir))
    return partitioning.distribute(dense_coo(spark, sf_dir), counts, 7).groupBy("owner").agg(F.count(F.lit(1)).alias("items"))


@query(DENSE_Y)
def spmv_tiled(spark, sf_dir):
    """That matrix in tiles."""
    return whole_y(spmv.spmv_tiled(dense_coo(spark, sf_dir), order_rows(spark, sf_dir), price_vector(spark, sf_dir)))


@query(f"with {DENSE} select row_number() over (order by i, j, v) - 1 as k, i, j as ja, v as a from dn")
def csr_entries_dense(spark, sf_dir):
    return formats.csr_entries(dense_coo(spark, sf_dir), ORDER).select("k", "i", "ja", "a")


@query(f"""with {COO}, len as (select o_orderkey as i, count(j) as n from orders left join coo on i = o_orderkey group by o_orderkey), w as (select count(*) as nr, max(n) as k from len),
en as (select i, j, v, row_number() over (partition by i order by j, v) - 1 as slot from coo), lst as (select i, max(j) as lc from coo group by i)
select s * nr + len.i as flat, len.i as i, coalesce(en.j, lc, 0) as ja, coalesce(en.v, 0) as a from len, w, unnest(range(0, k)) u(s) left join en on en.i = len.i and en.slot = s left join lst on lst.i = len.i""")
def hll_one_block(spark, sf_dir):
    """All rows in one block of 2^20, or of all rows if they are more, from its arrays."""
    rows = (table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0] or 0) + 1
    blocks = formats.hll_blocks(lineitem_coo(spark, sf_dir), counts_a1(spark, sf_dir), max(1 << 20, rows), ORDER)
    return formats.block_cells(blocks).select("flat", "i", "ja", "a")


@query(f"with {IRP} select count(*) filter (irp < 1000) as at from (select irp from irp union all select sum(n) from len)")
def ptr_stored_lower_bound(spark, sf_dir):
    """The search in stored pointers."""
    path = tables.fresh_path(spark)
    partitioning.store_pointers(formats.csr_ptr(counts_a1(spark, sf_dir)), path, 1 << 10)
    return partitioning.stored_lower_bound(spark, path, 1000).select("at")


# --- Matrix Market ---------------------------------------------------------


def _entry_lines(spark: SparkSession, sf_dir: str, field: str, value: Column | None) -> DataFrame:
    """Lines of eight general files, the orders dealt by their key."""
    li = table(spark, sf_dir, "lineitem")
    file = F.format_string("m%d.mtx", F.col("l_orderkey") % 8)
    parts = [F.col("l_orderkey") + 1, F.col("l_partkey") + 1] + ([] if value is None else [value])
    placed = numbered_within(li.select(file.alias("file"), "l_orderkey", "l_partkey", "l_quantity"), ["file"], ["l_orderkey", "l_partkey", "l_quantity"], "at")
    body = placed.select("file", (F.col("at") + 3).alias("line_no"), F.concat_ws(" ", *parts).alias("value"))
    sizes = body.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    dims = [table(spark, sf_dir, t).count() for t in ("orders", "part")]
    size = sizes.select("file", F.lit(2).cast("long").alias("line_no"), F.concat_ws(" ", F.lit(dims[0]), F.lit(dims[1]), "n").alias("value"))
    banner = sizes.select("file", F.lit(1).cast("long").alias("line_no"), F.lit(f"%%MatrixMarket matrix coordinate {field} general").alias("value"))
    return body.unionByName(size).unionByName(banner)


def _parsed(spark: SparkSession, sf_dir: str, field: str, value: Column | None) -> DataFrame:
    _, coo = matrix_market.parse(_entry_lines(spark, sf_dir, field, value))
    return coo.select("matrix", "pos", "i", "j", F.col("v").cast("double").alias("v"))


def _parsed_sql(value: str) -> str:
    return f"select 'm' || (l_orderkey % 8) || '.mtx' as matrix, (row_number() over (partition by l_orderkey % 8 order by l_orderkey, l_partkey, l_quantity) - 1) * 2 as pos, cast(l_orderkey as integer) as i, cast(l_partkey as integer) as j, cast({value} as double) as v from lineitem"


@query(_parsed_sql("l_quantity + 0.25"))
def mm_parse_real(spark, sf_dir):
    return _parsed(spark, sf_dir, "real", F.concat(F.col("l_quantity").cast("int"), F.lit(".25")))


@query(_parsed_sql("l_quantity"))
def mm_parse_integer(spark, sf_dir):
    return _parsed(spark, sf_dir, "integer", F.concat(F.col("l_quantity").cast("int"), F.lit(".75 tail")))


@query(_parsed_sql("1"))
def mm_parse_pattern(spark, sf_dir):
    return _parsed(spark, sf_dir, "pattern", None)


@query(
    """with e as (select l_partkey as i, l_suppkey as j, l_quantity as v, row_number() over (order by l_partkey, l_suppkey, l_quantity) - 1 as p from lineitem where l_partkey >= l_suppkey)
select p * 2 as pos, cast(i as integer) as i, cast(j as integer) as j, cast(v as double) as v from e
union all select p * 2 + 1, cast(j as integer), cast(i as integer), cast(v as double) from e where i <> j"""
)
def mm_symmetric(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").where("l_partkey >= l_suppkey")
    coo = e.select(F.lit("s").alias("matrix"), F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j"), F.col("l_quantity").alias("v"))
    placed = formats.csr_entries(coo, ORDER)
    body = placed.select(F.lit("s.mtx").alias("file"), (F.col("k") + 3).alias("line_no"), F.concat_ws(" ", F.col("i") + 1, F.col("ja") + 1, "a").alias("value"))
    n = table(spark, sf_dir, "part").count()
    head = body.agg(F.count(F.lit(1)).alias("n")).select(F.lit("s.mtx").alias("file"), F.inline(F.array(F.struct(F.lit(1).cast("long").alias("line_no"), F.lit("%%MatrixMarket matrix coordinate real symmetric").alias("value")), F.struct(F.lit(2).cast("long").alias("line_no"), F.concat_ws(" ", F.lit(n), F.lit(n), "n").alias("value")))))
    _, coo = matrix_market.parse(body.unionByName(head))
    return coo.select("pos", "i", "j", F.col("v").cast("double").alias("v"))


_GENERAL = "%%MatrixMarket matrix coordinate real general"
#: Name -> status, non-zeros and text of small files.
FILES = {
    "ok": ("OK", 2, [_GENERAL, "% note", "", "2 2 2", "1 1 1", "2 2 2.5 tail"]),
    "ok_empty": ("OK", 0, [_GENERAL, "3 3 0"]),
    "ok_trailing": ("OK", 1, [_GENERAL, "2 2 1 extra", "1 2 .5e1", "2 2 7"]),
    "ok_skew": ("OK", 1, ["%%MatrixMarket matrix coordinate real skew-symmetric", "2 2 1", "2 1 3"]),
    "ok_symmetric": ("OK", 6, ["%%MatrixMarket matrix coordinate real symmetric", "3 3 4", "1 1 2", "2 1 -1", "3 2 5", "3 3 4"]),
    "ok_oblong_empty": ("OK", 0, ["%%MatrixMarket matrix coordinate real symmetric", "2 3 0"]),
    "banner_short": ("E_BANNER", None, ["%%MatrixMarket matrix coordinate real", "1 1 1", "1 1 1"]),
    "banner_case": ("E_BANNER", None, ["%%matrixmarket matrix coordinate real general", "1 1 1", "1 1 1"]),
    "format": ("E_FORMAT", None, ["%%MatrixMarket matrix array real general", "1 1", "1"]),
    "field": ("E_FIELD", None, ["%%MatrixMarket matrix coordinate complex general", "1 1 1", "1 1 1 1"]),
    "no_size": ("E_NOSIZE", None, [_GENERAL, "% only a note"]),
    "size": ("E_SIZE", None, [_GENERAL, "3 3"]),
    "dims": ("E_DIMS", None, [_GENERAL, "0 3 1", "1 1 1"]),
    "not_square": ("E_NOT_SQUARE", None, ["%%MatrixMarket matrix coordinate real symmetric", "2 3 1", "1 1 1"]),
    "truncated": ("E_TRUNCATED", None, [_GENERAL, "2 2 2", "1 1 1"]),
    "blank_entry": ("E_ENTRY", None, [_GENERAL, "2 2 2", "1 1 1", "", "2 2 1"]),
    "no_value": ("E_ENTRY", None, [_GENERAL, "2 2 1", "1 1"]),
    "low_row": ("E_OOB", None, [_GENERAL, "2 2 1", "0 1 1"]),
    "high_column": ("E_OOB", None, [_GENERAL, "2 2 1", "1 3 1"]),
}


#: What is wrong with the files of lineitem, dealt over matrices by their number: status, and how much nnz differs from the entries.
KINDS = ["OK", "E_BANNER", "E_BANNER", "E_FORMAT", "E_FIELD", "E_SIZE", "E_DIMS", "E_NOT_SQUARE", "E_TRUNCATED", "E_ENTRY", "E_OOB", "E_OOB", "E_NOSIZE", "OK"]
MATRICES = 2 * len(KINDS)


def _faulty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(matrix, line_no, value): lineitem as MATRICES files, each with the fault of its kind."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % MATRICES).cast("int").alias("m"), "l_orderkey", "l_partkey", "l_quantity")
    kind = (F.col("m") % len(KINDS)).cast("int")
    orders, parts = (table(spark, sf_dir, t).count() for t in ("orders", "part"))
    name = F.format_string("m%d", "m").alias("matrix")
    sizes = li.groupBy("m").agg(F.count(F.lit(1)).alias("n"))
    entry = numbered_within(li, ["m"], ["l_orderkey", "l_partkey", "l_quantity"], "at", "n").withColumn("at", F.col("at") + 1)
    row = F.when((kind == 10) & (F.col("at") == 1), 0).otherwise(F.col("l_orderkey") + 1)
    column = F.when((kind == 11) & (F.col("at") == F.col("n")), parts + 1).otherwise(F.col("l_partkey") + 1)
    value = F.when((kind == 9) & (F.col("at") == 1), F.lit(None)).otherwise(F.col("l_quantity").cast("int").cast("string"))
    text = F.concat_ws(" ", row, column, value)
    body = entry.select(name, (F.col("at") + 3).alias("line_no"), F.when(kind == 12, F.concat(F.lit("% "), text)).otherwise(text).alias("value"))
    banner = F.when(kind == 1, "%%MatrixMarket matrix coordinate real").when(kind == 2, "%%matrixmarket matrix coordinate real general").when(kind == 3, "%%MatrixMarket matrix array real general").when(kind == 4, "%%MatrixMarket matrix coordinate complex general").when(kind == 7, "%%MatrixMarket matrix coordinate real symmetric").otherwise("%%MatrixMarket matrix coordinate real general")
    head = sizes.select(name, F.lit(1).cast("long").alias("line_no"), banner.alias("value")).unionByName(sizes.select(name, F.lit(2).cast("long").alias("line_no"), F.lit("% made of lineitem").alias("value")))
    nnz = F.when(kind == 8, F.col("n") + 1).when(kind == 13, F.col("n") - 1).otherwise(F.col("n"))
    size = F.concat_ws(" ", F.when(kind == 6, 0).otherwise(orders), F.lit(parts), F.when(kind == 5, F.lit(None)).otherwise(nnz))
    return body.unionByName(head).unionByName(sizes.where(kind != 12).select(name, F.lit(3).cast("long").alias("line_no"), size.alias("value")))


FAULTY = f"""ln as (
  select l_orderkey % {MATRICES} as m, l_orderkey, l_partkey, l_quantity, row_number() over (partition by l_orderkey % {MATRICES} order by l_orderkey, l_partkey, l_quantity) as nth from lineitem),
sz as (select m, m % {len(KINDS)} as kind, count(*) as n from ln group by m),
st as (select 'm' || m as matrix, m, kind, n, {KINDS}[kind + 1] as status, case when kind = 13 then n - 1 when kind = 0 then n end as nnz from sz)"""


@query(f"with {FAULTY} select matrix, status, nnz from st")
def mm_reject(spark, sf_dir):
    return matrix_market.parse(_faulty_lines(spark, sf_dir).withColumnRenamed("matrix", "file"))[0].select("matrix", "status", "nnz")


def _of_folder(path: str) -> Column:
    """The matrix that a file of write_lines() holds."""
    return F.regexp_extract(path, "matrix=([^/]+)", 1)


def _written_lines(spark: SparkSession, sf_dir: str) -> str:
    path = tables.fresh_path(spark)
    matrix_market.write_lines(_faulty_lines(spark, sf_dir), path)
    return path


@query(f"with {FAULTY} select matrix, status, nnz from st union all select 'missing.mtx', 'E_OPEN', null")
def mm_scan(spark, sf_dir):
    """Files of lineitem written to a folder and read from it, and one that is missing."""
    path = _written_lines(spark, sf_dir)
    meta, _ = matrix_market.read(spark, [path, f"{path}/missing.mtx"], recursive=True)
    return meta.select(F.when(F.col("status") == "E_OPEN", F.col("name")).otherwise(_of_folder("matrix")).alias("matrix"), "status", "nnz")


@query(f"""with {FAULTY} select matrix, (nth - 1) * 2 as pos, l_orderkey::integer as i, l_partkey::integer as j, l_quantity::double as v from ln join st using (m) where status = 'OK' and nth <= nnz""")
def mm_source(spark, sf_dir):
    """The entries of these files by the data source, in ranges of 64 KB."""
    rows = mtx_source.load(spark, _written_lines(spark, sf_dir), recursive=True, split=1 << 16)
    coo = mtx_source.relations(rows)[1]
    return coo.select(_of_folder("matrix").alias("matrix"), "pos", "i", "j", F.col("v").cast("double").alias("v"))


@query(f"""with {FAULTY} select matrix, nth + 3 as line_no, length(case when kind = 12 then '% ' else '' end) + length((l_orderkey + 1)::varchar) + length((l_partkey + 1)::varchar) + length(l_quantity::integer::varchar) + 2 as chars from ln join st using (m) where kind not in (9, 10, 11, 12)""")
def text_lines(spark, sf_dir):
    """The numbered lines of these files, by their lengths."""
    found = lines.read_lines(spark, _written_lines(spark, sf_dir), "*.mtx", recursive=True).withColumn("matrix", _of_folder("path"))
    kind = F.substring("matrix", 2, 9).cast("int") % len(KINDS)
    return found.where((F.col("line_no") > 3) & ~kind.isin(9, 10, 11, 12)).select("matrix", "line_no", F.length("value").cast("long").alias("chars"))


# --- runs ------------------------------------------------------------------

THREADS, RUN_BLOCKS = (1, 3), (1024,)


def _run_matrices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(meta, coo) of lineitem, and of an empty matrix of as many rows."""
    coo = tables.cut(lineitem_coo(spark, sf_dir).withColumn("pos", F.col("j").cast("long") * 64 + F.col("v")))
    sizes = [table(spark, sf_dir, t).agg((F.max(c) + 1).cast("int")).first()[0] for t, c in (("orders", "o_orderkey"), ("part", "p_partkey"))]
    nnz = coo.count()
    meta = spark.createDataFrame([("A1", *sizes, nnz, "OK"), ("none", sizes[0], sizes[1], 0, "OK"), ("broken", None, None, None, "E_SIZE")], "matrix string, nrows int, ncols int, nnz long, status string")
    return meta, coo


def _run_records() -> list[tuple]:
    """Format, mode, threads, block size and hack size of every configuration."""
    made = [("CSR", "SerialRef", -1, -1, -1)]
    for fmt, hack in (("CSR", -1), ("HLL", 32)):
        made += [(fmt, "OpenMP", t, -1, hack) for t in THREADS] + [(fmt, "CUDA", -1, b, hack) for b in RUN_BLOCKS]
    return made


RUN_COLUMNS = ["Format", "Mode", "Threads", "BlockSize", "HackSize", "NNZ", "Matrix", "status", "clock", "timed"]


@query("select \"Format\", \"Mode\", \"Threads\"::integer as \"Threads\", \"BlockSize\"::integer as \"BlockSize\", \"HackSize\"::integer as \"HackSize\", \"NNZ\", \"Matrix\", 'OK' as status, clock, \"NNZ\" > 0 or \"Mode\" <> 'CUDA' as timed from (values " + ", ".join(str(r) for r in _run_records()) + ") as t(\"Format\", \"Mode\", \"Threads\", \"BlockSize\", \"HackSize\"), (select count(*) as \"NNZ\", 'A1' as \"Matrix\" from lineitem union all select 0, 'none'), (select unnest(['wall', 'cpu']) as clock)")
def runner_records(spark, sf_dir):
    """Runs of every mode on the matrix of lineitem and on an empty one, by both clocks; timed says whether a time was taken."""
    meta, coo = _run_matrices(spark, sf_dir)
    out = None
    with runner.Forms() as forms:
        for mode in runner.Mode:
            one = runner.run(spark, meta, coo, mode, THREADS, RUN_BLOCKS, 32, runs=1, clocks=runner.CLOCKS, forms=forms)
            one = one.withColumn("timed", F.coalesce(F.col("Time_s") > 0, F.lit(False))).select(*RUN_COLUMNS)
            out = one if out is None else out.unionByName(one)
    tables.release(coo)
    return out


@query("select 'csr_serial' as chosen, 'SerialRef' as \"Mode\", count(*) as \"NNZ\", 1::bigint as records from lineitem union all select 'hll_openmp', 'OpenMP', count(*), 1 from lineitem")
def runner_single(spark, sf_dir):
    """One configuration of two modes on the matrix of lineitem."""
    meta, coo = _run_matrices(spark, sf_dir)
    out = None
    for mode in (runner.Mode.CSR_SERIAL, runner.Mode.HLL_OPENMP):
        one = runner.single(spark, meta.where("nnz > 0"), coo, mode, threads=2, runs=1).where("Time_s > 0 and MFLOPS > 0 and status = 'OK'")
        one = one.groupBy("Mode", "NNZ").agg(F.count(F.lit(1)).alias("records")).select(F.lit(mode.value).alias("chosen"), "Mode", "NNZ", "records")
        out = one if out is None else out.unionByName(one)
    tables.release(coo)
    return out


_SUITES = ["csr_serial", "csr_openmp", "csr_cuda", *(f"hll_{k}{h}" for k in ("openmp", "cuda") for h in (16, 32, 64))]


@query("select * from (values " + ", ".join(f"('{runner.LOG}', 'results_{n}.txt: completed', 1::bigint), ('results_{n}.txt', '[PERF]', {c}::bigint)" for n, c in ((n, 1) for n in _SUITES)) + ") as t(file, text, n)")
def suite_logs(spark, sf_dir):
    """What a run of all suites on the matrix of lineitem writes to its dated folder: records by log, and the master log's completed suites."""
    meta, coo = _run_matrices(spark, sf_dir)
    path = runner.run_folder(tables.fresh_path(spark), datetime(2024, 1, 2, 3, 4, 5))
    if not path.endswith("/benchmark_results_20240102_030405"):
        raise ValueError(path)
    runner.run_suite(spark, meta.where("nnz > 0"), coo, threads=[2], blocks=[256], runs=1, out=path)
    tables.release(coo)
    found = lines.read_lines(spark, path).withColumn("text", F.when(F.col("file") == runner.LOG, F.col("value")).otherwise(F.substring("value", 1, 6)))
    return found.where("text like '%: completed' or file <> 'master_execution_log.txt'").groupBy("file", "text").agg(F.count(F.lit(1)).alias("n"))


@query("""select c_custkey, mode, (case when mode like '%cuda' then 0 else greatest(t, 0) end)::integer as threads,
  (case when mode like '%cuda' and t between 1 and 1024 and t & (t - 1) = 0 then t else 256 end)::integer as block, (case when h > 0 then h else 32 end)::integer as hack, (case when h > 0 then h else 10 end)::integer as runs
from (select c_custkey, ['csr_serial', 'csr_openmp', 'csr_cuda', 'hll_openmp', 'hll_cuda'][c_custkey % 5 + 1] as mode, c_custkey % 1100 - 20 as t, c_nationkey - 3 as h from customer)""")
def command_lines(spark, sf_dir):
    """The options of a command line for each customer, numbers out of range among them."""
    mode = F.element_at(F.array(*(F.lit(m.value) for m in runner.Mode)), (F.col("c_custkey") % 5 + 1).cast("int"))
    number = (F.col("c_custkey") % 1100 - 20).cast("int")
    option = F.when(mode.endswith("cuda"), F.lit("--block")).otherwise("--threads")
    text = F.concat_ws(" ", mode, F.lit("in"), option, number, F.lit("--hack"), F.col("c_nationkey") - 3, F.lit("--runs"), F.col("c_nationkey") - 3)
    kind = "mode string, threads int, block int, hack int, runs int"

    def parse(line: str) -> tuple:
        found = cli.options(line.split())
        return tuple(found[k] for k in ("mode", "threads", "block", "hack", "runs"))

    parsed = F.udf(parse, kind)
    dealt = table(spark, sf_dir, "customer").repartition(spark.sparkContext.defaultParallelism, "c_custkey")  # a small file is one task, whatever a row costs
    return dealt.select("c_custkey", parsed(text).alias("o")).select("c_custkey", "o.*")


@query(
    "select n::integer as size, (case when n between 1 and 1024 then n else 256 end)::integer as launch, (case when n between 1 and 1024 and n & (n - 1) = 0 then n else 256 end)::integer as option, n > 0 as hack_ok, count(*) as orders "
    "from (select o_orderkey % 2100 - 20 as n from orders) group by n"
)
def size_checks(spark, sf_dir):
    """Numbers of orders as block sizes of a launch and of the command line, and whether they can be hack sizes."""
    size = (F.col("o_orderkey") % 2100 - 20).cast("int")
    checked = table(spark, sf_dir, "orders").select(size.alias("size"), launch_blocks(size).cast("int").alias("launch"), option_blocks(size).cast("int").alias("option"), (size > 0).alias("hack_ok"))
    return checked.groupBy("size", "launch", "option", "hack_ok").agg(F.count(F.lit(1)).alias("orders"))


@query("select r::bigint as rows, c::bigint as cols, nnz, case when r = 0 then 'EMPTY' when c <= 0 then 'E_ARGS' when nnz = 0 then 'EMPTY' else 'RUN' end as status, count(*) as suppliers from (select s_suppkey % 3 as r, s_nationkey % 4 - 1 as c, count(l_orderkey) as nnz from supplier left join lineitem on l_suppkey = s_suppkey and l_quantity > 49 group by s_suppkey, s_nationkey) group by all")
def kernel_arguments(spark, sf_dir):
    """What a kernel does with a matrix for each supplier, of the rows and columns that its keys say and the entries of its large items."""
    li = table(spark, sf_dir, "lineitem").where("l_quantity > 49").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    s = table(spark, sf_dir, "supplier").join(li, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    sizes = s.select((F.col("s_suppkey") % 3).cast("long").alias("rows"), (F.col("s_nationkey") % 4 - 1).cast("long").alias("cols"), F.coalesce("n", F.lit(0)).cast("long").alias("nnz"))
    return sizes.groupBy("rows", "cols", "nnz", launch_status(F.col("rows"), F.col("cols"), F.col("nnz")).alias("status")).agg(F.count(F.lit(1)).alias("suppliers"))


# --- compressed rows and padded blocks -------------------------------------


@query(f"with {IRP} select i, irp from irp union all select count(*), cast(sum(n) as bigint) from len")
def csr_row_ptr(spark, sf_dir):
    return formats.csr_ptr(counts_a1(spark, sf_dir)).select("i", "irp")


@query(f"with {COO} select row_number() over (order by i, j, v) - 1 as k, i, j as ja, v as a from coo")
def csr_entries(spark, sf_dir):
    return formats.csr_entries(lineitem_coo(spark, sf_dir), ORDER).select("k", "i", "ja", "a")


@query(f"with {LEN} select min(n) as min_nnz, max(n) as max_nnz, round(avg(n), 6) as avg_nnz, count(*) filter (n = 0) as empty_rows from len")
def csr_width_stats(spark, sf_dir):
    return formats.width_stats(counts_a1(spark, sf_dir)).select("min_nnz", "max_nnz", F.round("avg_nnz", 6).alias("avg_nnz"), "empty_rows")


@query(f"with {LEN} select max(n) as k from len where i >= 100 and i < 400")
def max_nz_in_range(spark, sf_dir):
    return formats.max_row_nnz(counts_a1(spark, sf_dir), 100, 400).select("k")


def _hb(hack: int) -> str:
    return f"hb as (select i // {hack} as block, count(*) as nr, max(n) as k from len group by 1)"


def _blocks(hack: int):
    def hll_blocks(spark, sf_dir):
        return formats.hll_meta(counts_a1(spark, sf_dir), hack).select("block", "nr", "k", "cells")

    hll_blocks.__name__ = f"hll_blocks_{hack}"
    return query(f"with {LEN}, {_hb(hack)} select block, nr, k, nr * k as cells from hb")(hll_blocks)


for _hack in (16, 32, 64):
    _blocks(_hack)

CELLS = f"""{LEN}, {COO}, {_hb(32)},
en as (select i, j, v, row_number() over (partition by i order by j, v) - 1 as slot from coo),
lst as (select i, max(j) as lc from coo group by i),
grid as (select block, nr, r, s from hb, unnest(range(0, nr)) t(r), unnest(range(0, k)) u(s)),
cells as (select grid.block, s * nr + r as flat, grid.block * 32 + r as i, coalesce(en.j, lst.lc, 0) as ja, coalesce(en.v, 0) as a
  from grid left join en on en.i = grid.block * 32 + r and en.slot = s left join lst on lst.i = grid.block * 32 + r)"""


@query(f"with {CELLS} select block, flat, ja, a from cells")
def hll_cells_32(spark, sf_dir):
    return formats.hll_cells(lineitem_coo(spark, sf_dir), counts_a1(spark, sf_dir), 32, ORDER).select("block", "flat", "ja", "a")


@query(f"with {CELLS} select block, flat, i, ja, a from cells")
def hll_block_arrays_32(spark, sf_dir):
    return formats.block_cells(formats.hll_blocks(lineitem_coo(spark, sf_dir), counts_a1(spark, sf_dir), 32, ORDER)).select("block", "flat", "i", "ja", "a")


@query(f"with {LEN}, {_hb(32)} select block, nr * k as cells, cast(sum(nr * k) over (order by block) as bigint) - nr * k as start_offset from hb")
def hll_offsets(spark, sf_dir):
    return formats.hll_offsets(formats.hll_meta(counts_a1(spark, sf_dir), 32)).select("block", "cells", "start_offset")


@query(f"with {LEN}, {_hb(32)} select cast((select sum(n) from len) as bigint) as nnz, cast(sum(nr * k) as bigint) as cells, round(1 - (select sum(n) from len) / sum(nr * k), 6) as padding from hb")
def hll_padding_ratio(spark, sf_dir):
    return formats.padding_ratio(counts_a1(spark, sf_dir), 32).select("nnz", "cells", F.round("padding", 6).alias("padding"))


@query(Y_SQL)
def hll_spmv_32(spark, sf_dir):
    cells = formats.hll_cells(lineitem_coo(spark, sf_dir), counts_a1(spark, sf_dir), 32, ORDER)
    return whole_y(spmv.spmv_hll(cells, order_rows(spark, sf_dir), price_vector(spark, sf_dir)))


# --- partitioning ----------------------------------------------------------


def _owner(t: int | str) -> str:
    return f"least(irp, g.nnz - 1) // ((g.nnz + {t} - 1) // {t})"


@query(f"with {IRP}, g as (select cast(sum(n) as bigint) as nnz from len) select cast({_owner(7)} as integer) as owner, count(*) as n_rows, cast(sum(n) as bigint) as nnz from irp, g group by 1")
def bounds_by_nnz(spark, sf_dir):
    return partitioning.nnz_loads(counts_a1(spark, sf_dir), 7).select("owner", "n_rows", "nnz")


@query(
    f"""with {IRP}, g as (select cast(sum(n) as bigint) as nnz, count(*) as nr from len), t as (select unnest(range(1, 41)) as parts),
b as (select parts, unnest(range(0, parts)) as t from t),
o as (select parts, {_owner('parts')} as t, count(*) as n from irp, g, t group by 1, 2),
s as (select b.parts, b.t, coalesce(n, 0) as n from b left join o on o.parts = b.parts and o.t = b.t)
select parts::integer as parts, t::integer as t, cast(sum(n) over w as bigint) - n as lo, cast(sum(n) over w as bigint) as hi from s window w as (partition by parts order by t)"""
)
def bounds_by_nnz_sweep(spark, sf_dir):
    return partitioning.bounds_sweep(counts_a1(spark, sf_dir), list(range(1, 41))).select("parts", "t", "lo", "hi")


@query(f"with {IRP} select count(*) filter (irp < 1000) as at from (select irp from irp union all select sum(n) from len)")
def ptr_lower_bound(spark, sf_dir):
    return partitioning.lower_bound(formats.csr_ptr(counts_a1(spark, sf_dir)), 1000).select("at")


@query(f"with {LEN}, {_hb(32)}, g as (select count(*) as n, (count(*) + 6) // 7 as s from hb) select t::integer as t, least(t * s, n) as lo, least((t + 1) * s, n) as hi from g, unnest(range(0, 7)) r(t)")
def hll_bounds(spark, sf_dir):
    return partitioning.block_bounds(formats.hll_meta(counts_a1(spark, sf_dir), 32), 7).select("t", "lo", "hi")


@query(f"with {LEN}, {_hb(32)}, g as (select (count(*) + 6) // 7 as s from hb) select block, cast(block // s as integer) as owner from hb, g")
def hll_block_owner(spark, sf_dir):
    return partitioning.owner_of_block(formats.hll_meta(counts_a1(spark, sf_dir), 32), 7).select("block", "owner")


@query("select bs::integer as block_size, (n + bs - 1) // bs as grid from (select count(*) as n from orders), unnest([128, 256, 512, 1024]) t(bs)")
def cuda_grid(spark, sf_dir):
    n = table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n"))
    sized = n.select("n", F.explode(F.array(*map(F.lit, (128, 256, 512, 1024)))).alias("block_size"))
    return sized.select("block_size", grid_size(F.col("n"), F.col("block_size")).cast("long").alias("grid"))


# --- benchmark records -----------------------------------------------------


def event_perf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records made of events: five kinds of runs, some without a time or a serial reference."""
    e, m = F.col("event_id"), F.col("user_id") % 20
    kind = F.when((e % 5 == 0) & (m < 15), 0).when(e % 5 == 0, 1).otherwise(e % 5)
    step = F.floor(e / 5)
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind.isin(1, 2), (step % 8 + 1)).otherwise(-1).cast("int").alias("Threads"),
        F.when(kind.isin(3, 4), F.element_at(F.array(*map(F.lit, (128, 256, 512, 1024))), (step % 4 + 1).cast("int"))).otherwise(-1).cast("int").alias("BlockSize"),
        F.when(kind.isin(2, 4), F.element_at(F.array(*map(F.lit, (16, 32, 64))), (e % 3 + 1).cast("int"))).otherwise(-1).cast("int").alias("HackSize"),
        ((e * 7919 % 1009) / 1e8).alias("Time_s"),
        (F.col("user_id") * 1000 + e % 7).alias("NNZ"),
        F.concat(F.lit("m"), m.cast("string"), F.when(m == 7, "_b").otherwise(""), F.lit(".mtx")).alias("Matrix"),
        F.when(kind.isin(2, 4), "HLL").otherwise("CSR").alias("Format"),
        F.when(kind == 0, "SerialRef").when(kind.isin(1, 2), "OpenMP").otherwise("CUDA").alias("Mode"),
    )
    rate = F.when(F.col("Mode") == "CUDA", mflops(F.col("NNZ"), F.col("Time_s"), -1.0)).otherwise(mflops(F.col("NNZ"), F.col("Time_s")))
    return rows.withColumn("MFLOPS", F.floor(rate).cast("double"))


PERF = """r0 as (
  select event_id, user_id, event_id // 5 as step, user_id % 20 as m,
    case when event_id % 5 = 0 and user_id % 20 < 15 then 0 when event_id % 5 = 0 then 1 else event_id % 5 end as kind from events),
r1 as (
  select event_id,
    (case when kind in (1, 2) then step % 8 + 1 else -1 end)::integer as "Threads",
    (case when kind in (3, 4) then [128, 256, 512, 1024][step % 4 + 1] else -1 end)::integer as "BlockSize",
    (case when kind in (2, 4) then [16, 32, 64][event_id % 3 + 1] else -1 end)::integer as "HackSize",
    (event_id * 7919 % 1009) / 1e8 as "Time_s", user_id * 1000 + event_id % 7 as "NNZ",
    'm' || m || (case when m = 7 then '_b' else '' end) || '.mtx' as "Matrix",
    case when kind in (2, 4) then 'HLL' else 'CSR' end as "Format",
    case when kind = 0 then 'SerialRef' when kind in (1, 2) then 'OpenMP' else 'CUDA' end as "Mode" from r0),
perf as (
  select *, floor(case when "NNZ" > 0 and "Time_s" > 1e-9 then 2.0::double * "NNZ" / "Time_s" / 1e6 when "Mode" = 'CUDA' then -1.0 else 0.0 end)::double as "MFLOPS" from r1),
ok as (select *, "MFLOPS" / 1000 as "GFLOPS" from perf where "MFLOPS" >= 0),
ref as (select "Matrix", avg("Time_s") as ref_time from ok where "Mode" = 'SerialRef' group by 1),
sp as (
  select ok.*, case when "Time_s" > 0 then ref_time / "Time_s" else 0.0 end as "Speedup" from ok left join ref using ("Matrix")),
omp as (select *, case when "Threads" > 0 then "Speedup" / "Threads" else 0.0 end as "Efficiency" from sp where "Mode" = 'OpenMP'),
un as (select * from omp where "GFLOPS" is not null and "Speedup" is not null and "Efficiency" is not null),
best as (
  select * exclude (rn) from (select *, row_number() over (partition by "Matrix", "Format", "HackSize" order by "GFLOPS" desc, event_id) as rn from un) where rn = 1)"""


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def valid_perf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pm.valid(event_perf(spark, sf_dir))


def omp_perf(spark: SparkSession, sf_dir: str) -> DataFrame:
    perf = valid_perf(spark, sf_dir)
    ref = pm.serial_reference(perf)
    csr, hll = (pm.with_speedup(pm.select_runs(perf, "OpenMP", f), ref, efficiency=True) for f in ("CSR", "HLL"))
    return pm.union_formats(csr, hll, ["GFLOPS", "Speedup", "Efficiency"])


def best_omp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pm.best_configuration(omp_perf(spark, sf_dir), ["event_id"])


@query(
    f"""with {PERF} select "Threads", "BlockSize",
  case when "Mode" = 'OpenMP' and "Format" = 'HLL' then 48 else "HackSize" end::integer as "HackSize",
  "Time_s", "MFLOPS", "NNZ", "Matrix", "Format", "Mode" from perf"""
)
def perf_parse(spark, sf_dir):
    """Log lines made of the records and parsed back; the HLL OpenMP logs' names state another hack size, which wins."""
    perf = event_perf(spark, sf_dir)
    mode = F.when(F.col("Mode") == "SerialRef", "serial").otherwise(F.lower("Mode"))
    file = F.concat(F.lit("results_"), F.lower("Format"), F.lit("_"), mode, F.when((F.col("Mode") == "OpenMP") & (F.col("Format") == "HLL"), "48").otherwise(""), F.lit(".txt"))
    keyed = perf.withColumn("line_no", F.col("event_id")).withColumn("file", file)
    text = F.format_string("[PERF] Format:X, Mode:X, Threads:%d, BlockSize:%d, HackSize:%d, Time_s:%.8f, MFLOPS:%.2f, NNZ:%d, Matrix:%s", "Threads", "BlockSize", "HackSize", "Time_s", "MFLOPS", "NNZ", "Matrix")
    made = keyed.select("file", "line_no", text.alias("value"))
    noise = made.withColumn("value", F.concat(F.lit("info: "), "value"))
    other = made.withColumn("file", F.lit("notes.txt"))
    return perf_log.parse(made.unionByName(noise).unionByName(other)).drop("file", "line_no")


_LOG_NAME = """'results_' || lower("Format") || '_' || case when "Mode" = 'SerialRef' then 'serial' else lower("Mode") end || case when "HackSize" <> -1 then "HackSize"::varchar else '' end || '.txt'"""


@query(f"""with {PERF} select {_LOG_NAME} as file, "Format", "Mode", case when "Format" = 'HLL' then "HackSize" else -1 end::integer as "HackSize", count(*) as records from perf group by all
union all select 'notes' || event_id % 7 || '.txt', null, null, null, count(*) from perf group by event_id % 7""")
def perf_filename(spark, sf_dir):
    """What the names of the logs that events belong in say, and names of no log."""
    perf = event_perf(spark, sf_dir)
    names = perf.select(perf_log.log_name(F.col("Format"), F.col("Mode"), F.col("HackSize")).alias("file"))
    names = names.unionByName(perf.select(F.format_string("notes%d.txt", F.col("event_id") % 7).alias("file")))
    return names.groupBy("file", *(c.alias(k) for k, c in perf_log.file_parts(F.col("file")).items())).agg(F.count(F.lit(1)).alias("records"))


@query(f'with {PERF} select event_id, "GFLOPS" from ok')
def perf_filter(spark, sf_dir):
    return valid_perf(spark, sf_dir).select("event_id", "GFLOPS")


@query(f'with {PERF} select event_id, "GFLOPS" from ok where "Matrix" <> \'m7_b.mtx\'')
def perf_filter_strict(spark, sf_dir):
    return pm.valid(event_perf(spark, sf_dir), strict_names=True).select("event_id", "GFLOPS")


@query(f'with {PERF} select event_id, round(case when "NNZ" > 0 and "Time_s" > 1e-9 then 2.0::double * "NNZ" / "Time_s" / 1e6 else 0.0 end, 6) as cpu, round(case when "NNZ" > 0 and "Time_s" > 1e-9 then 2.0::double * "NNZ" / "Time_s" / 1e6 else -1.0 end, 6) as gpu from perf')
def mflops_formula(spark, sf_dir):
    cpu, gpu = (mflops(F.col("NNZ"), F.col("Time_s"), invalid) for invalid in (0.0, -1.0))
    return event_perf(spark, sf_dir).select("event_id", F.round(cpu, 6).alias("cpu"), F.round(gpu, 6).alias("gpu"))


@query(f'with {PERF} select "Mode", "Format", count(*) as runs from ok group by all')
def perf_modes(spark, sf_dir):
    return valid_perf(spark, sf_dir).groupBy("Mode", "Format").agg(F.count(F.lit(1)).alias("runs"))


@query(f'with {PERF} select "Matrix", round(ref_time, 12) as ref_time from ref')
def serial_ref(spark, sf_dir):
    return rounded(pm.serial_reference(valid_perf(spark, sf_dir)), "ref_time", digits=12)


@query(f'with {PERF} select event_id, round("Speedup", 6) as "Speedup" from sp where "Mode" <> \'SerialRef\'')
def speedup(spark, sf_dir):
    perf = valid_perf(spark, sf_dir)
    out = pm.with_speedup(perf.where("Mode <> 'SerialRef'"), pm.serial_reference(perf))
    return rounded(out.select("event_id", "Speedup"), "Speedup")


@query(f'with {PERF} select event_id, round("Efficiency", 6) as "Efficiency" from omp')
def efficiency(spark, sf_dir):
    perf = valid_perf(spark, sf_dir)
    out = pm.with_speedup(pm.select_runs(perf, "OpenMP"), pm.serial_reference(perf), efficiency=True)
    return rounded(out.select("event_id", "Efficiency"), "Efficiency")


@query(f'with {PERF} select event_id, "Format", "HackSize" from un')
def perf_union(spark, sf_dir):
    return omp_perf(spark, sf_dir).select("event_id", "Format", "HackSize")


@query(f'with {PERF} select event_id, "Matrix", "Format", "HackSize", "GFLOPS" from best')
def best_config(spark, sf_dir):
    return best_omp(spark, sf_dir).select("event_id", "Matrix", "Format", "HackSize", "GFLOPS")


@query(f'with {PERF} select "Matrix", "Threads", round(avg("GFLOPS"), 6) as "GFLOPS" from omp where "Format" = \'CSR\' group by all')
def line_series(spark, sf_dir):
    return rounded(pm.line_series(pm.select_runs(valid_perf(spark, sf_dir), "OpenMP", "CSR"), "Threads", "GFLOPS"), "GFLOPS")


@query(f'with {PERF} select "Matrix", "Format", round(avg("Speedup"), 6) as "Speedup" from best group by all')
def bar_means(spark, sf_dir):
    return rounded(pm.bar_means(best_omp(spark, sf_dir), "Speedup"), "Speedup")


@query(f'with {PERF} select "Matrix", ntile(2) over (order by "Matrix")::integer as half from (select distinct "Matrix" from ok)')
def halves(spark, sf_dir):
    return pm.halves(valid_perf(spark, sf_dir))


@query(f'with {PERF} select "Matrix", (row_number() over (order by "Matrix") - 1)::integer % 40 as colour from (select distinct "Matrix" from ok)')
def palette(spark, sf_dir):
    return pm.palette(valid_perf(spark, sf_dir))


@query(f'with {PERF} select distinct "HackSize" from ok where "HackSize" <> -1')
def hack_sizes(spark, sf_dir):
    return pm.hack_sizes(valid_perf(spark, sf_dir))


@query(f'with {PERF} select distinct "BlockSize" from ok where "Mode" = \'CUDA\'')
def block_sizes(spark, sf_dir):
    return pm.block_sizes(pm.select_runs(valid_perf(spark, sf_dir), "CUDA"))


@query(f'with {PERF} select "Threads", "BlockSize", "HackSize", "Time_s", "MFLOPS", "NNZ", "Matrix", "Format", "Mode", "GFLOPS" from ok where "Mode" = \'CUDA\' and "Format" = \'HLL\'')
def perf_csv(spark, sf_dir):
    return report.exports(valid_perf(spark, sf_dir))["cuda_hll_perf"].select(*perf_log.PERF_COLUMNS)


@query(f"""with {PERF} select printf('[PERF] Format:%s, Mode:%s, Threads:%d, BlockSize:%d, HackSize:%d, Time_s:%.8f, MFLOPS:%.2f, NNZ:%d, Matrix:%s', "Format", "Mode", "Threads", "BlockSize", "HackSize", "Time_s", "MFLOPS", "NNZ", "Matrix") as value from perf""")
def perf_lines(spark, sf_dir):
    return perf_log.format_lines(event_perf(spark, sf_dir))


def _chart_sql(mode: str) -> str:
    x, source = ("Threads", "omp") if mode == "OpenMP" else ("BlockSize", "cud")
    measures = report.CHARTS[mode][1]
    cud = "" if mode == "OpenMP" else """, cud as (select * from sp where "Mode" = 'CUDA'), cun as (select * from cud where "GFLOPS" is not null and "Speedup" is not null),
cbest as (select * exclude (rn) from (select *, row_number() over (partition by "Matrix", "Format", "HackSize" order by "GFLOPS" desc, event_id) as rn from cun) where rn = 1)"""
    best = "best" if mode == "OpenMP" else "cbest"
    parts = []
    for y in measures:
        parts.append(f"""select '{mode}/CSR/{y}' as chart, "Matrix", "{x}"::varchar as x, round(avg("{y}"), 6) as y from {source} where "Format" = 'CSR' group by 1, 2, 3""")
        parts.append(f"""select '{mode}/HLL/HackSize_' || "HackSize" || '/{y}', "Matrix", "{x}"::varchar, round(avg("{y}"), 6) from {source} where "Format" = 'HLL' group by 1, 2, 3""")
        parts.append(f"""select '{mode}/Comparisons/{y}', "Matrix", "Format", round(avg("{y}"), 6) from {best} group by 1, 2, 3""")
    return f"with {PERF}{cud} " + " union all ".join(parts)


def _charts(mode: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    perf = valid_perf(spark, sf_dir).withColumn("file", F.lit("")).withColumn("line_no", F.col("event_id"))
    return rounded(report.chart_data(perf, mode), "y")


def _logs(spark: SparkSession, sf_dir: str) -> str:
    """The events' records as logs in a folder."""
    path = tables.fresh_path(spark)
    perf_log.write_logs(event_perf(spark, sf_dir), path)
    return path


@query(f"""with {PERF} select {_LOG_NAME} as file, "Format", "Mode", "Threads", "BlockSize", "HackSize", round("Time_s", 8) as "Time_s", round("MFLOPS", 2) as "MFLOPS", "NNZ", "Matrix" from perf""")
def perf_scan(spark, sf_dir):
    """Logs of the events written to a folder and read from it."""
    return perf_log.read(spark, _logs(spark, sf_dir), recursive=True).select("file", "Format", "Mode", "Threads", "BlockSize", "HackSize", "Time_s", "MFLOPS", "NNZ", "Matrix")


_CHARTS_SQL = " union all ".join(f"select chart, count(*) as n from ({_chart_sql(mode)}) group by chart" for mode in ("OpenMP", "CUDA"))


@query(f"""select 'charts/' || chart as path, n from ({_CHARTS_SQL})
union all select 'csv/' || lower("Mode") || '_' || lower("Format") || '_perf', count(*) from (with {PERF} select * from ok) where "Mode" <> 'SerialRef' group by "Mode", "Format"
union all select 'palette', count(distinct "Matrix") from (with {PERF} select * from ok)""")
def report_files(spark, sf_dir):
    """The rows of the files that a report on the events' logs writes, in folders that it makes."""
    out = f"{tables.fresh_path(spark)}/made/by/the/report"
    report.main(spark, _logs(spark, sf_dir), out, recursive=True)
    counted = lambda df, path: df.groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("n"))
    charts = counted(spark.read.csv(f"{out}/charts", header=True), F.concat(F.lit("charts/"), F.col("chart")))
    exported = counted(spark.read.csv(f"{out}/csv", header=True), F.concat(F.lit("csv/"), F.col("table")))
    return charts.unionByName(exported).unionByName(counted(spark.read.csv(f"{out}/palette", header=True), F.lit("palette")))


@query(_chart_sql("OpenMP"))
def report_openmp(spark, sf_dir):
    return _charts("OpenMP", spark, sf_dir)


@query(_chart_sql("CUDA"))
def report_cuda(spark, sf_dir):
    return _charts("CUDA", spark, sf_dir)
