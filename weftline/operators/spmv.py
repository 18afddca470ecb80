"""y = A x over coo, compressed rows and padded blocks.

The product is a join of the entries with x on the column and a sum by row;
partial sums are taken where the entries are, so a dense row is split over
tasks. x None means ones and needs no join. y is dense: rows without entries
give 0. The numpy kernels take tiles: entries of one stripe of columns beside
that stripe of x, so x is never gathered anywhere, however large it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.scalars import ceil_div, int_div
from weftline.operators.formats import block_cells, run_starts

#: Columns of a tile, and entries that a tile has at most, on average.
STRIPE, TILE = 1 << 16, 1 << 17


def ones(spark: SparkSession, n: int) -> DataFrame:
    """(idx, val): a vector of n ones."""
    return spark.range(n).select(F.col("id").cast("int").alias("idx"), F.lit(1.0).alias("val"))


def _times(entries: DataFrame, x: DataFrame | None, j: str, v: str, kind: str) -> DataFrame:
    """entries with __t, the entry times its element of x, in the given type."""
    if x is None:
        return entries.withColumn("__t", F.col(v).cast(kind))
    on = F.col(j) == F.col("__idx")
    right = x.select(F.col("idx").alias("__idx"), F.col("val").alias("__val"), *([F.col("matrix").alias("__xm")] if "matrix" in x.columns else []))
    if "matrix" in x.columns:
        on = on & (F.col("matrix") == F.col("__xm"))
    return entries.join(right, on).withColumn("__t", F.col(v).cast(kind) * F.col("__val").cast(kind))


def _dense(rows: DataFrame, sums: DataFrame, zero: Column) -> DataFrame:
    found = sums.select(F.col("matrix").alias("__m"), F.col("i").alias("__i"), F.col("y").alias("__y"))
    return rows.join(found, (F.col("matrix") == F.col("__m")) & (F.col("i") == F.col("__i")), "left").select("matrix", "i", F.coalesce("__y", zero).alias("y"))


def _summed(products: DataFrame, rows: DataFrame) -> DataFrame:
    """y of products __t for the rows in rows: one sum over the products and a zero for each row, so the dense result takes one shuffle and no join. Products of other rows are left out. Rows without a matrix are those of the only one."""
    keys = [c for c in ("matrix", "i") if c in rows.columns]
    key = [F.col(c).cast("long").alias(c) if c == "i" else F.col(c) for c in keys]
    zeros = rows.select(*key, F.lit(0.0).alias("__t"), F.lit(True).alias("__row"))
    both = zeros.union(products.select(*key, "__t", F.lit(False)))
    return both.groupBy(*keys).agg(F.sum("__t").alias("y"), F.max("__row").alias("__row")).where("__row").drop("__row")


def spmv_coo(coo: DataFrame, rows: DataFrame, x: DataFrame | None = None) -> DataFrame:
    """(matrix, i, y) in double precision. x: (idx, val), or (matrix, idx, val) with a vector per matrix."""
    return _summed(_times(coo, x, "j", "v", "double"), rows)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of products t sorted by (matrix, i) and order: each row's sequential single-precision sum. Only a row's sum so far outlives a batch."""
    row, total = None, np.float32(0)
    for b in batches:
        if not b.num_rows:
            continue
        starts = run_starts(b, ["matrix", "i"])
        at = pa.array(starts)
        keys = list(zip(b.column("matrix").take(at).to_pylist(), b.column("i").take(at).to_pylist(), strict=True))
        done = []
        for key, t in zip(keys, np.split(b.column("t").to_numpy(zero_copy_only=False), starts[1:]), strict=True):
            if row is not None and key != row:
                done.append((*row, total))
                total = np.float32(0)
            row = key
            total = np.add.accumulate(np.concatenate([[total], t], dtype=np.float32))[-1]
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["matrix", "i", "y"])
    if row is not None:
        yield pa.RecordBatch.from_arrays([pa.array([row[0]]), pa.array([row[1]]), pa.array([total])], ["matrix", "i", "y"])


def spmv_ordered(coo: DataFrame, rows: DataFrame, x: DataFrame | None = None, order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """(matrix, i, y) in single precision, each row added up in its own order like a sequential loop does.

    Rows are sorted where they are dealt to and folded as a stream. A row's
    sum has one order and so one task, which holds a batch of it at a time.
    """
    products = _times(coo, x, "j", "v", "float").select("matrix", F.col("i").cast("long").alias("i"), *(F.col(c).alias(f"__o{k}") for k, c in enumerate(order)), F.col("__t").alias("t"))
    dealt = products.repartition("matrix", "i").sortWithinPartitions("matrix", "i", *(f"__o{k}" for k in range(len(order))), "t").select("matrix", "i", "t")
    return _dense(rows, dealt.mapInArrow(_folded, "matrix string, i long, y float"), F.lit(0).cast("float"))


def spmv_csr(csr: DataFrame, rows: DataFrame, x: DataFrame | None = None) -> DataFrame:
    """(matrix, i, y) from csr_rows."""
    if x is None:
        return _summed(csr.select("matrix", "i", F.aggregate("a", F.lit(0.0), lambda acc, v: acc + v.cast("double")).alias("__t")), rows)
    return _summed(_times(_unpacked(csr), x, "ja", "a", "double"), rows)


def _unpacked(csr: DataFrame) -> DataFrame:
    return csr.select("matrix", "i", F.inline(F.arrays_zip("ja", "a")))


def spmv_hll(cells: DataFrame, rows: DataFrame, x: DataFrame | None = None) -> DataFrame:
    """(matrix, i, y) from hll_cells or block_cells. Cells of value 0, padding or not, take no part."""
    entries = cells.where("a <> 0")
    return _summed(_times(entries, x, "ja", "a", "double"), rows)


def _gathered(batches: Iterator[pa.RecordBatch], size: int, of) -> Iterator[tuple[str, list[np.ndarray]]]:
    """(matrix, arrays) of the batches of a matrix, about size elements at a time. of(batch) gives the arrays of a batch of one matrix."""
    matrix, found, n = None, [], 0
    for b in batches:
        if not b.num_rows:
            continue
        starts = run_starts(b, ["matrix"])
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), b.num_rows], strict=True):
            name = b.column("matrix")[lo].as_py()
            if found and (name != matrix or n >= size):
                yield matrix, [np.concatenate(c) for c in zip(*found, strict=True)]
                found, n = [], 0
            matrix = name
            found.append(of(b.slice(lo, hi - lo)))
            n += len(found[-1][0])
    if found:
        yield matrix, [np.concatenate(c) for c in zip(*found, strict=True)]


def _numbers(column: pa.Array, kind: type) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(kind)


def _flat_entries(b: pa.RecordBatch) -> list[np.ndarray]:
    """i, j and v of rows (i, j, v)."""
    return [_numbers(b.column(c), kind) for c, kind in (("i", np.int64), ("j", np.int64), ("v", np.float64))]


def _flat_vector(b: pa.RecordBatch) -> list[np.ndarray]:
    """j and v of rows (j, v)."""
    return [_numbers(b.column(c), kind) for c, kind in (("j", np.int64), ("v", np.float64))]


def _list_entries(b: pa.RecordBatch) -> list[np.ndarray]:
    """i, j and v of csr_rows."""
    n, ja = _numbers(b.column("ja").value_lengths(), np.int64), b.column("ja").flatten()
    there = ja.is_valid().to_numpy(zero_copy_only=False)
    return [np.repeat(_numbers(b.column("i"), np.int64), n)[there], _numbers(ja.drop_null(), np.int64), _numbers(b.column("a").flatten(), np.float64)[there]]


def _block_entries(b: pa.RecordBatch) -> list[np.ndarray]:
    """i, j and v of the cells of hll_blocks that are not zero."""
    n = _numbers(b.column("ja").value_lengths(), np.int64)
    block, hack, nr, at = (np.repeat(_numbers(b.column(c), np.int64), n) for c in ("block", "hack", "nr", "at"))
    flat = at + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    ja, a = (b.column(c).flatten() for c in ("ja", "a"))
    v = _numbers(a, np.float64)
    keep = np.flatnonzero((v != 0) & a.is_valid().to_numpy(zero_copy_only=False) & ja.is_valid().to_numpy(zero_copy_only=False))
    return [(block * hack + flat % nr)[keep], _numbers(ja.take(pa.array(keep)), np.int64), v[keep]]


def _packets(of, columns: list[str]):
    """Elements dealt to the stripes of their columns: of about TILE of them, those of a stripe as one row of packed arrays, in the order that they come in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for matrix, arrays in _gathered(batches, TILE, of):
            stripe = arrays[columns.index("j")] // STRIPE
            order = np.argsort(stripe, kind="stable")
            stripe = stripe[order]
            starts = np.flatnonzero(np.append(True, stripe[1:] != stripe[:-1])[: len(stripe)])
            ends = np.append(starts[1:], len(stripe))
            packed = [pa.array([a[lo:hi].tobytes() for lo, hi in zip(starts, ends, strict=True)], pa.binary()) for a in (a[order] for a in arrays)]
            yield pa.RecordBatch.from_arrays([pa.array([matrix] * len(starts), pa.string()), pa.array(stripe[starts]), *packed], ["matrix", "stripe", *columns])

    return run


def _tile_kernel(block: int):
    """Over packets sorted by tile and side: a stripe of x (side 0: j, v) and then the entries (side 1) that it multiplies, block at a time."""

    def made(matrix: str, sums: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        rows, y = (np.concatenate(c) for c in zip(*sums, strict=True))
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(matrix, pa.string()), len(rows)), pa.array(rows), pa.array(y)], ["matrix", "i", "__t"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, value, there = None, np.zeros(STRIPE), np.zeros(STRIPE, bool)
        sums, n = [], 0
        for b in batches:
            keys = zip(*(b.column(c).to_pylist() for c in ("matrix", "stripe", "part")), strict=True)
            for at, key in enumerate(keys):
                if key != tile:
                    if sums and key[0] != tile[0]:
                        yield made(tile[0], sums)
                        sums, n = [], 0
                    tile = key
                    value[:] = 0
                    there[:] = False
                i, j, v = (np.frombuffer(b.column(c)[at].as_buffer(), kind) if b.column(c)[at].is_valid else None for c, kind in (("i", np.int64), ("j", np.int64), ("v", np.float64)))
                j = j - key[1] * STRIPE
                if i is None:
                    np.add.at(value, j, v)  # like a join, a repeated index counts each time
                    there[j] = True
                    continue
                for k in range(0, len(i), block):
                    own = there[j[k : k + block]]
                    rows, to = np.unique(i[k : k + block][own], return_inverse=True)
                    sums.append((rows, np.bincount(to, v[k : k + block][own] * value[j[k : k + block][own]], len(rows)).astype(float)))
                    n += len(rows)
                    if n >= TILE:
                        yield made(key[0], sums)
                        sums, n = [], 0
        if sums:
            yield made(tile[0], sums)

    return run


def _tiled(entries: DataFrame, of, stripes: DataFrame, rows: DataFrame, x: DataFrame, block: int) -> DataFrame:
    """spmv_tiled of entries in any form that of reads. stripes: (matrix, stripe) of each of them."""
    keyed = "matrix" in x.columns
    parts = stripes.groupBy(F.col("matrix").alias("tm"), F.col("stripe").alias("ts")).agg(ceil_div(F.count(F.lit(1)), TILE).alias("parts"))
    parts = F.broadcast(parts)  # a row for each stripe, so that no stripe meets in one task
    on = F.col("stripe") == F.col("ts")
    packed = entries.mapInArrow(_packets(of, ["i", "j", "v"]), "matrix string, stripe long, i binary, j binary, v binary")
    packed = packed.withColumn("__nth", F.monotonically_increasing_id())  # packets are dealt as they come, also those of one row
    dealt = packed.join(parts, on & (F.col("matrix") == F.col("tm"))).select("matrix", "stripe", F.pmod(F.xxhash64("__nth"), F.col("parts")).alias("part"), F.lit(1).alias("side"), "i", "j", "v")
    good = x.where("idx >= 0 and val is not null").select(F.col("matrix") if keyed else F.lit("").alias("matrix"), F.col("idx").cast("long").alias("j"), F.col("val").cast("double").alias("v"))
    sent = good.mapInArrow(_packets(_flat_vector, ["j", "v"]), "matrix string, stripe long, j binary, v binary").withColumnRenamed("matrix", "xm")
    sent = sent.join(parts, on & (F.col("xm") == F.col("tm")) if keyed else on).select(F.col("tm").alias("matrix"), "stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), F.lit(None).cast("binary").alias("i"), "j", "v")
    tile = ["stripe", "part", "matrix"]
    tiles = sent.unionByName(dealt).repartition(*tile).sortWithinPartitions(*tile, "side").drop("side")
    return _summed(tiles.mapInArrow(_tile_kernel(block), "matrix string, i long, __t double"), rows)


def spmv_tiled(entries: DataFrame, rows: DataFrame, x: DataFrame, block: int = 1 << 16) -> DataFrame:
    """(matrix, i, y) of entries (matrix, i, j, v) by a numpy kernel over tiles, at most block entries at a time.

    A tile is a stripe of columns and a class of packets of entries, of which a
    stripe has as many as its entries need. Entries and x, (idx, val) or
    (matrix, idx, val) with a vector per matrix, go to the tiles of their
    stripe in packed arrays, so a worker holds one stripe of x. Columns that x
    lacks contribute nothing.
    """
    e = entries.where("i is not null and j is not null").select("matrix", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))
    return _tiled(e, _flat_entries, e.select("matrix", int_div(F.col("j"), STRIPE).alias("stripe")), rows, x, block)


def spmv_arrow(csr: DataFrame, rows: DataFrame, x: DataFrame, block: int = 1 << 16) -> DataFrame:
    """(matrix, i, y) from csr_rows by spmv_tiled."""
    lists = csr.where("i is not null").select("matrix", F.col("i").cast("long").alias("i"), "ja", "a")
    return _tiled(lists, _list_entries, csr.select("matrix", F.explode("ja").alias("j")).select("matrix", int_div(F.col("j"), STRIPE).alias("stripe")), rows, x, block)


def vector_text(y: DataFrame, width: int = 1 << 16) -> DataFrame:
    """(matrix, chunk, text): a vector (matrix, i, y) printed with two decimals and a space after each element, width elements to a chunk."""
    chunked = y.groupBy("matrix", int_div(F.col("i"), width).alias("chunk"))
    listed = F.sort_array(F.collect_list(F.struct("i", F.format_string("%.2f ", F.col("y").cast("double")).alias("t"))))
    return chunked.agg(F.array_join(F.transform(listed, lambda e: e["t"]), "").alias("text"))


def spmv_owned(owned: DataFrame, x: DataFrame | None = None) -> DataFrame:
    """(matrix, i, y) of partitioning.distribute: every partition adds up what it owns.

    Sums of rows that one task takes alone are not shuffled. A row over
    several leaves one partial sum in each, and only these, at most two for
    each partition, are added up in a second aggregation. x is joined as Spark
    sees fit; a small one is broadcast and leaves the partitions where they are.
    """
    if x is None:
        products = owned.withColumn("__t", F.col("v").cast("double"))
    else:
        keyed = "matrix" in x.columns
        right = x.select(F.col("idx").alias("__idx"), F.col("val").cast("double").alias("__val"), *([F.col("matrix").alias("__xm")] if keyed else []))
        on = F.col("j") == F.col("__idx")
        products = owned.join(right, on & (F.col("matrix") == F.col("__xm")) if keyed else on, "left")
        products = products.withColumn("__t", F.when(F.col("__val").isNotNull(), F.col("v").cast("double") * F.col("__val")).otherwise(0.0))
    sums = lambda some: some.groupBy("task", "matrix", "i").agg(F.sum("__t").alias("y"))
    carried = sums(products.where("split")).groupBy("matrix", "i").agg(F.sum("y").alias("y"))
    return sums(products.where("not split")).select("matrix", "i", "y").unionByName(carried)


def spmv_blocks(owned: DataFrame) -> DataFrame:
    """(matrix, i, y) of partitioning.distribute_blocks for x all ones: blocks are added up where they are, without a shuffle or a join."""
    row = F.col("block") * F.col("hack")
    cells = owned.where("k > 0").select("task", "matrix", "block", "hack", "nr", "at", F.posexplode("a").alias("p", "v"))
    cells = cells.select("task", "matrix", (row + (F.col("at") + F.col("p")) % F.col("nr")).alias("i"), F.col("v").cast("double").alias("t"))
    empty = owned.where("k = 0").select("task", "matrix", F.explode(F.sequence(row, row + F.col("nr") - 1)).alias("i"), F.lit(0.0).alias("t"))
    sums = lambda some: some.groupBy("task", "matrix", "i").agg(F.sum("t").alias("y")).select("matrix", "i", "y")
    return sums(cells).unionByName(sums(empty))


def spmv_blocks_arrow(blocks: DataFrame, rows: DataFrame, x: DataFrame, block: int = 1 << 16) -> DataFrame:
    """(matrix, i, y) of hll_blocks by spmv_tiled. Stored zeros, padding or not, take no part."""
    full = blocks.where("k > 0").select("matrix", "block", "hack", "nr", "at", "ja", "a")
    cells = full.select("matrix", F.explode(F.arrays_zip("ja", "a")).alias("c")).where("c.a <> 0")
    return _tiled(full, _block_entries, cells.select("matrix", int_div(F.col("c.ja"), STRIPE).alias("stripe")), rows, x, block)
