import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.functions.prefix import exclusive_prefix
from weftline.operators import formats, partitioning, spmv

TINY = [(0, 2, 5.0), (0, 0, 1.0), (2, 1, 3.0), (4, 3, 2.0), (4, 3, 4.0), (4, 0, 0.0)]


def relations(spark, cells, n, name="m"):
    coo = spark.createDataFrame([(name, p, i, j, float(v)) for p, (i, j, v) in enumerate(cells)], "matrix string, pos long, i int, j int, v float")
    rows = spark.range(n).selectExpr(f"'{name}' as matrix", "id as i")
    return coo, rows, formats.row_counts(coo, rows)


def ys(df):
    return [r.y for r in df.orderBy("i").collect()]


def test_tiny_matrix(spark):
    coo, rows, counts = relations(spark, TINY, 6)
    assert ys(spmv.spmv_coo(coo, rows)) == [6, 0, 3, 0, 6, 0]
    ent = formats.csr_entries(coo).orderBy("k").collect()
    assert [(r.k, r.ja, r.a) for r in ent] == [(k, j, v) for k, (_, j, v) in enumerate(TINY)]
    blocks = formats.hll_blocks(coo, counts, 4).orderBy("block").collect()
    assert [(r.nr, r.k, r.cells, r.start_offset) for r in blocks] == [(4, 2, 8, 0), (2, 3, 6, 8)]
    assert blocks[0].ja == [2, 0, 1, 0, 0, 0, 1, 0] and blocks[0].a == [5, 0, 3, 0, 1, 0, 0, 0]
    assert blocks[1].ja == [3, 0, 3, 0, 0, 0] and blocks[1].a == [2, 0, 4, 0, 0, 0]
    assert [(r.lo, r.hi) for r in partitioning.bounds_by_nnz(counts, 3).orderBy("t").collect()] == [(0, 1), (1, 5), (5, 6)]
    assert [r.owner for r in partitioning.owner_by_nnz(counts, 3).orderBy("i").collect()] == [0, 1, 1, 1, 1, 2]
    assert [(r.lo, r.hi) for r in partitioning.block_bounds(formats.hll_meta(counts, 4), 3).orderBy("t").collect()] == [(0, 1), (1, 2), (2, 2)]


cells = st.lists(st.tuples(st.integers(0, 8), st.integers(0, 5), st.integers(-3, 3)), max_size=30)


@settings(max_examples=12, deadline=None)
@given(cells, st.lists(st.integers(-4, 4), min_size=6, max_size=6), st.sampled_from([1, 2, 4, 16]))
def test_all_forms_give_one_product(spark, entries, x, hack):
    coo, rows, counts = relations(spark, entries, 9)
    vector = spark.createDataFrame([(j, float(v)) for j, v in enumerate(x)], "idx int, val double")
    want = [float(sum(v * x[j] for i, j, v in entries if i == r)) for r in range(9)]
    csr, blocks = formats.csr_rows(coo), formats.hll_blocks(coo, counts, hack)
    for y in (
        spmv.spmv_coo(coo, rows, vector),
        spmv.spmv_csr(csr, rows, vector),
        spmv.spmv_arrow(csr, rows, vector),
        spmv.spmv_hll(formats.hll_cells(coo, counts, hack), rows, vector),
        spmv.spmv_hll(formats.block_cells(blocks), rows, vector),
        spmv.spmv_ordered(coo, rows, vector),
    ):
        assert ys(y) == want
    assert sum(r.cells for r in blocks.collect()) >= len(entries)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=30), st.integers(1, 12))
def test_owners_equal_the_search(spark, lengths, parts):
    counts = spark.createDataFrame([("m", i, n) for i, n in enumerate(lengths)], "matrix string, i long, n long")
    irp, nnz, n = np.concatenate([[0], np.cumsum(lengths)]), sum(lengths), len(lengths)
    step = -(-nnz // parts)
    bounds = [0] + [n if not nnz or t * step >= nnz else int(np.searchsorted(irp, t * step)) for t in range(1, parts)] + [n]
    if not nnz:
        bounds = [0] * parts + [n]
    got = [(r.lo, r.hi) for r in partitioning.bounds_by_nnz(counts, parts).orderBy("t").collect()]
    assert got == list(zip(bounds, bounds[1:]))


def test_empty_matrix(spark):
    coo, rows, counts = relations(spark, [], 3)
    assert ys(spmv.spmv_coo(coo, rows)) == [0, 0, 0]
    assert [r.k for r in formats.hll_meta(counts, 2).orderBy("block").collect()] == [0, 0]
    assert formats.hll_cells(coo, counts, 2).count() == 0
    assert [(r.i, r.irp) for r in formats.csr_ptr(counts).orderBy("i").collect()] == [(0, 0), (1, 0), (2, 0), (3, 0)]
    assert formats.padding_ratio(counts, 2).first().padding == 0


def test_products_of_special_values(spark):
    """Padded forms skip stored zeros; plain forms multiply them."""
    coo, rows, counts = relations(spark, [(0, 0, 0.0), (0, 1, 2.0)], 1)
    x = spark.createDataFrame([(0, float("inf")), (1, 1.0)], "idx int, val double")
    assert np.isnan(ys(spmv.spmv_coo(coo, rows, x))[0])
    assert ys(spmv.spmv_hll(formats.hll_cells(coo, counts, 2), rows, x)) == [2.0]


def test_ordered_sums_are_sequential_single_precision(spark):
    rng = np.random.default_rng(3)
    entries = [(i, int(j), float(v)) for i in range(20) for j, v in zip(rng.integers(0, 50, 40), rng.normal(size=40).astype(np.float32))]
    x = rng.normal(size=50).astype(np.float32)
    coo, rows, _ = relations(spark, entries, 20)
    vector = spark.createDataFrame([(j, float(v)) for j, v in enumerate(x)], "idx int, val float")
    want = []
    for r in range(20):
        acc = np.float32(0)
        for i, j, v in entries:
            if i == r:
                acc = np.float32(acc + np.float32(v) * x[j])
        want.append(float(acc))
    assert ys(spmv.spmv_ordered(coo, rows, vector)) == want


def test_several_matrices_and_vectors(spark):
    coo = spark.createDataFrame([("a", 0, 0, 0, 2.0), ("b", 0, 0, 0, 3.0)], "matrix string, pos long, i int, j int, v float")
    rows = spark.createDataFrame([("a", 0), ("b", 0), ("b", 1)], "matrix string, i long")
    x = spark.createDataFrame([("a", 0, 10.0), ("b", 0, 100.0)], "matrix string, idx int, val double")
    assert {(r.matrix, r.i): r.y for r in spmv.spmv_coo(coo, rows, x).collect()} == {("a", 0): 20, ("b", 0): 300, ("b", 1): 0}


@pytest.mark.parametrize(("stripe", "tile"), [(1, 1), (2, 3), (1 << 16, 1 << 17)])
def test_tiles_of_any_size_give_one_product(spark, monkeypatch, stripe, tile):
    monkeypatch.setattr(spmv, "STRIPE", stripe)
    monkeypatch.setattr(spmv, "TILE", tile)
    coo, rows, counts = relations(spark, TINY, 6)
    x = spark.createDataFrame([(0, 2.0), (0, 1.0), (2, 10.0), (3, None), (-1, 7.0), (2**40, 5.0)], "idx long, val double")
    tiled = spmv.spmv_tiled
    for y in (tiled(coo, rows, x), tiled(coo, rows, x, 1), spmv.spmv_arrow(formats.csr_rows(coo), rows, x), spmv.spmv_blocks_arrow(formats.hll_blocks(coo, counts, 4), rows, x)):
        assert ys(y) == [53, 0, 0, 0, 0, 0]


def test_tiles_take_x_without_the_driver(spark, monkeypatch):
    """No job runs, and nothing is broadcast from the driver, before the product is asked for."""
    coo, rows, _ = relations(spark, TINY, 6)
    x, csr = spmv.ones(spark, 4), formats.csr_rows(coo)

    def forbidden(*a, **k):
        raise AssertionError("rows reached the driver")

    for name in ("collect", "toPandas", "first", "toLocalIterator"):
        monkeypatch.setattr(type(x), name, forbidden)
    y = spmv.spmv_arrow(csr, rows, x)
    assert "MapInArrow" in y._jdf.queryExecution().executedPlan().toString()


@settings(max_examples=15, deadline=None)
@given(st.dictionaries(st.tuples(st.sampled_from("ab"), st.integers(0, 40)), st.integers(0, 9), min_size=1), st.integers(1, 7))
def test_prefix_sums(spark, values, width):
    df = spark.createDataFrame([(k, o, v) for (k, o), v in values.items()], "k string, o long, v long")
    got = {(r.k, r.o): r.s for r in exclusive_prefix(df, ["k"], "o", "v", "s", width).collect()}
    assert got == {(k, o): sum(v for (a, b), v in values.items() if a == k and b < o) for k, o in values}


def test_bad_sizes(spark):
    coo, rows, counts = relations(spark, TINY, 6)
    for hack in (0, -1):
        with pytest.raises(ValueError):
            formats.hll_meta(counts, hack)
        with pytest.raises(ValueError):
            formats.hll_blocks(coo, counts, hack)
    for parts in (0, -2):
        with pytest.raises(ValueError):
            partitioning.owner_by_nnz(counts, parts)


def test_distribution_gives_equal_parts(spark):
    coo, rows, counts = relations(spark, TINY, 6)
    parts = partitioning.distribute(coo, counts, 3)
    assert parts.rdd.getNumPartitions() == 3 and parts.where("j is not null").count() == 6
    assert [r["count"] for r in parts.groupBy("owner").count().orderBy("owner").collect()] == [4, 4, 4]
    assert {(r.i, r.owner, r.split) for r in parts.collect()} == {(0, 0, False), (1, 0, False), (2, 1, False), (3, 1, False), (4, 1, True), (4, 2, True), (5, 2, False)}
    at = parts.selectExpr("spark_partition_id() as p", "owner").distinct().collect()
    assert len(at) == len({r.p for r in at}) == len({r.owner for r in at})


def test_a_dense_row_is_split_evenly(spark):
    """One row with half of all entries: no owner has over 1.2 times the mean, and the product is right."""
    entries = [(7, j % 40, 1.0) for j in range(3000)] + [(i % 50, i % 40, 2.0) for i in range(3000)]
    coo, rows, counts = relations(spark, entries, 50)
    parts = partitioning.distribute(coo, counts, 8).persist()
    loads = [r["count"] for r in parts.groupBy("owner").count().collect()]
    assert len(loads) == 8 and max(loads) <= 1.2 * sum(loads) / 8
    x = spark.createDataFrame([(j, float(j)) for j in range(40)], "idx int, val double")
    want = [0.0] * 50
    for i, j, v in entries:
        want[i] += v * j
    assert ys(spmv.spmv_owned(parts, x)) == want
    parts.unpersist()


def test_owned_rows_are_added_up_where_they_are(spark):
    """After the one move of the entries to their owners, no sum is shuffled but those of rows with several owners."""
    coo, rows, counts = relations(spark, TINY, 6)
    owned = partitioning.distribute(coo, counts, 3).persist()
    owned.count()
    for x in (None, spmv.ones(spark, 4)):
        y = spmv.spmv_owned(owned, x)
        assert ys(y) == [6, 0, 3, 0, 6, 0]
    executed = spmv.spmv_owned(owned.where("not split"))._jdf.queryExecution().executedPlan().toString()
    assert executed.split("InMemoryTableScan")[0].count("Exchange") == 0
    blocks = partitioning.distribute_blocks(formats.hll_blocks(coo, counts, 2), 2).persist()
    product = spmv.spmv_blocks(blocks)
    assert ys(product) == [6, 0, 3, 0, 6, 0]
    top = product._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
    assert "Exchange" not in top and "Join" not in top
    owned.unpersist()
    blocks.unpersist()


def test_rows_and_blocks_come_in_bounded_pieces(spark):
    """A dense row, and a block of a dense row, are many small rows; together they hold every cell once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        entries = [(3, j, float(j + 1)) for j in range(1500)] + [(i, 0, 2.0) for i in range(6)]
        coo, rows, counts = relations(spark, entries, 6)
        pieces = formats.csr_rows(coo).where("i = 3").orderBy("piece").collect()
        assert len(pieces) > 10 and max(len(p.ja) for p in pieces) <= 100
        assert [j for p in pieces for j in p.ja] == [*range(1500), 0]
        for hack in (4, 1 << 20):
            blocks = formats.hll_blocks(coo, counts, hack).collect()
            assert max(len(b.ja) for b in blocks) <= 100 and sum(len(b.ja) for b in blocks) == sum({b.block: b.cells for b in blocks}.values())
            cells = {(r.block, r.flat): (r.i, r.ja, r.a) for r in formats.hll_cells(coo, counts, hack).collect()}
            assert {(r.block, r.flat): (r.i, r.ja, r.a) for r in formats.block_cells(formats.hll_blocks(coo, counts, hack)).collect()} == cells
        assert cells[0, 1 * 6 + 0] == (0, 0, 0.0) and cells[0, 1500 * 6 + 3] == (3, 0, 2.0)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_entries_are_placed_without_a_window_over_rows(spark):
    coo, _, _ = relations(spark, TINY, 6)
    plan = formats.csr_entries(coo)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(i" not in plan and "windowspecdefinition(matrix" not in plan


def test_pointers_are_found_in_one_folder(spark, tmp_path):
    counts = spark.createDataFrame([("m", i, i % 3) for i in range(500)] + [("n", i, 0) for i in range(5)], "matrix string, i long, n long")
    ptr = formats.csr_ptr(counts)
    partitioning.store_pointers(ptr, str(tmp_path / "p"), width=50)
    for value in (0, 1, 100, 498, 499, 10_000):
        got = {r.matrix: r["at"] for r in partitioning.stored_lower_bound(spark, str(tmp_path / "p"), value).collect()}
        assert got == {r.matrix: r["at"] for r in partitioning.lower_bound(ptr, value).collect()}
    plan = partitioning.stored_lower_bound(spark, str(tmp_path / "p"), 100)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and "GreaterThanOrEqual(irp,100)" in plan


def test_kernels_take_a_vector_per_matrix_and_missing_columns(spark):
    coo = spark.createDataFrame([("a", 0, 0, 0, 2.0), ("a", 1, 0, 3, 9.0), ("b", 0, 0, 0, 3.0), ("b", 1, 1, 1, 1.0), ("c", 0, 0, 0, 5.0)], "matrix string, pos long, i int, j int, v float")
    rows = spark.createDataFrame([("a", 0), ("b", 0), ("b", 1), ("c", 0)], "matrix string, i long")
    x = spark.createDataFrame([("a", 0, 10.0), ("b", 0, 100.0), ("b", 9, 1.0), ("d", 0, 1.0)], "matrix string, idx int, val double")
    counts, csr = formats.row_counts(coo, rows), formats.csr_rows(coo)
    want = {("a", 0): 20, ("b", 0): 300, ("b", 1): 0, ("c", 0): 0}
    for y in (spmv.spmv_coo(coo, rows, x), spmv.spmv_csr(csr, rows, x), spmv.spmv_arrow(csr, rows, x), spmv.spmv_arrow(csr, rows, x, 1), spmv.spmv_blocks_arrow(formats.hll_blocks(coo, counts, 2), rows, x, 1), spmv.spmv_owned(partitioning.distribute(coo, counts, 2), x)):
        assert {(r.matrix, r.i): r.y for r in y.collect()} == want


def test_products_have_the_rows_asked_for(spark):
    coo, rows, _ = relations(spark, TINY, 6)
    few = rows.where("i < 3")
    for y in (spmv.spmv_coo(coo, few), spmv.spmv_csr(formats.csr_rows(coo), few), spmv.spmv_arrow(formats.csr_rows(coo), few, spmv.ones(spark, 4)), spmv.spmv_ordered(coo, few)):
        assert [(r.i, r.y) for r in y.orderBy("i").collect()] == [(0, 6), (1, 0), (2, 3)]


def test_printed_vectors(spark):
    y = spark.createDataFrame([("m", i, i / 3) for i in range(7)], "matrix string, i long, y double")
    got = [r.text for r in spmv.vector_text(y, 4).orderBy("chunk").collect()]
    assert "".join(got) == "".join(f"{i / 3:.2f} " for i in range(7)) and len(got) == 2


def test_gather_is_one_join_and_one_shuffle_of_sums(spark):
    """The plan of a product reads what it needs and adds up before it shuffles."""
    coo, rows, _ = relations(spark, TINY, 6)
    plan = spmv.spmv_coo(coo, rows, spmv.ones(spark, 4))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "partial_sum" in plan and "CartesianProduct" not in plan and "Python" not in plan


def test_pieces_of_one_block_stay_where_they_are(spark):
    """The blocks are joined to their pieces, not the pieces to their block, which is one task if it is the only one."""
    conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": "100", "spark.sql.adaptive.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        coo, rows, counts = relations(spark, [(i % 500, i // 500, 1.0) for i in range(3000)], 501)
        blocks = formats.hll_blocks(coo, counts, 1 << 20).selectExpr("block", "size(ja) as n", "spark_partition_id() as p").collect()
        assert {r.block for r in blocks} == {0} and sum(r.n for r in blocks) == 501 * 6 and len({r.p for r in blocks}) > 1
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_a_large_owner_has_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(partitioning, "SHARE", 100)
    entries = [(7, j % 40, 1.0) for j in range(600)] + [(i % 50, i % 40, 2.0) for i in range(600)]
    coo, rows, counts = relations(spark, entries, 50)
    parts = partitioning.distribute(coo, counts, 2).persist()
    loads = [r["count"] for r in parts.groupBy("task").count().collect()]
    assert parts.rdd.getNumPartitions() == len(loads) == 14 and max(loads) <= 100
    assert [r["count"] for r in parts.groupBy("owner").count().orderBy("owner").collect()] == [625, 625]
    assert ys(spmv.spmv_owned(parts)) == ys(spmv.spmv_coo(coo, rows))
    parts.unpersist()


def test_entries_of_a_stripe_do_not_meet_before_their_tiles(spark):
    coo, rows, _ = relations(spark, TINY, 6)
    plan = spmv.spmv_tiled(coo, rows, spmv.ones(spark, 4))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2


def test_a_large_owner_of_blocks_has_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(partitioning, "SHARE", 100)
    coo, rows, counts = relations(spark, [(i % 50, i % 40, 2.0) for i in range(600)], 60)
    blocks = partitioning.distribute_blocks(formats.hll_blocks(coo, counts, 4), 2).persist()
    loads = [r["count"] for r in blocks.groupBy("task").count().collect()]
    assert blocks.rdd.getNumPartitions() == 8 and max(loads) <= 2 and {r.owner for r in blocks.select("owner").collect()} == {0, 1}
    assert ys(spmv.spmv_blocks(blocks)) == ys(spmv.spmv_coo(coo, rows))
    blocks.unpersist()


@pytest.mark.parametrize("batch", ["3", "60", "10000"])
def test_blocks_are_the_same_however_they_are_made(spark, batch):
    """Small blocks are laid out whole, over the ends of batches too; the cells are those of hll_cells, and nulls stay."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        cells = [(r, (r * 7 + k) % 11, None if k == 3 else float(r + k)) for r in range(37) if r % 5 for k in range(r % 9)] + [(36, j, 1.0) for j in range(70)]
        coo = spark.createDataFrame([(name, -p, i, j, v) for name in ("a", "b") for p, (i, j, v) in enumerate(cells)], "matrix string, pos long, i int, j int, v float").repartition(5)
        counts = formats.row_counts(coo, spark.range(41).selectExpr("explode(array('a', 'b')) as matrix", "id as i"))
        want = sorted(map(repr, formats.hll_cells(coo, counts, 4).select("matrix", "block", "flat", "i", "ja", "a").collect()))
        blocks = formats.hll_blocks(coo, counts, 4)
        assert sorted(map(repr, formats.block_cells(blocks).select("matrix", "block", "flat", "i", "ja", "a").collect())) == want
        sizes = {(r.matrix, r.block): (r.nr, r.k, r.cells, r.start_offset) for r in blocks.collect()}
        assert sizes == {(r.matrix, r.block): (r.nr, r.k, r.cells, r.start_offset) for r in formats.hll_offsets(formats.hll_meta(counts, 4)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
