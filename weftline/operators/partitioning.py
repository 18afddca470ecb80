"""Work partitioning as columns and bounds.

A partition's bounds are half-open ranges of rows or blocks. The owner of a
row has a closed form, so no search is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.places import groups_within
from weftline.functions.prefix import exclusive_prefix
from weftline.functions.scalars import ceil_div, int_div


def _parts(parts: int) -> int:
    if parts <= 0:
        raise ValueError("the number of partitions must be positive")
    return parts


def _owner(parts: Column) -> Column:
    """The owner of a row with irp, of __nnz entries in all."""
    step = ceil_div(F.col("__nnz"), parts)
    return F.when(F.col("__nnz") == 0, parts - 1).otherwise(int_div(F.least("irp", F.col("__nnz") - 1), F.when(step > 0, step).otherwise(1))).cast("int")


def _starts(counts: DataFrame) -> DataFrame:
    starts = exclusive_prefix(counts, ["matrix"], "i", "n", "irp")
    totals = counts.groupBy(F.col("matrix").alias("__m")).agg(F.sum("n").alias("__nnz"))
    return starts.join(totals, F.col("matrix") == F.col("__m"))


def owner_by_nnz(counts: DataFrame, parts: int) -> DataFrame:
    """counts with irp and owner: the partition of each row, with about equal entries in each.

    A row belongs where its first entry falls in steps of ceil(nnz / parts);
    trailing empty rows follow the last entry. Without entries the last
    partition owns all rows.
    """
    return _starts(counts).select("matrix", "i", "n", "irp", _owner(F.lit(_parts(parts))).alias("owner"))


def nnz_loads(counts: DataFrame, parts: int) -> DataFrame:
    """(matrix, owner, n_rows, nnz) of the partitions that own rows."""
    return owner_by_nnz(counts, parts).groupBy("matrix", "owner").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n").cast("long").alias("nnz"))


#: Rows of a range that thresholds are sought in.
WIDTH = 1 << 12


def _latest(known: DataFrame, wanted: DataFrame, by: list[str], value: str) -> DataFrame:
    """wanted (by, pos, ...) with value: that of the last row of known (by, pos, value) at or before pos. One sort of both, no pairs."""
    both = known.select(*by, "pos", value, F.lit(None).alias("__w")).unionByName(wanted.select(*by, "pos", F.lit(None).alias(value), F.struct(*(c for c in wanted.columns if c not in by)).alias("__w")))
    upto = Window.partitionBy(*by).orderBy("pos", F.col("__w").isNotNull(), value).rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("__v", F.last(value, ignorenulls=True).over(upto)).where("__w is not null")
    return found.select(*by, "__w.*", F.col("__v").alias(value))


def bounds_sweep(counts: DataFrame, parts: list[int]) -> DataFrame:
    """(matrix, parts, t, lo, hi): the bounds for every number of partitions in parts.

    Partition t ends behind the row in which entry (t + 1) * step, counted
    from 1, lies. These thresholds, a small relation, are sought among the
    sums of ranges of rows first, and then among the rows of the ranges that
    are hit; all other rows are summed and no more.
    """
    every = F.array(*(F.lit(_parts(p)).cast("long") for p in parts))
    ranged = counts.withColumn("range", int_div(F.col("i"), WIDTH))
    ranges = ranged.groupBy("matrix", "range").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows"))
    upto = Window.partitionBy("matrix").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("pos", F.coalesce(F.sum("total").over(upto), F.lit(0)).cast("long"))

    totals = ranges.groupBy("matrix").agg(F.sum("rows").alias("rows"), F.sum("total").alias("nnz"))
    step = F.greatest(ceil_div(F.col("nnz"), F.col("p")), F.lit(1))
    sized = totals.select("matrix", "rows", "nnz", F.explode(every).alias("p")).withColumn("step", step)
    wanted = sized.where("nnz > step").select("matrix", F.col("p"), "step", F.explode(F.sequence(F.lit(1).cast("long"), int_div(F.col("nnz") - 1, F.col("step")))).alias("m"))
    wanted = wanted.select("matrix", F.col("p").cast("int").alias("p"), (F.col("m") - 1).cast("int").alias("at"), (F.col("m") * F.col("step") - 1).alias("pos"))
    hit = _latest(ranges.select("matrix", "pos", "range"), wanted, ["matrix"], "range")

    few = hit.select(F.col("matrix").alias("__m"), F.col("range").alias("__r")).distinct()
    start = ranges.join(few, (F.col("matrix") == F.col("__m")) & (F.col("range") == F.col("__r")), "left_semi").select(F.col("matrix").alias("__m"), F.col("range").alias("__r"), F.col("pos").alias("__start"))
    inside = Window.partitionBy("matrix", "range").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.join(start, (F.col("matrix") == F.col("__m")) & (F.col("range") == F.col("__r")))
    rows = rows.withColumn("pos", (F.col("__start") + F.coalesce(F.sum("n").over(inside), F.lit(0))).cast("long")).where("n > 0")
    found = _latest(rows.select("matrix", "range", "pos", F.col("i").cast("long").alias("i")), hit, ["matrix", "range"], "i").select(F.col("matrix").alias("__m"), "p", "at", (F.col("i") + 1).alias("hi"))

    slots = sized.select("matrix", "rows", "nnz", F.col("p").cast("int").alias("parts"), F.explode(F.sequence(F.lit(0), F.col("p").cast("int") - 1)).alias("t"))
    joined = slots.join(found, (F.col("matrix") == F.col("__m")) & (F.col("parts") == F.col("p")) & (F.col("t") == F.col("at")), "left")
    # Without entries the last partition owns all rows.
    end = F.when(F.col("nnz") == 0, F.when(F.col("t") == F.col("parts") - 1, F.col("rows")).otherwise(0)).otherwise(F.coalesce("hi", "rows")).cast("long")
    before = Window.partitionBy("matrix", "parts").orderBy("t")
    return joined.select("matrix", "parts", "t", end.alias("hi")).select("matrix", "parts", "t", F.coalesce(F.lag("hi").over(before), F.lit(0)).cast("long").alias("lo"), "hi")


def bounds_by_nnz(counts: DataFrame, parts: int) -> DataFrame:
    """(matrix, t, lo, hi) for each partition t, empty ones included."""
    return bounds_sweep(counts, [parts]).drop("parts")


def lower_bound(ptr: DataFrame, value: int) -> DataFrame:
    """(matrix, at): the first place in irp that is not under value."""
    return ptr.groupBy("matrix").agg(F.count_if(F.col("irp") < value).alias("at"))


def store_pointers(ptr: DataFrame, path: str, width: int = 1 << 16) -> None:
    """csr_ptr as Parquet under path, in folders of width pointers, with the least and largest of each folder beside."""
    ranged = ptr.withColumn("bucket", int_div(F.col("i"), width))
    ranged.repartition("bucket").sortWithinPartitions("bucket", "matrix", "i").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/pointers")
    stored = ptr.sparkSession.read.parquet(f"{path}/pointers")
    ends = stored.groupBy("matrix", "bucket").agg(F.min("irp").alias("least"), F.max("irp").alias("most"), F.max("i").alias("last"))
    ends.write.mode("overwrite").parquet(f"{path}/ends")


def stored_lower_bound(spark: SparkSession, path: str, value: int) -> DataFrame:
    """lower_bound of stored pointers, from the one folder of each matrix that holds it; behind the last pointer where all are under value."""
    ends = spark.read.parquet(f"{path}/ends")
    hit = ends.groupBy("matrix").agg(F.min(F.when(F.col("most") >= value, F.col("bucket"))).alias("in"), (F.max("last") + 1).alias("behind"))
    buckets = [r[0] for r in hit.select("in").where("in is not null").distinct().collect()]  # a number per matrix at most
    pointers = spark.read.parquet(f"{path}/pointers").where(F.col("bucket").isin(buckets) & (F.col("irp") >= value)).select(F.col("matrix").alias("__m"), F.col("bucket").alias("__b"), "i")
    found = pointers.groupBy("__m", "__b").agg(F.min("i").alias("at"))
    return hit.join(found, (F.col("matrix") == F.col("__m")) & (F.col("in") == F.col("__b")), "left").select("matrix", F.coalesce("at", "behind").alias("at"))


def block_bounds(blocks: DataFrame, parts: int) -> DataFrame:
    """(matrix, t, lo, hi): equal numbers of blocks for each partition t, the last ones maybe fewer or none."""
    totals = blocks.groupBy("matrix").agg(F.count(F.lit(1)).alias("n"))
    step = ceil_div(F.col("n"), _parts(parts))
    every = totals.select("matrix", "n", step.alias("step"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("t"))
    return every.select("matrix", "t", F.least(F.col("t") * F.col("step"), "n").alias("lo"), F.least((F.col("t") + 1) * F.col("step"), "n").alias("hi"))


def owner_of_block(blocks: DataFrame, parts: int) -> DataFrame:
    """blocks with owner: the partition of each block under block_bounds."""
    totals = blocks.groupBy(F.col("matrix").alias("__m")).agg(ceil_div(F.max("block") + 1, _parts(parts)).alias("__step"))
    return blocks.join(totals, F.col("matrix") == F.col("__m")).withColumn("owner", int_div(F.col("block"), F.col("__step")).cast("int")).drop("__m", "__step")


#: Rows and entries of an owner that a task takes at most.
SHARE = 1 << 22


def placed_items(coo: DataFrame, counts: DataFrame) -> tuple[DataFrame, int]:
    """(matrix, i, j, v, at, __items): entries, and one without column and value for each row of counts, with their place in the order of the rows; and the most items of a matrix.

    These places hold for any number of partitions; see deal_items. A coo
    without matrix is one matrix, whose name is no key to sort by.
    """
    by = [c for c in ("matrix",) if c in coo.columns]
    entries = coo.select(*by, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"), F.lit(1).alias("mark"))
    rows = counts.select(*by, F.col("i").cast("long").alias("i"), F.lit(None).cast("long").alias("j"), F.lit(0.0).alias("v"), F.lit(0).alias("mark"))
    placed, groups = groups_within(entries.unionByName(rows), by, ["i", "mark"], "at", "__items")
    return placed.drop("mark"), groups.agg(F.max("__n")).first()[0] or 0


def deal_items(placed: DataFrame, most: int, parts: int) -> DataFrame:
    """placed_items with owner, task and split, as distribute() gives them.

    The first and last place of every task are known from the numbers of items,
    so the rows that several tasks take are those at these places alone.
    """
    tasks = max(1, -(-most // (_parts(parts) * SHARE)))  # of an owner
    step = ceil_div(F.col("__items"), parts)
    share = ceil_div(F.col("__step"), tasks)
    owned = placed.withColumn("__step", step).withColumn("owner", int_div(F.col("at"), F.col("__step")).cast("int")).withColumn("__in", F.col("at") % F.col("__step"))
    owned = owned.withColumn("__share", int_div(F.col("__in"), share)).withColumn("task", (F.col("owner") * tasks + F.col("__share")).cast("int"))
    end = (F.col("__in") % share == 0) | ((F.col("__in") + 1) % share == 0) | (F.col("__in") == F.col("__step") - 1) | (F.col("at") == F.col("__items") - 1)
    ends = owned.where(end).select("matrix", "task", "i")
    shared = ends.groupBy(F.col("matrix").alias("__m"), F.col("i").alias("__i")).agg(F.count_distinct("task").alias("__tasks")).where("__tasks > 1")
    marked = owned.join(F.broadcast(shared), (F.col("matrix") == F.col("__m")) & (F.col("i") == F.col("__i")), "left")  # a row at most for each task's end
    return marked.select("matrix", "i", "j", "v", "owner", "task", F.col("__tasks").isNotNull().alias("split")).repartitionById(parts * tasks, "task")


def distribute(coo: DataFrame, counts: DataFrame, parts: int) -> DataFrame:
    """coo with owner, task and split, partition t holding what task t takes, and with one entry without column and value for each row of counts.

    Rows and entries together, in the order of the rows, are cut into parts
    equal runs, so no owner has more than another, wherever a run ends: a row
    of any number of entries may have several owners. An owner with more than
    SHARE of them has several tasks of equal runs, otherwise one. A row that
    several tasks take is split.
    """
    return deal_items(*placed_items(coo, counts), _parts(parts))


def distribute_blocks(blocks: DataFrame, parts: int) -> DataFrame:
    """hll_blocks with owner and task, partition t holding the blocks that task t takes.

    An owner has equal numbers of blocks; with more than SHARE cells and rows on
    average it has several tasks of equal runs of them, otherwise one.
    """
    sizes = blocks.where("at = 0").groupBy(F.col("matrix").alias("__m")).agg(ceil_div(F.max("block") + 1, _parts(parts)).alias("__step"), F.sum(F.greatest("cells", "nr")).alias("__size"))
    most = sizes.agg(F.max("__size")).first()[0] or 0
    tasks = max(1, -(-most // (parts * SHARE)))  # of an owner
    owned = blocks.join(F.broadcast(sizes.drop("__size")), F.col("matrix") == F.col("__m"))  # a row for each matrix
    owned = owned.withColumn("owner", int_div(F.col("block"), F.col("__step")).cast("int"))
    task = F.col("owner") * tasks + int_div(F.col("block") % F.col("__step"), ceil_div(F.col("__step"), tasks))
    return owned.withColumn("task", task.cast("int")).drop("__m", "__step").repartitionById(parts * tasks, "task")
