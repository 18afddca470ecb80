"""Lines that many pages of one site share.

A line's ratio is the number of the host's pages that hold it, divided by the
number of the host's pages. Lines over the ratio are dropped, if at least two
pages hold them: what stands on one page alone is shared with nothing, however
few pages the host has.

Two exemptions are there for callers that remove duplicate documents
afterwards and must not have them emptied before; both are off unless asked
for. once counts pages with the same text as one page, so that copies of a
page do not make its lines boilerplate. spare leaves a page whole that has
nothing but such lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import WORD, carried, cut, named


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate(docs: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = 0.05, least: int = 2, once: bool = False) -> DataFrame:
    """(host, flags): per host with boilerplate, the hashes of its boilerplate lines.

    Shuffled are line hashes per host, counted where the pages are, never
    texts. A host's list is short by arithmetic: at most the mean number of
    lines of its pages divided by ratio.
    """
    pages = docs.select(named(host_col).alias("host"), named(text_col).alias("text")).where("text is not null")
    hashed = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: x.rlike(WORD)), lambda x: F.xxhash64(x)))
    if once:
        pages = pages.select("host", F.xxhash64("text").alias("page"), "text")
        number, page = F.count_distinct("page"), ["page"]
    else:
        number, page = F.count(F.lit(1)), []
    totals = pages.groupBy("host").agg(number.alias("pages")).select(F.col("host").alias("of"), "pages")
    counts = pages.select("host", *page, F.explode(hashed).alias("line")).groupBy("host", "line").agg(number.alias("n")).where(F.col("n") >= least)
    shared = counts.join(totals, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") > ratio * F.col("pages"))
    return cut(shared.groupBy("host").agg(F.collect_list("line").alias("flags")))


def cleaned(docs: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = 0.05, least: int = 2, once: bool = False, spare: bool = False) -> DataFrame:
    """(row, text, n_lines, n_dropped) for each row of docs: the row as a struct, its text without boilerplate, and what that took.

    Blank lines are never boilerplate and stay, as does the order of lines.
    A null text stays null, with no lines; an empty one has one blank line.
    Null hosts form one host. Repeated rows are pages each and are cleaned
    alike; texts are taken whole, however long. An empty table gives an empty
    one. The row is a struct, so no name of its columns can clash.
    """
    flags = boilerplate(docs, text_col, host_col, ratio, least, once)
    rows = docs.select(carried(docs), named(text_col).alias("text"), named(host_col).alias("from"))
    rows = rows.join(flags, F.col("from").eqNullSafe(F.col("host")), "left")
    bad = lambda x: x.rlike(WORD) & F.array_contains("flags", F.xxhash64(x))
    left = F.when(F.col("flags").isNotNull() & F.col("text").isNotNull(), F.filter(_lines(F.col("text")), lambda x: ~F.coalesce(bad(x), F.lit(False))))
    rows = rows.select("row", "text", F.coalesce(F.size(_lines(F.col("text"))), F.lit(0)).alias("n_lines"), left.alias("left"))
    gone = F.col("n_lines") - F.size("left")
    some = gone > 0
    if spare:
        some &= F.exists("left", lambda x: x.rlike(WORD))
    some = F.coalesce(F.col("left").isNotNull() & some, F.lit(False))
    return rows.select("row", F.when(some, F.array_join("left", "\n")).otherwise(F.col("text")).alias("text"), F.col("n_lines").cast("long"), F.when(some, gone).otherwise(0).cast("long").alias("n_dropped"))


def drop_boilerplate(docs: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = 0.05, least: int = 2, once: bool = False, spare: bool = False, chars_col: str | None = None) -> DataFrame:
    """docs with text_col cleaned; see cleaned(). chars_col: a column that follows the length of cleaned texts. All else passes through as it is."""
    out = cleaned(docs, text_col, host_col, ratio, least, once, spare)
    row = F.col("row").getField

    def column(c: str) -> Column:
        if c == text_col:
            return F.col("text").alias(c)
        if c == chars_col:
            return F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(row(c)).cast(docs.schema[c].dataType).alias(c)
        return row(c).alias(c)

    return out.select(*map(column, docs.columns))
