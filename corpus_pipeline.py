"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir) that works on all that the
stage before kept; its result is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import language_id, line_dedup, near_dup, packing, source_mixing
from weftline.llm.common import carried, cut, table

#: A document stays if its language is known with more than this posterior probability.
MIN_SCORE = 0.5
#: Sources at 95 % of the full entropy, as far as no token is taken more than 1.5 times; every document stays in.
MIX = source_mixing.Target(entropy=0.95, repeats=1.5)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or of no sure language go; the language that was found replaces lang.

    Null and empty texts have no letter, so they go. Nulls elsewhere, repeated
    rows and long texts stay as they are; of languages that tie, neither is
    sure. Without any labelled document nothing can be told, and all documents
    go; an empty table gives an empty one. Rows are carried as structs, so no
    name can clash.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = language_id.train(docs.where(~held_out))
    found = docs.select(carried(docs), language_id.predict(F.col("text"), model).alias("found"))
    sure = found.where((F.col("found.lang") != language_id.UNKNOWN) & (F.col("found.score") > MIN_SCORE))
    return sure.select(*(F.col("found.lang").alias(c) if c == "lang" else F.col("row").getField(c).alias(c) for c in docs.columns))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that too many pages of a source share go; n_chars follows.

    All documents stay. Pages with equal texts count once and a page of
    nothing but such lines stays whole, since copies are the next stage's to
    judge. Null texts and other columns pass through; null sources form one
    site; repeated rows are cleaned alike; an empty table gives an empty one;
    no name can clash.
    """
    return line_dedup.drop_boilerplate(docs, once=True, spare=True, chars_col="n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the least id, with all its columns.

    Groups are of texts: rows that share an id but no text are told apart, and
    copies without an id go like any others. Repeated rows are one; rows
    without words stay; an empty table gives an empty one; no name can clash.
    """
    return near_dup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of sources below their target weight come more than once.

    Null sources form one source; a document without tokens, or without an
    id, is taken like the others of its source; a source without any tokens
    has no weight and goes. Repeated rows are taken each; an empty table gives
    an empty one; no name can clash.
    """
    return source_mixing.apply_mixture(docs, MIX)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in sequences of 4096 tokens, every window with the sources' shares.

    A null or empty text is its end token alone; long ones are cut; repeated
    rows are packed each and apart; an empty table gives no pieces; columns
    beside id, text and source are not read.
    """
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_boilerplate),
    ("near-duplicate removal", drop_near_duplicates),
    ("source mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language identification has no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
