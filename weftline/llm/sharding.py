"""Shards by rendezvous hashing.

Every record key draws a number in each shard, an exponential one with the
shard's weight as its rate; the shard with the least draw has the record. A
draw depends on the key and the shard alone, so a shard that is added takes
records only into itself, about its share of the weight, one that is removed
gives up only its own, and a changed weight moves records only to or from that
shard. Nothing is shuffled to find a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.places import numbered_within
from weftline.llm.common import named


def _checked(weights: list[float]) -> list[float]:
    if not weights or min(weights) <= 0:
        raise ValueError("there must be shards, and their weights must be positive")
    return weights


def draw(key: Column, shard: int, weight: float) -> Column:
    """An exponential number with the rate weight, from 52 bits of the MD5 of key and shard."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{shard}")).cast("binary")), 1, 13), 16, 10).cast("long")
    return -F.log((bits + 0.5) / float(1 << 52)) / float(weight)


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard, from 0, of a record key (a null key counts as an empty one); of equal draws the least shard's wins."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    draws = [F.struct(draw(key, s, w).alias("draw"), F.lit(s).alias("shard")) for s, w in enumerate(_checked(weights))]
    return (draws[0] if len(draws) == 1 else F.least(*draws))["shard"]


def sharded(docs: DataFrame, weights: list[float], grown: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of docs.

    shard is that of the id; grown_shard what it would be with one more shard
    of the weight grown. slot counts a shard's rows from 0 by id and checksum,
    nulls first; it takes one sort of these few columns by ranges, so a shard,
    or an id, of any number of rows is spread over tasks. size is the text's
    UTF-8 bytes (of a null text none) and one more. Rows with one id, and all
    without an id, go together, whatever their texts; repeated rows get a slot
    each. An empty table gives an empty one; other columns are not read.
    """
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    key = named(id_col)
    rows = docs.select(
        key.alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, weights).alias("shard"),
        shard_of(key, [*weights, grown]).alias("grown_shard"),
    )
    placed = numbered_within(rows, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, weights: list[float], id_col: str = "doc_id") -> None:
    """docs as Parquet under path, a folder shard=N for each shard that has rows; rows stay where they are, so no shard passes through one task."""
    if "shard" in docs.columns:
        raise ValueError("docs has a column named shard")
    docs.withColumn("shard", shard_of(named(id_col), weights)).write.partitionBy("shard").mode("overwrite").parquet(path)


def moves(docs: DataFrame, before: list[float], after: list[float], id_col: str = "doc_id") -> DataFrame:
    """(shard, new_shard, rows): how many rows a change of shards moves from where to where; those that stay are left out."""
    both = docs.select(shard_of(named(id_col), before).alias("shard"), shard_of(named(id_col), after).alias("new_shard"))
    return both.where("shard <> new_shard").groupBy("shard", "new_shard").agg(F.count(F.lit(1)).alias("rows"))
