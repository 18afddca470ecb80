"""Importance resampling of documents towards a target.

Texts are tokenised once; the hashed n-grams of each, packed, form a table in
the shared folder. Two models are counted over it, of the target documents and
of all documents; a document's log importance weight is the log ratio of its
n-grams' probabilities. Gumbel noise drawn from a hash of the id is
added, and the top k are the sample: sampling without replacement in
proportion to the weights, the same at every run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut, named

#: Runs of word characters or of other signs.
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Bytes of tokens, and of what goes with each, whose hashes a worker keeps at once.
CACHE = 16 << 20
#: Ids of a target that are broadcast; more are joined as Spark sees fit.
BROADCAST = 1 << 18
#: Texts that an answer batch holds.
ROWS = 1000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Buckets(dict):
    """Token -> hash; text -> the buckets of its unigrams and bigrams."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets, self.used = np.uint64(buckets), 0

    def __missing__(self, token: str) -> int:
        if self.used > CACHE:
            self.clear()
            self.used = 0
        self[token] = h = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))
        self.used += len(token) + 180
        return h

    def grams(self, text: str | None) -> np.ndarray:
        tokens = TOKEN.findall(text.lower()) if text else []
        h = np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))
        two = (h[:-1] ^ (h[:-1] >> np.uint64(31))) * _MIX + h[1:]
        return (np.concatenate([h, two ^ (two >> np.uint64(29))]) % self.buckets).astype(np.int64)


def hashed(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """(doc_id, n_grams, grams): the buckets of each text's n-grams, compressed, as a table written once."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pack = _Buckets(buckets), zstandard.ZstdCompressor(level=1)
        for b in batches:
            texts = b.column("text")
            for lo in range(0, b.num_rows, ROWS):
                grams = [known.grams(texts[i].as_py()) for i in range(lo, min(lo + ROWS, b.num_rows))]
                packed = [pack.compress(g.astype(kind).tobytes()) if len(g) else None for g in grams]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, ROWS), pa.array([len(g) for g in grams], pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "n_grams", "grams"])

    rows = docs.select(named(id_col).cast("long").alias("doc_id"), F.make_valid_utf8(named(text_col)).alias("text"))
    return cut(rows.mapInArrow(run, "doc_id long, n_grams long, grams binary"))


def _unpacked(packed: list[bytes | None], buckets: int) -> Iterator[np.ndarray]:
    unpack, kind = zstandard.ZstdDecompressor(), np.dtype("<u2" if buckets <= 1 << 16 else "<u4")
    for x in packed:
        yield np.frombuffer(unpack.decompress(x), kind) if x is not None else np.empty(0, kind)


def _counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            for g, chosen in zip(_unpacked((x.as_py() for x in b.column("grams")), buckets), b.column("target").to_pylist(), strict=True):
                n = np.bincount(g, minlength=buckets)
                raw += n
                if chosen:
                    target += n
        some = np.flatnonzero(raw)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    return run


def log_ratio(grams: DataFrame, target_ids: DataFrame, buckets: int, smooth: float = 1.0) -> np.ndarray:
    """Per bucket, the log of the target model's probability over that of all documents.

    target_ids: one column. A task returns at most one row per bucket and the
    driver gets one per bucket.
    """
    ids = target_ids.select(named(target_ids.columns[0]).alias("__id"), F.lit(True).alias("target")).where("__id is not null").distinct()
    if ids.count() <= BROADCAST:
        ids = F.broadcast(ids)
    rows = grams.join(ids, F.col("doc_id") == F.col("__id"), "left")
    counts = rows.select("grams", F.coalesce("target", F.lit(False)).alias("target")).mapInArrow(_counts(buckets), "bucket long, raw long, target long")
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in counts.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():
        raw[r[0]], target[r[0]] = r[1], r[2]
    if not target.sum():
        return np.zeros(buckets)
    raw, target = raw + smooth, target + smooth * target.sum() / max(raw.sum(), 1)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def _weights(ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [float(ratio[g].sum()) for g in _unpacked((x.as_py() for x in b.column("grams")), len(ratio))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_grams"), pa.array(found, pa.float64())], ["doc_id", "n_grams", "log_weight"])

    return run


def gumbel(id_col: Column, seed: int) -> Column:
    """Standard Gumbel noise fixed by the id."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_col), 11) + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, column: str, k: int, n: int, few: int = 4096, bins: int = 1024) -> float:
    """The k-th largest value of column in n rows, exactly, by narrowing a histogram; at most few values come to the driver."""
    x = F.col(column)
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    while n > few and lo < hi:
        inside = df.where(x.between(lo, hi))
        at = F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1))
        for _, count, low, high in sorted(inside.groupBy(at.alias("b")).agg(F.count(x), F.min(x), F.max(x)).collect(), reverse=True):
            if k <= count:
                break
            k -= count
        n, lo, hi = count, low, high
    if lo == hi:
        return lo
    return sorted((r[0] for r in df.where(x.between(lo, hi)).select(x).collect()), reverse=True)[k - 1]


def resample(docs: DataFrame, target_ids: DataFrame, share: float = 0.8, id_col: str = "doc_id", text_col: str = "text", buckets: int = 10_000, seed: int = 17) -> DataFrame:
    """(doc_id, n_grams, log_weight, sample_key, kept) for each row of docs.

    kept: the row is among the round(share * rows) with the largest keys;
    rows that tie with the last of them are kept too, so repeated rows fare
    alike, as do rows without an id of equal weight. A null or empty text has
    weight 1 (log 0); a long one is counted whole; invalid UTF-8 counts as
    replacement characters. Without a target all weights are 1. An empty table
    gives an empty one. Other columns of docs are not read.
    """
    grams = hashed(docs, id_col, text_col, buckets)
    ratio = log_ratio(grams, target_ids, buckets)
    scored = cut(grams.mapInArrow(_weights(ratio), "doc_id long, n_grams long, log_weight double").withColumn("sample_key", F.col("log_weight") + gumbel(F.col("doc_id"), seed)))
    n = scored.count()
    k = round(share * n)
    kept = F.col("sample_key") >= kth_largest(scored, "sample_key", k, n) if k else F.lit(False)
    return scored.select("doc_id", "n_grams", "log_weight", "sample_key", kept.alias("kept"))


def labelled(labels: DataFrame, condition: Column, id_col: str = "doc_id", most: int = 4096) -> DataFrame:
    """At most most distinct ids of labels where condition holds, chosen by a hash."""
    ids = labels.where(condition & named(id_col).isNotNull()).select(named(id_col).alias("id")).distinct()
    return ids.orderBy(F.xxhash64(F.lit("target"), "id"), "id").limit(most)
