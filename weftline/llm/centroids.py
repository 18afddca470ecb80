"""Clusters of vectors around centroids, in exact integers.

Vectors become whole numbers, floor(scale * x). Distances to all centroids are
|x|^2 - 2 x.c + |c|^2, one matrix product for each block of rows. It runs in
float64 where no sum can reach 2^53, so the result is exact and the same on
any machine and in any order; rows beyond that bound take 64-bit integers, and
those beyond 2^63 Python's. A round's sums by cluster are made where the rows
are and merged by a tree; only they reach the driver: k rows of the vectors'
width, however many vectors there are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import cut, named

EXACT, WORD = 1 << 53, 1 << 63
#: Rows that one matrix product takes.
BLOCK = 4096


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles, exactly: as 64-bit integers, or as Python's where one does not fit."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * float(scale))
    if not scaled.size or np.abs(scaled).max() < EXACT:
        return scaled.astype(np.int64)

    def exact(v: float) -> int:
        top, bottom = v.as_integer_ratio()
        return scale * top // bottom

    out = np.array([exact(v) for v in x.ravel().tolist()], object).reshape(x.shape)
    return out.astype(np.int64) if max(abs(v) for v in out.flat) < WORD // 2 else out


def _largest(a: np.ndarray) -> np.ndarray:
    """The largest magnitude in each row, as Python's integers where a holds them."""
    return np.abs(a).max(axis=1)


def _expanded(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of the nearest row of c for each row of x, the first of those that tie, and the squared distance (Python's integers, if need be)."""
    label = np.zeros(len(x), np.int64)
    distance = np.zeros(len(x), x.dtype)
    top = int(_largest(c).max()) if len(c) else 0
    width = x.shape[1]
    most = [math.isqrt((limit - 1) // max(width, 1)) - top for limit in (EXACT, WORD)]  # width * (|x| + |c|)^2 stays below the limit
    size = _largest(x)
    kinds = np.where(size <= most[0], 0, np.where(size <= most[1], 1, 2)).astype(int)
    if (kinds == 2).any() and distance.dtype != object:
        distance = distance.astype(object)
    for kind in np.unique(kinds):
        rows = np.flatnonzero(kinds == kind)
        to = (np.float64, np.int64, object)[kind]
        d = _expanded(x[rows].astype(to), c.astype(to))
        best = np.array(d.tolist(), object).argmin(axis=1) if kind == 2 else d.argmin(axis=1)
        label[rows] = best
        distance[rows] = d[np.arange(len(rows)), best.astype(int)] if kind == 2 else d[np.arange(len(rows)), best].astype(np.int64)
    return label, distance


def summed(x: np.ndarray, label: np.ndarray, k: int) -> dict[int, tuple[int, list[int]]]:
    """Rows and componentwise sums by label, exactly."""
    out = {}
    for one in np.unique(label):
        own = x[label == one]
        fits = own.dtype != object and int(np.abs(own).max(initial=0)) < WORD // max(len(own), 1)
        out[int(one)] = (len(own), [int(v) for v in (own if fits else own.astype(object)).sum(axis=0)])
    return out


def merged(a: dict, b: dict) -> dict:
    for k, (n, sums) in b.items():
        m, before = a.get(k, (0, [0] * len(sums)))
        a[k] = (m + n, [p + q for p, q in zip(before, sums, strict=True)])
    return a


@dataclass
class Centroids:
    """rows: k centroids of whole numbers; scale: what vectors are multiplied by."""

    rows: list[list[int]]
    scale: int

    def matrix(self) -> np.ndarray:
        fits = all(abs(v) < WORD // 2 for r in self.rows for v in r)
        return np.array(self.rows, np.int64 if fits else object)

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in self.rows]


def _blocks(batch: pa.RecordBatch, width: int, scale: int) -> Iterator[tuple[int, np.ndarray]]:
    for lo in range(0, batch.num_rows, BLOCK):
        part = batch.column("embedding").slice(lo, BLOCK)
        yield lo, whole(part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), width), scale)


def usable(vector: Column, width: int) -> Column:
    """Whether a vector has exactly width components, none null or non-finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(vector) == width) & finite, F.lit(False))


def first_centroids(vectors: DataFrame, k: int, salt: str, scale: int) -> Centroids:
    """The k vectors with the least SHA-256 of '<salt>:<vec_id>', in that order; of rows with one id, the lesser vectors first."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    found = vectors.orderBy(key, "embedding").limit(k).select("embedding").collect()
    return Centroids([[int(v) for v in whole(np.array([r["embedding"]], np.float64), scale)[0]] for r in found], scale)


def moved(vectors: DataFrame, centroids: Centroids, width: int) -> Centroids:
    """The centroids after a round: each the floor of its vectors' mean, or as it was if it has none."""
    k = len(centroids.rows)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, found = centroids.matrix(), {}
        for b in batches:
            for _, x in _blocks(b, width, centroids.scale):
                found = merged(found, summed(x, nearest(x, c)[0], k))
        if found:
            rows = [(key, n, list(map(str, sums))) for key, (n, sums) in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.list_(pa.string())))], ["cluster", "n", "sums"])

    parts = vectors.select("embedding").mapInArrow(partial, "cluster int, n long, sums array<string>")
    sums = parts.rdd.treeAggregate({}, lambda acc, r: merged(acc, {r["cluster"]: (r["n"], [int(v) for v in r["sums"]])}), merged)
    return Centroids([[v // sums[j][0] for v in sums[j][1]] if j in sums else row for j, row in enumerate(centroids.rows)], centroids.scale)


def _assigned(vectors: DataFrame, centroids: Centroids, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centroids.matrix()
        for b in batches:
            for lo, x in _blocks(b, width, centroids.scale):
                label, distance = nearest(x, c)
                fitting = pa.array([int(v) if v < WORD else None for v in distance], pa.int64()) if distance.dtype == object else pa.array(distance)
                yield pa.RecordBatch.from_arrays([b.column("vec_id").slice(lo, len(x)), pa.array(label.astype(np.int32)), fitting], ["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, width: int, k: int = 16, rounds: int = 3, scale: int = 64, salt: str = "1", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector.

    Vectors of another width, null ones and those with a null or non-finite
    component are left out. Rows without an id, and repeated rows, count and
    come out each. Of fewer than k vectors each is a centroid; without any the
    result is empty. Ties go to the smaller number. A distance, or a sum of
    distances, that no 64-bit integer holds is null; the assignment is right
    all the same. Other columns are not read. vectors is read rounds + 2
    times, so cut it first if it is costly to make. scale is a power of two,
    by which a product with a double is exact.
    """
    if scale <= 0 or scale & (scale - 1):
        raise ValueError("scale must be a power of two")
    kept = vectors.select(named(id_col).cast("long").alias("vec_id"), named(vector_col).alias("embedding")).where(usable(F.col("embedding"), width))
    centroids = first_centroids(kept, k, salt, scale)
    for _ in range(rounds if centroids.rows else 0):
        centroids = moved(kept, centroids, width)
    if not centroids.rows:
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    found = cut(_assigned(kept, centroids, width))
    total = lambda c: F.when(F.count_if(F.col(c).isNull()) == 0, F.sum(F.col(c).cast("decimal(38,0)")))
    by = found.groupBy(F.col("cluster").alias("c")).agg(total("distance").alias("own"))
    every = Window.partitionBy()  # over k rows
    by = by.withColumn("all", F.when(F.count_if(F.col("own").isNull()).over(every) == 0, F.sum("own").over(every)))
    names = vectors.sparkSession.createDataFrame(list(enumerate(centroids.digests())), "number int, centroid_sha256 string")
    by = by.join(names, F.col("c") == F.col("number"))
    fits = lambda c, out: F.col(c).try_cast("long").alias(out)
    return found.join(F.broadcast(by), F.col("cluster") == F.col("c")).select("vec_id", "cluster", "distance", fits("own", "cluster_inertia"), fits("all", "inertia"), "centroid_sha256")
