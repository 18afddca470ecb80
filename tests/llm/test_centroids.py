import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import centroids


def brute(rows, width, k, rounds, scale=64, salt="1"):
    kept = [(i, [math.floor(Fraction(x) * scale) for x in v], v) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{salt}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))[:k]
    c = [v for _, v, _ in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in enumerate(c))
    for _ in range(rounds):
        own = [[v for _, v, _ in kept if near(v)[1] == j] for j in range(len(c))]
        c = [[sum(col) // len(o) for col in zip(*o)] if o else old for o, old in zip(own, c)]
    found = [(i, *reversed(near(v))) for i, v, _ in kept]
    sums = [sum(d for _, j, d in found if j == n) for n in range(len(c))]
    fits = lambda v: v if v < 1 << 63 else None
    sha = [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in c]
    every = sum(d for _, _, d in found)
    whole = all(d < 1 << 63 for _, _, d in found)
    ok = [all(d < 1 << 63 for _, j, d in found if j == n) for n in range(len(c))]
    return sorted([(i, j, fits(d), fits(sums[j]) if ok[j] else None, fits(every) if whole else None, sha[j]) for i, j, d in found], key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(0, 3, 6)]) for i in range(300)]
    rows += [(7, rows[7][1]), (None, rows[3][1]), (400, None), (401, [1.0] * 5), (402, [1.0] * 5 + [None]), (403, [float("nan")] * 6), (404, [float("inf")] * 6), (405, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    clash = df.withColumn("cluster", F.lit("x")).withColumn("distance", F.lit(1))
    assert rows_of(centroids.cluster(clash, 6, k=5, rounds=3)) == brute(rows, 6, 5, 3)


@pytest.mark.parametrize("size", [1e6, 1e9, 1e17, 1e300])
def test_large_numbers_are_exact(spark, size):
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in rng.normal(0, size if i % 3 else 1, 4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert rows_of(centroids.cluster(df, 4, k=4, rounds=2)) == brute(rows, 4, 4, 2)


def test_ties_and_few_vectors(spark):
    rows = [(i, [0.0, 1.0]) for i in range(4)] + [(9, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert rows_of(centroids.cluster(df, 2, k=16, rounds=3)) == brute(rows, 2, 16, 3)
    assert centroids.cluster(df, 3).count() == 0
    assert centroids.cluster(df.limit(0), 2).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(ValueError):
        centroids.cluster(df, 2, scale=3)


def test_bounds_choose_the_arithmetic():
    c = np.array([[0, 0], [5, 5]])
    for big in (10, 1 << 26, 1 << 30, 1 << 40):
        x = np.array([[big, -big], [4, 4]], np.int64)
        label, distance = centroids.nearest(x, c)
        assert label.tolist() == [0 if 2 * big * big <= (big - 5) ** 2 + (big + 5) ** 2 else 1, 1]
        assert [int(d) for d in distance] == [2 * big * big, 2]
