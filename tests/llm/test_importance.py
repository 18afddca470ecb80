import math
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import importance as im

SCHEMA = "doc_id long, text string, kept string"


def rows():
    rng = random.Random(9)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randrange(5, 40)))
    bad = lambda: " ".join(rng.choice(["$$$", "alpha", "***", "zeta"]) for _ in range(rng.randrange(5, 40)))
    return [(i, good() if i % 4 else bad(), "x") for i in range(200)]


def plain_grams(text, buckets):
    """Buckets of 1- and 2-grams, in whole numbers."""
    h = [xxhash.xxh64_intdigest(t) for t in re.findall(r"\w+|[^\w\s]+", (text or "").lower())]
    top = 1 << 64
    two = [((a ^ a >> 31) * 0x9E3779B97F4A7C15 + b) % top for a, b in zip(h, h[1:])]
    return np.array([x % buckets for x in h] + [(x ^ x >> 29) % buckets for x in two], int)


def id_hash(doc_id, seed=17):
    """Spark's 64-bit hash of an int and a long, each seeding the next, from 42 on."""
    h = xxhash.xxh64_intdigest(seed.to_bytes(4, "little", signed=True), seed=42)
    return xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), seed=h)


def plain(data, target, buckets):
    grams = [plain_grams(t, buckets) for _, t, _ in data]
    raw = sum(np.bincount(g, minlength=buckets) for g in grams) + 1.0
    aim = sum(np.bincount(g, minlength=buckets) for (i, *_), g in zip(data, grams) if i in target).astype(float)
    aim += aim.sum() / (raw.sum() - buckets)
    ratio = np.log(aim / aim.sum()) - np.log(raw / raw.sum())
    return [float(ratio[g].sum()) for g in grams]


def test_weights_equal_loops_and_top_k_is_exact(spark):
    data = rows()
    target = {i for i, *_ in data if i % 8 in (1, 3)}
    docs = spark.createDataFrame(data, SCHEMA)
    got = im.resample(docs, spark.createDataFrame([(i,) for i in target], "id long"), share=0.6, buckets=500).orderBy("doc_id").collect()
    assert np.allclose([r.log_weight for r in got], plain(data, target, 500))
    noise = {i: -math.log(-math.log(((id_hash(i) >> 11) + 0.5) / (1 << 53))) for i, *_ in data[:20]}
    assert all(r.sample_key == pytest.approx(r.log_weight + noise[r.doc_id]) for r in got if r.doc_id in noise)
    keys = sorted((r.sample_key for r in got), reverse=True)
    assert {r.doc_id for r in got if r.kept} == {r.doc_id for r in got if r.sample_key >= keys[119]} and sum(r.kept for r in got) == 120
    good = [r.kept for r in got if r.doc_id % 4]
    assert np.mean(good) > 0.75 and not any(r.kept for r in got if r.doc_id % 4 == 0 and r.n_grams > 30)


def test_gumbel_noise(spark):
    noise = np.array([r[0] for r in spark.range(4000).select(im.gumbel(F.col("id"), 1)).collect()])
    assert abs(noise.mean() - 0.5772) < 0.1 and abs(noise.var() - np.pi**2 / 6) < 0.2


@settings(max_examples=10, deadline=None)
@given(st.lists(st.one_of(st.floats(-1e6, 1e6), st.sampled_from([0.0, 1.5])), min_size=1, max_size=60), st.data())
def test_kth_largest(spark, values, data):
    k = data.draw(st.integers(1, len(values)))
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert im.kth_largest(df, "x", k, len(values), few=4, bins=3) == sorted(values, reverse=True)[k - 1]


def test_odd_names_and_broken_text(spark):
    docs = spark.sql("select 1L as `i.d`, cast(unhex('61ff62') as string) as `te``xt`, 2 as doc_id, 3 as grams")
    got = im.resample(docs, spark.createDataFrame([(1,)], "`t.i` long"), 1.0, "i.d", "te`xt").collect()
    assert [(r.doc_id, r.n_grams, r.kept) for r in got] == [(1, 5, True)]


def test_edges(spark):
    none = spark.createDataFrame([], "id long")
    assert im.resample(spark.createDataFrame([], SCHEMA), none).collect() == []
    got = im.resample(spark.createDataFrame([(1, None, ""), (2, "", ""), (3, "a b " * 50_000, ""), (3, "a b " * 50_000, "")], SCHEMA), none, share=0.75).collect()
    assert [r.log_weight for r in got] == [0.0] * 4 and sum(r.kept for r in got) >= 3
    assert len({r.kept for r in got if r.doc_id == 3}) == 1


def test_labelled_is_bounded(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(1, 1), (None, 1)], "doc_id long, quality int")
    ids = [r.id for r in im.labelled(labels, F.col("quality") == 1, most=10).collect()]
    assert len(set(ids)) == len(ids) == 10 and all(i % 2 for i in ids)


def test_no_share_keeps_nothing(spark):
    with_none = im.resample(spark.createDataFrame(rows()[:5], SCHEMA), spark.createDataFrame([], "id long"), share=0.0)
    assert not any(r.kept for r in with_none.collect())
