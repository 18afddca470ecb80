import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.llm import sharding

WEIGHTS = [1.0] * 8


def test_columns_slots_and_growth(spark):
    rows = [(i, f"text {i} é") for i in range(2000)] + [(5, "other"), (5, "text 5 é"), (None, "x"), (None, None), (7000, None), (7001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    out = sharding.sharded(df.withColumn("slot", F.lit(1)).withColumn("shard", F.lit("x")), WEIGHTS).toPandas()
    assert len(out) == len(rows)
    for _, own in out.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    assert Counter(zip(out["size"], out["text_crc32"])) == Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    moved = out[out["shard"] != out["grown_shard"]]
    assert (moved["grown_shard"] == 8).all() and 0.06 < len(moved) / len(out) < 0.17
    assert out.groupby("doc_id", dropna=False)["shard"].nunique().max() == 1
    assert (out["law"] == "key").all()


def test_weights_and_moves(spark):
    df = spark.range(20000).withColumnRenamed("id", "doc_id")
    share = {r[0]: r[1] / 20000 for r in df.groupBy(sharding.shard_of(F.col("doc_id"), [1.0, 2.0, 5.0]).alias("s")).count().collect()}
    assert abs(share[0] - 1 / 8) < 0.01 and abs(share[1] - 2 / 8) < 0.01 and abs(share[2] - 5 / 8) < 0.015
    gone = sharding.moves(df, WEIGHTS, WEIGHTS[:-1]).collect()
    assert {r["shard"] for r in gone} == {7} and {r["new_shard"] for r in gone} == set(range(7))
    heavier = sharding.moves(df, [1.0, 1.0, 1.0], [1.0, 3.0, 1.0]).collect()
    assert {r["new_shard"] for r in heavier} == {1}


def test_written_shards_hold_every_row(spark, tmp_path):
    df = spark.range(500).selectExpr("id as doc_id", "cast(id as string) as text")
    sharding.write_shards(df, str(tmp_path / "out"), WEIGHTS)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 500 and back.where(F.col("shard") != sharding.shard_of(F.col("doc_id"), WEIGHTS)).count() == 0
    with pytest.raises(ValueError):
        sharding.write_shards(back, str(tmp_path / "again"), WEIGHTS)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.sharded(empty, WEIGHTS).count() == 0
    for bad in ([], [1.0, 0.0]):
        with pytest.raises(ValueError):
            sharding.shard_of(F.lit("x"), bad)
    long = spark.createDataFrame([(1, "w " * 1_000_000)] * 3, "doc_id long, text string")
    out = sharding.sharded(long, [1.0]).collect()
    assert sorted(r["slot"] for r in out) == [0, 1, 2] and {r["size"] for r in out} == {2_000_001} and {r["shard"] for r in out} == {0}


def test_nothing_runs_in_python(spark):
    df = spark.range(10).selectExpr("id as doc_id", "cast(id as string) as text")
    plan = sharding.sharded(df, WEIGHTS)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
