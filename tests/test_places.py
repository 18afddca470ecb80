import random

import pandas as pd
import pytest

from weftline.functions import tables
from weftline.functions.places import numbered, numbered_within


def test_places_follow_the_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(5), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int, id int").repartition(7)
    got = numbered(df, ["k", "v", "id"], "at").toPandas()
    assert sorted(got["at"]) == list(range(3000))
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2]))
    assert got.sort_values("at")["id"].tolist() == [r[2] for r in want]


def test_places_within_keys_and_equal_rows(spark):
    df = spark.createDataFrame([("hot", 1)] * 2000 + [("b", 2), ("b", 1), (None, 3)], "k string, v int").repartition(5)
    got = numbered_within(df, ["k"], ["v"], "at").toPandas()
    assert sorted(got[got.k == "hot"]["at"]) == list(range(2000))
    assert got[got.k == "b"].sort_values("at")["v"].tolist() == [1, 2]
    assert got[got.k.isna()]["at"].tolist() == [0]


def test_no_rows(spark):
    assert numbered(spark.createDataFrame([], "k string"), ["k"], "at").count() == 0


def test_no_window_over_a_key(spark):
    df = spark.range(100).selectExpr("id % 3 as k", "id")
    plan = numbered(df, ["k", "id"], "at")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan.split("Window", 1)[1] if "Window" in plan else True
    assert "windowspecdefinition(k" not in plan


def test_scratch_keeps_what_is_asked_for(spark):
    with tables.scratch() as keep:
        a, b = tables.cut(spark.range(3)), keep(tables.cut(spark.range(4)))
        with tables.scratch() as inner:
            c = inner(tables.cut(spark.range(5)))
        assert c.count() == 5
    assert b.count() == 4
    for gone in (a, c):
        with pytest.raises(Exception):
            gone.count()
    assert isinstance(b.toPandas(), pd.DataFrame)


def _settings(spark, **values):
    for k, v in values.items():
        spark.conf.set(k.replace("__", "."), v)
    return [k.replace("__", ".") for k in values]


def test_a_frequent_key_does_not_meet_in_one_task(spark):
    """Where nothing is broadcast, a key goes back to its rows by range, so it is in as many tasks as it has ranges."""
    names = _settings(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__enabled="false")
    try:
        df = spark.createDataFrame([("hot", v) for v in range(4000)] + [("b", 1)], "k string, v int").repartition(5)
        got = numbered_within(df, ["k"], ["v"], "at", "n").selectExpr("*", "spark_partition_id() as p").toPandas()
        hot = got[got.k == "hot"]
        assert (hot["at"] == hot["v"]).all() and set(hot["n"]) == {4000} and hot["p"].nunique() > 1
    finally:
        for name in names:
            spark.conf.unset(name)
