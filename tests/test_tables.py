import pytest

from weftline.functions import tables


class _Cluster:
    """A session on a cluster without spark.checkpoint.dir."""

    class conf:
        get = staticmethod(lambda key, default: default)

    class sparkContext:
        master = "local-cluster[2,1,1024]"

        class getConf:
            get = staticmethod(lambda key: None)


def test_a_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(ValueError):
        tables.shared_dir(_Cluster)


def test_tables_are_written_and_released(spark):
    df = tables.cut(spark.range(5))
    assert df.count() == 5
    tables.release(df)
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0]).count()


def test_odd_names(spark):
    df = spark.sql("select 1 as `a.b`, 2 as `c``d`, 3 as e")
    back = df.select(tables.carried(df)).select("row.*")
    assert back.columns == df.columns and df.select(tables.named("c`d")).first()[0] == 2


def test_text_files(spark, tmp_path):
    path = str(tmp_path / "x" / "log.txt")
    tables.append_text(spark, path, ["a"])
    tables.append_text(spark, path, ["b", "é"])
    assert open(path).read() == "a\nb\né\n"
