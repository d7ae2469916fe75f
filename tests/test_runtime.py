"""Where stored stages go."""

from types import SimpleNamespace

import pytest

from linkrank import runtime


def fake(master, named=None):
    conf = {"spark.checkpoint.dir": named} if named else {}
    return SimpleNamespace(
        conf=SimpleNamespace(get=conf.get),
        sparkContext=SimpleNamespace(master=master, applicationId="app-1"),
    )


def test_the_named_folder_wins():
    assert runtime.shared_dir(fake("yarn", "hdfs://shared/x")) == "hdfs://shared/x"
    assert runtime.scratch_path(fake("yarn", "hdfs://shared/x/"), "stage").startswith(
        "hdfs://shared/x/linkrank/app-1/stage-"
    )


def test_a_cluster_without_a_named_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_dir(fake("spark://host:7077"))


def test_a_local_master_gets_one_folder():
    spark = fake("local[2]")
    assert runtime.shared_dir(spark) == runtime.shared_dir(spark)


def test_materialize_keeps_rows_and_types(spark):
    df = spark.sql("SELECT 1 AS a, 'x' AS b, array(1, 2) AS c UNION ALL SELECT null, '', null")
    stored = runtime.materialize(df)
    assert stored.dtypes == df.dtypes
    assert sorted(map(str, stored.collect())) == sorted(map(str, df.collect()))
