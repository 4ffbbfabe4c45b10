from types import SimpleNamespace

import pytest

from tallyspark.llm import shared


def session(**settings):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, other=None: settings.get(key.replace(".", "_"), other)))


def test_scratch_is_the_folder_the_session_names():
    assert shared.scratch(session(spark_checkpoint_dir="s3a://bucket/x/", spark_master="spark://host:7077")) == "s3a://bucket/x"
    for master in ("local", "local[4]", "local[*]", "local[2, 3]"):
        assert shared.scratch(session(spark_master=master)).startswith("file://")
    for master in ("local-cluster[3,2,1024]", "spark://host:7077", "yarn", "k8s://https://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared.scratch(session(spark_master=master))


def test_names_that_are_not_taken():
    assert shared.unused(["a", "ROW", "row_0"], "row", "row", "id") == ("row_1", "row_2", "id")


def test_columns_of_any_name(spark):
    df = spark.range(2).selectExpr("id AS `a.b`", "id AS `c``d`")
    assert shared.pick(df, x="a.b", y="c`d").columns == ["x", "y"] and df.select(shared.quoted("c`d")).count() == 2
