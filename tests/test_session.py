from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from martloom.session import drop_scratch, list_folder, run_together, scratch_path, scratch_root, stage, use_scratch


def fake(application, setting=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: setting or default),
        sparkContext=SimpleNamespace(master="local[2]", applicationId=application),
    )


def test_scratch_folder_is_the_named_one():
    assert scratch_root(fake("app-1", "hdfs://n/check/")) == "hdfs://n/check"
    with pytest.raises(RuntimeError):
        scratch_root(fake("app-1"))
    use_scratch(fake("app-2"), "/shared/x/")
    assert scratch_root(fake("app-2")) == "/shared/x"
    assert scratch_root(fake("app-2", "hdfs://n/check")) == "hdfs://n/check"


def test_stage_and_drop(spark):
    path = scratch_path(spark, "t")
    df = stage(spark.range(10).withColumn("r", F.monotonically_increasing_id()), "t", path)
    assert df.count() == 10 and list_folder(spark, path)
    drop_scratch(spark, path)
    assert list_folder(spark, path) == []
    with pytest.raises(ValueError):
        drop_scratch(spark, "/somewhere/else")


def test_run_together_keeps_order():
    assert run_together([lambda i=i: i for i in range(10)]) == list(range(10))
