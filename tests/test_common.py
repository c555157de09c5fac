"""Joins of skewed keys and the checkpoint folder."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from cadenza import common


def test_join_spread(spark):
    rows = [("hot", i, "x") for i in range(3_000)] + [(f"k{i % 2_000}", i, "y") for i in range(3_000)] + [(None, 1, "z"), ("gone", 2, "z")]
    left = spark.createDataFrame(rows, "k string, i int, v string")
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(2_000)], "k string, w int")
    got = common.join_spread(left, right, ["k"], left.groupBy("k").agg(F.count("*").alias("n")))
    want = left.join(right, "k", "left")
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    empty = left.limit(0)
    assert common.join_spread(empty, right, ["k"], empty.groupBy("k").agg(F.count("*").alias("n"))).count() == 0


def test_a_cluster_must_name_its_folder():
    undefined = SimpleNamespace(isDefined=lambda: False)
    sc = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: undefined)), setCheckpointDir=lambda d: seen.append(d))
    seen = []
    spark = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: None))
    with pytest.raises(RuntimeError):
        common.ensure_checkpoint_dir(spark)
    spark.conf = SimpleNamespace(get=lambda k, d: "hdfs://shared/cp")
    common.ensure_checkpoint_dir(spark)
    assert seen == ["hdfs://shared/cp"]
