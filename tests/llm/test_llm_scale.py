"""Joins of hot keys, and checkpoints that go."""

from pyspark.sql import functions as F

from plumbline.llm import common

def rows(df):
    return sorted(map(str, df.collect()))


def test_join_counted(spark, monkeypatch):
    left = spark.createDataFrame([(i % 7 if i < 100 else 9, i) for i in range(300)], "k long, v long")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("k <> 3")
    plain = rows(left.join(right, "k").select("k", "v", "c"))
    for hot in (1, 3, 1_000):
        monkeypatch.setattr(common, "HOT", hot)
        assert rows(common.join_counted(left, right, ["k"], "c", 300).select("k", "v", "c")) == plain


def test_checkpoints_are_deleted(spark):
    held = common.checkpoint(spark.range(3))
    files = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = spark._jvm.org.apache.hadoop.fs.Path(files)
    count = lambda: len(path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path))
    many = count()
    common.release(held)
    assert count() == many - 1
