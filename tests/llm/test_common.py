from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tapewright.llm.common import frequent, materialize, release, shared_dir, spread_join


class Context:
    def __init__(self, master="local[2]"):
        self.folder, self.master = None, master

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def session(setting, **context):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: setting or default), sparkContext=Context(**context))


def test_shared_dir_follows_the_setting():
    spark = session("/shared/folder")
    assert shared_dir(spark) == "/shared/folder" and spark.sparkContext.folder is None


def test_shared_dir_is_made_once_where_unset():
    spark = session(None)
    made = shared_dir(spark)
    assert made and shared_dir(spark) == made == spark.sparkContext.folder


def test_shared_dir_has_to_be_named_on_a_cluster():
    with pytest.raises(ValueError):
        shared_dir(session(None, master="spark://somewhere:7077"))


def test_release_deletes_what_was_written(spark):
    t = materialize(spark.range(5))
    files = t.inputFiles()
    assert t.count() == 5 and files
    release(t, spark.range(3))
    with pytest.raises(Exception):
        spark.read.parquet(*files).count()


def test_frequent_keys_are_few_and_spread_join_keeps_all(spark):
    left = spark.range(100_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    hot = frequent(left, "k")
    assert [r.k for r in hot.collect()] == [7]
    right = left.select("k").distinct().withColumn("v", F.col("k") + 1)
    joined = spread_join(left, right, "k", "id", hot)
    assert joined.count() == 100_000 and joined.filter("v <> k + 1").count() == 0 and sorted(joined.columns) == ["id", "k", "v"]
