"""Helpers of the session."""

import os

import pytest
from pyspark.sql import functions as F

from newsflow import session as S


def test_the_setting_is_put_back(spark):
    for before in (None, "false"):
        if before:
            spark.conf.set(S.SHUFFLE_CLEANUP, before)
        with S.shuffles_removed(spark):
            assert spark.conf.get(S.SHUFFLE_CLEANUP) == "true"
        assert spark.conf.get(S.SHUFFLE_CLEANUP, None) == before
        with pytest.raises(ValueError), S.shuffles_removed(spark):
            raise ValueError
        assert spark.conf.get(S.SHUFFLE_CLEANUP, None) == before
    spark.conf.unset(S.SHUFFLE_CLEANUP)


def test_a_written_table_leaves_no_shuffle(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    def shuffles():
        names = map(os.path.basename, manager.getAllFiles().mkString("|").split("|"))
        return {f for f in names if f.startswith("shuffle_")}

    before = shuffles()
    table = S.materialize(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "counts")
    assert table.count() == 10
    # the count's own shuffle may be left, the table's is gone
    assert len({f.split("_")[1] for f in shuffles() - before}) <= 1
