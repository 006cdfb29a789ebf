"""What the shared helpers of the training-data operators leave behind."""

import time

from pyspark.sql import functions as F

from cohera.llm.common import materialized


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in files.mkString("\n").split("\n") if "/shuffle_" in f}


def test_finished_passes_leave_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    x, first = spark.range(5000), None
    for _ in range(4):
        x = materialized(x.groupBy((F.col("id") + 1).alias("id")).count().select("id"))
        first = first or _shuffle_files(spark) - before
    assert first and x.count() == 5000
    end = time.time() + 8
    while first & _shuffle_files(spark) and time.time() < end:  # the cleaner works beside the driver
        time.sleep(0.2)
    assert not first & _shuffle_files(spark)
