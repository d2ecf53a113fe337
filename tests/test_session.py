import threading
import time
from pathlib import Path

from pyspark.sql import functions as F

from pavilion.plans import models
from pavilion.session import shuffles_released, written

SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark):
    homes = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {p for home in homes for p in Path(home).glob("*/shuffle_*.data")}


def left_over(spark, before, seconds=20):
    """Shuffle files that are there still after a while; Spark deletes them when it finds time."""
    until = time.time() + seconds
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    return left


def test_a_write_leaves_no_shuffle_files(spark):
    before, own = shuffle_files(spark), spark.conf.get(SETTING)
    numbers = spark.range(20_000).select((F.col("id") * 7 % 5_000).alias("k"), "id")
    sums = numbers.groupBy("k").agg(F.sum("id").alias("s"))
    got = written(sums, "released")
    assert not left_over(spark, before)
    assert spark.conf.get(SETTING) == own
    assert got.count() == 5_000 and got.agg(F.sum("s")).first()[0] == 20_000 * 19_999 // 2
    assert sums.count() == 5_000  # what was written can be asked again


def test_preparation_leaves_no_shuffle_files(spark):
    table = spark.range(3_000).select((F.col("id") * 7 % 1_009).cast("double").alias("x"), F.concat(F.lit("t"), F.col("id") % 3).alias("team"))
    before = shuffle_files(spark)
    models.prepare(table, ["team"], ["x"])
    assert not left_over(spark, before)


def test_the_last_of_two_writes_restores_the_setting(spark):
    own, inside, go = spark.conf.get(SETTING), threading.Event(), threading.Event()

    def other():
        with shuffles_released(spark):
            inside.set()
            go.wait(20)

    thread = threading.Thread(target=other)
    with shuffles_released(spark):
        thread.start()
        assert inside.wait(20)
    assert spark.conf.get(SETTING) == "true"
    go.set()
    thread.join()
    assert spark.conf.get(SETTING) == own
