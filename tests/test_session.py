import time

from pyspark.sql import functions as F

from corpusloom.session import written


def _shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in files.mkString("\n").split("\n") if "shuffle_" in f}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    df = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.count("*").alias("n"))
    table = written(df, "counts")
    end = time.time() + 20
    while _shuffle_files(spark) - before and time.time() < end:
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert table.count() == 10 and written(df, "counts").count() == 10 and df.count() == 10
    assert sorted(table.collect()) == sorted(df.collect()) == sorted(written(df, "counts").collect())
