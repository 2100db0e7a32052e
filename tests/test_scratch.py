import time
from pathlib import Path

from pyspark.sql import functions as F

from quernlake.sources import scratch


def test_a_written_table_leaves_no_shuffle_files(spark):
    folders = [Path(str(d)) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {p for d in folders for p in d.rglob("shuffle_*.data")}
    there, setting = files(), spark.conf.get(scratch.CLEANUP)
    table = scratch.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("n")), "test")
    ends = time.time() + 20
    while files() - there and time.time() < ends:  # Spark removes them beside other work
        time.sleep(0.2)
    assert not files() - there
    assert spark.conf.get(scratch.CLEANUP) == setting
    assert table.agg(F.sum("n")).first()[0] == 499500
