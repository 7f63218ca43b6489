"""What the corpus operators leave on disk."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from tidewatch.llm import _spark


def test_a_written_table_leaves_no_shuffle_files(spark):
    """shuffle files of written tables stayed until the driver collected garbage."""
    dirs = [Path(d.getPath()) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    files = lambda: {p for d in dirs for p in d.rglob("shuffle_*")}
    before, set_ = files(), spark.conf.get(name, None)
    kept = spark.range(100_000).groupBy(F.xxhash64("id").alias("k")).agg(F.count("*").alias("n"))
    out = _spark.table(kept)
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(name, None) == set_
    assert out.agg(F.sum("n")).first()[0] == 100_000
    _spark.drop(out)
