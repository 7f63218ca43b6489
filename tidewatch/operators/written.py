"""Frames written to the folder that all executors share, to cut lineage, and deleted when nothing reads them any more."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset, a folder of this machine in local mode, else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tidewatch-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """``df`` of narrow rows dealt out to all cores, four parts each at least: a small file is one task, however much each row costs later."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


class Written:
    """Frames of one piece of work; :meth:`keep` writes one, :meth:`drop` deletes what is spent."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.place, self.paths = spark, f"{shared_folder(spark)}/work-{uuid.uuid4().hex}", {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.place}/{len(self.paths)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path, held = self.paths.get(id(df), (None, None))
            if path and held is df:
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
                self.paths[id(df)] = (None, df)


def components(edges: DataFrame, work: Written) -> DataFrame:
    """(node, root) of the connected components of (a, b): the root is the smallest node.

    Every round each node's larger neighbours, then its smaller ones, are joined to its smallest; rounds grow with the
    logarithm of the longest path.  Each is an aggregation and a join by node, written and the one before deleted.
    """
    from pyspark.sql import functions as F

    now = work.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "low"), F.struct(F.col("a").alias("b"), "low"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.low").alias("b")).filter("a <> b").distinct()
        then = work.keep(small)
        same = then.count() == now.count() and then.join(now, ["a", "b"], "left_anti").isEmpty()
        work.drop(now)
        now = then
        if same:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
