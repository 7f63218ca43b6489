"""Streaming twins: windowed totals and change classes over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """File stream of event tables; timestamps become instants for the watermark."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def daily_totals(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Count and sum per day and kind.

    Written in update mode, a closed day leaves the state after ``late``; a row that comes later still is dropped, as
    the watermark has it.
    """
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


class DailyTotals:
    """Daily totals kept as one Parquet folder per batch: a batch holds the days that it changed, the newest batch counts.

    Batches are written over when they run again, so a replay changes nothing.
    """

    def __init__(self, spark: SparkSession, place: str) -> None:
        self.spark, self.place = spark, place.rstrip("/")

    def follow(self, totals: DataFrame) -> DataFrame:
        """Run a stream of ``daily_totals`` through to its present end and return all days."""

        def keep(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{self.place}/totals/{number}")

        run = totals.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{self.place}/checkpoint")
        run.trigger(availableNow=True).start().awaitTermination()
        every = self.spark.read.parquet(f"{self.place}/totals/*")
        newest = every.groupBy("window", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("t"))
        return newest.select("window", "event_type", "t.*")


class StateTable:
    """Latest row per key as versioned Parquet folders; a batch that is run again writes the same version again.

    One stream writes.  ``place`` lies in storage that all executors share.
    """

    def __init__(self, spark: SparkSession, place: str, schema: str) -> None:
        self.spark, self.place, self.schema = spark, place.rstrip("/"), schema

    def version(self, batch: int) -> DataFrame:
        """State after a batch; before the first one it is empty."""
        if batch < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.place}/state/{batch}")

    def apply(self, batch: DataFrame, number: int, key: str, digest: str, order: list[str]) -> None:
        """Classify the rows of a batch against the state and within the batch, then write changes and the next state."""
        w = Window.partitionBy(key).orderBy(*order)
        rows = batch.join(self.version(number - 1).select(key, F.col(digest).alias("_old")), key, "left")
        before = F.coalesce(F.lag(digest).over(w), F.col("_old"))
        state = F.when(before.isNull(), "NEW").when(before == F.col(digest), "UNCHANGED").otherwise("UPDATED")
        rows.select(*batch.columns, state.alias("state")).write.mode("overwrite").parquet(f"{self.place}/changes/{number}")
        newest = batch.groupBy(key).agg(F.max_by(digest, F.struct(*order)).alias(digest))
        kept = self.version(number - 1).join(newest, key, "left_anti").unionByName(newest)
        kept.write.mode("overwrite").parquet(f"{self.place}/state/{number}")

    def follow(self, stream: DataFrame, key: str, digest: str, order: list[str]) -> DataFrame:
        """Run a stream through to its present end and return all changes."""
        run = stream.writeStream.foreachBatch(lambda b, n: self.apply(b, n, key, digest, order))
        run.option("checkpointLocation", f"{self.place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return self.spark.read.parquet(f"{self.place}/changes/*")
