"""Life of runs as a stream: reserved, claimed, staged, completed or failed, and failed by a timer when they go stale.

A scope (a radar, a source) has one active run at a time.  Events may come late and in any order: they wait in the
state until the watermark has passed them and are then taken in order of time, so the outcome is that of the whole log
read in order, whatever the batches were.  State holds the active run of a scope and what waits; both go when spent.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: An event asks for a step of a run; ``detail`` names a stage or the kind of a failure.  Times in the state are microseconds of UTC.
EVENT = StructType([StructField("id", LongType()), StructField("at", LongType()), StructField("step", StringType()), StructField("detail", StringType())])
_ACTIVE = StructType([StructField("run", LongType()), StructField("status", StringType()), StructField("started", LongType())])
STEPS = ("reserve", "claim", "stage", "complete", "fail")
STALE = "stale_run_recovered"


def taken(active: tuple | None, event: tuple, stale) -> Iterator[tuple[tuple | None, tuple]]:
    """Active run (run, status, started) and log row (run, at, status, detail) after each thing that an event brings about."""
    number, at, step, detail = event
    if active and at >= active[2] + stale:
        row = (active[0], active[2] + stale, "FAILED", STALE)
        active = None
        yield active, row
    if step == "reserve":
        if active:
            yield active, (number, at, "REJECTED", "already_running")
        else:
            active = (number, "INITIALIZED", at)
            yield active, (number, at, "INITIALIZED", detail)
    elif active is None or (step == "claim" and active[1] != "INITIALIZED"):
        yield active, (active[0] if active else None, at, "REJECTED", "not_active" if active is None else "already_claimed")
    elif step == "claim":
        active = (active[0], "RUNNING", active[2])
        yield active, (active[0], at, "RUNNING", detail)
    elif step == "stage":
        yield active, (active[0], at, active[1], detail)
    else:
        yield None, (active[0], at, "COMPLETED" if step == "complete" else "FAILED", detail)


class RunClock(StatefulProcessor):
    """Keeps a scope's active run and its waiting events; a timer stands at the next of them or at the run's end."""

    def __init__(self, stale: timedelta) -> None:
        self.stale = stale // timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.active = handle.getValueState("active", _ACTIVE)
        self.waiting = handle.getListState("waiting", EVENT)

    def _stand(self, at: int | None) -> None:
        if at is not None:
            self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            if len(batch):
                self.waiting.appendList(list(zip(batch["id"].tolist(), batch["us"].tolist(), batch["step"].tolist(), batch["detail"].tolist(), strict=True)))
                self._stand(int(batch["us"].min()))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted((tuple(r) for r in self.waiting.get()), key=lambda e: (e[1], e[0])) if self.waiting.exists() else []
        due, later = [e for e in events if e[1] <= passed], [e for e in events if e[1] > passed]
        active = tuple(self.active.get()) if self.active.exists() else None
        log = []
        for event in due:
            for active, row in taken(active, event, self.stale):
                log.append(row)
        if active and active[2] + self.stale <= passed:
            log.append((active[0], active[2] + self.stale, "FAILED", STALE))
            active = None
        if due:
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        if active:
            self.active.update(active)
        elif self.active.exists():
            self.active.clear()
        ends = [e[1] for e in later[:1]] + ([active[2] + self.stale] if active else [])
        self._stand(min(ends) if ends else None)
        if log:
            yield pd.DataFrame({"scope": [key[0]] * len(log), **{n: pd.Series([r[i] for r in log], dtype=t) for i, (n, t) in enumerate((("run", "Int64"), ("us", "int64"), ("status", "object"), ("detail", "object")))}})


def log(events: DataFrame, stale: timedelta, late: str = "1 hour") -> DataFrame:
    """The stream of what happens to runs: scope, run, at, status, detail.

    ``events``: scope, id, at, step, detail; without a scope or a time an event is none.  An event later than ``late``
    is dropped, as the watermark has it; one of an unknown step counts as a failure of the active run.
    """
    schema = StructType([events.schema["scope"], StructField("run", LongType()), StructField("us", LongType()), StructField("status", StringType()), StructField("detail", StringType())])
    timed = events.where("scope is not null and at is not null").select("scope", "id", "at", F.unix_micros("at").alias("us"), "step", "detail").withWatermark("at", late)
    said = timed.groupBy("scope").transformWithStateInPandas(statefulProcessor=RunClock(stale), outputStructType=schema, outputMode="append", timeMode="eventTime")
    return said.select("scope", "run", F.timestamp_micros("us").alias("at"), "status", "detail")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def followed(stream: DataFrame, place: str) -> DataFrame:
    """Run a log through to its present end into a folder that all executors share, and return all of it."""
    spark = stream.sparkSession
    with keyed_state(spark):
        run = stream.writeStream.format("parquet").option("path", f"{place}/log").option("checkpointLocation", f"{place}/checkpoint")
        run.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/log")
