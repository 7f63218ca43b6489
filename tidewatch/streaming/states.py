"""Change classes against keyed state that a stream keeps for itself: one row a key is read and written, nothing else.

The state of a key is its newest digest with its time.  A row that is older than it (it came late, or again) is LATE:
it is told apart and changes nothing, so replays and disorder do not undo newer rows.  State lives in RocksDB under the
stream's checkpoint, a batch touches the keys it has rows of, and old versions are dropped by the store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

_NEWEST = StructType([StructField("digest", StringType()), StructField("us", LongType()), StructField("id", LongType())])


def classed(newest: tuple | None, rows: list[tuple]) -> tuple[tuple | None, list[str]]:
    """Newest (digest, time, id) and the class of each row (digest, time, id) of one key, in order of time and id."""
    said = []
    for digest, us, number in rows:
        if newest and (us, number) <= (newest[1], newest[2]):
            said.append("LATE")
            continue
        said.append("NEW" if newest is None else "UNCHANGED" if newest[0] == digest else "UPDATED")
        newest = (digest, us, number)
    return newest, said


class NewestOfEach(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", _NEWEST)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["us", "id"], kind="stable")  # a key's rows of one batch
        before = tuple(self.newest.get()) if self.newest.exists() else None
        given = list(zip(batch["digest"].tolist(), batch["us"].tolist(), batch["id"].tolist(), strict=True))
        after, said = classed(before, given)
        if after != before:
            self.newest.update(after)
        yield pd.DataFrame({"key": [key[0]] * len(said), "id": batch["id"].to_numpy(), "us": batch["us"].to_numpy(), "digest": batch["digest"].to_numpy(), "state": said})


def changes(stream: DataFrame) -> DataFrame:
    """``stream`` (key, id, at, digest) with the ``state`` of each row; rows without a key or a time are none."""
    schema = StructType([stream.schema["key"], StructField("id", LongType()), StructField("us", LongType()), StructField("digest", StringType()), StructField("state", StringType())])
    timed = stream.where("key IS NOT NULL AND at IS NOT NULL").select("key", F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("id"), F.unix_micros("at").alias("us"), F.coalesce("digest", F.lit("")).alias("digest"))
    said = timed.groupBy("key").transformWithStateInPandas(statefulProcessor=NewestOfEach(), outputStructType=schema, outputMode="append", timeMode="none")
    return said.select("key", "id", F.timestamp_micros("us").alias("at"), "digest", "state")
