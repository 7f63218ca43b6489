"""Records matched by any of several keys: first wins, existing records, mirrors in other collections."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .written import Written, components


def long_keys(df: DataFrame, row: str, keys: list[str]) -> DataFrame:
    """(row, kind, key) for every key that is not null."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in keys])
    return df.select(F.col(row), F.explode(pairs).alias("p")).select(row, "p.kind", "p.key").filter("key IS NOT NULL")


def match_existing(candidates: DataFrame, existing: DataFrame, row: str, keys: list[str]) -> DataFrame:
    """``row``, ``match`` (id of the one existing record that shares a key of the same kind), ``conflict`` (more than one does).

    One equality join per kind at once, by (kind, key); never an OR join.  Existing keys are aggregated first, so a key
    that many records share is one row.  ``existing`` has a column ``id``.
    """
    held = long_keys(existing, "id", keys).groupBy("kind", "key").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    met = long_keys(candidates, row, keys).join(held, ["kind", "key"]).groupBy(row).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    found = candidates.select(row).join(met, row, "left")
    return found.select(row, F.when(F.col("low") == F.col("high"), F.col("low")).alias("match"), F.coalesce(F.col("low") != F.col("high"), F.lit(False)).alias("conflict"))


ROUNDS = 3


def first_wins_any(df: DataFrame, row: str, keys: list[str], rounds: int = ROUNDS) -> DataFrame:
    """``row`` and ``kept``: walking rows in order, one stays if no row that stayed before it shares a key.

    A row's fate hangs on the earlier rows of its keys only.  Some rounds settle, for all keys at once, the rows that no
    open earlier one stands before, and those that share a key with them: that ends keys that many rows share.  What
    is left hangs on chains; its connected rows are walked in order, one task a component, holding the taken keys.
    """
    work = Written(df.sparkSession)
    open_ = work.keep(long_keys(df, row, keys).withColumn("key", F.concat_ws(":", "kind", "key")).select(row, "key").distinct())
    parts = [work.keep(df.select(row).join(open_.select(row).distinct(), row, "left_anti").withColumn("kept", F.lit(True)))]
    for _ in range(rounds):
        if open_.isEmpty():
            break
        least = open_.groupBy("key").agg(F.min(row).alias("least"))
        first = work.keep(open_.join(least, "key").groupBy(row).agg(F.bool_and(F.col("least") == F.col(row)).alias("stays")).filter("stays").select(row))
        taken = open_.join(first, row, "left_semi").select("key").distinct()
        gone = open_.join(taken, "key", "left_semi").select(row).distinct().join(first, row, "left_anti")
        now = work.keep(first.withColumn("kept", F.lit(True)).unionByName(gone.withColumn("kept", F.lit(False))))
        parts.append(now)
        left = work.keep(open_.join(now.select(row), row, "left_anti"))
        work.drop(open_, first)
        open_ = left
    if not open_.isEmpty():
        parts.append(work.keep(_walked(open_, row, work)))
    return reduce(DataFrame.unionByName, parts)


def _walked(open_: DataFrame, row: str, work: Written) -> DataFrame:
    """The rest (row, key) in order within each component of rows that share keys."""
    least = open_.groupBy("key").agg(F.min(row).alias("least"))
    roots = components(open_.join(least, "key").select(F.col(row).alias("a"), F.col("least").alias("b")), work)
    each = open_.groupBy(row).agg(F.collect_list("key").alias("keys"))  # a row's own keys: as many as there are kinds
    rooted = each.join(roots.select(F.col("node").alias(row), "root"), row, "left").withColumn("root", F.coalesce("root", row))
    schema = StructType([open_.schema[row], StructField("kept", BooleanType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, taken = None, set()
        for b in batches:
            stays = []
            for root, own in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if root != at:
                    at, taken = root, set()
                stays.append(taken.isdisjoint(own))
                if stays[-1]:
                    taken.update(own)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(stays, pa.bool_())], names=[row, "kept"])

    return rooted.select("root", row, "keys").repartition("root").sortWithinPartitions("root", row).mapInArrow(walk, schema)


def mirrors(records: DataFrame, least_title: int = 25) -> DataFrame:
    """``id``, ``mirror`` (smallest id of another collection with the same item), ``material`` (same address, other content).

    ``records``: id, collection, url_key, title_key, content_key, has_body.  The address decides if it matches; else a long
    title with equal content does.  Keys are aggregated to at most two collections before the join, so a key of any size
    is one row, and the smallest id outside the own collection is in it.
    """

    def best(key: Column, where: Column, name: str) -> DataFrame:
        each = records.filter(where).groupBy(key.alias("k"), "collection").agg(F.min_by(F.struct("id", "content_key"), "id").alias("one"))
        two = each.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("one", "collection"))).alias("every"))  # one entry per collection
        return two.select("k", F.slice("every", 1, 2).alias(name))

    by_url = best(F.col("url_key"), F.col("url_key").isNotNull(), "u")
    whole = F.sha2(F.concat_ws("\x00", "title_key", "content_key"), 256)
    titled = (F.length("title_key") >= least_title) & F.col("has_body")
    by_title = best(whole, titled, "t")
    keyed = records.withColumn("tk", F.when(titled, whole))
    met = keyed.join(by_url.withColumnRenamed("k", "url_key"), "url_key", "left").join(by_title.withColumnRenamed("k", "tk"), "tk", "left")
    other = lambda c: F.get(F.filter(F.col(c), lambda x: x["collection"] != F.col("collection")), F.lit(0))["one"]
    u, t = other("u"), other("t")
    material = u["content_key"].isNotNull() & (u["content_key"] != F.col("content_key")) & F.col("has_body")
    return met.select("id", F.coalesce(u["id"], t["id"]).alias("mirror"), F.coalesce(material, F.lit(False)).alias("material"))
