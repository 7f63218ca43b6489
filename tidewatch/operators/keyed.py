"""Keyed state: latest row, first wins, change classes, merges, field differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key (planned as a group limit before and after the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def first_wins(df: DataFrame, key: Column, seq: str) -> DataFrame:
    """One row per key: smallest ``seq`` and how many rows had the key.  Aggregates before the shuffle."""
    return df.select(key.alias("key"), seq).groupBy("key").agg(F.min(seq).alias("first_seq"), F.count("*").alias("n"))


def classify(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """NEW, UPDATED, UNCHANGED for rows of ``new``, MISSING for keys of ``old`` only."""
    o = old.select(F.col(key), F.col(digest).alias("_old"))
    n = new.select(F.col(key), F.col(digest).alias("_new"))
    state = F.when(F.col("_old").isNull(), "NEW").when(F.col("_new").isNull(), "MISSING").when(F.col("_old") == F.col("_new"), "UNCHANGED").otherwise("UPDATED")
    return o.join(n, key, "full").select(key, state.alias("state"))


def merge(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Upsert in which a null of ``new`` keeps the value of ``old``."""
    o = old.select(key, *[F.col(f).alias(f"_o_{f}") for f in fields])
    return o.join(new.select(key, *fields), key, "full").select(key, *[F.coalesce(f, f"_o_{f}").alias(f) for f in fields])


def changed_fields(fields: list[str], before: str, after: str) -> Column:
    """Names of fields of struct ``after`` that differ from ``before`` (nulls compare equal)."""
    return F.array_compact(F.array(*[F.when(~F.col(f"{before}.{f}").eqNullSafe(F.col(f"{after}.{f}")), F.lit(f)) for f in fields]))
