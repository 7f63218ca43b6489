"""Runs and their accounts: stages with errors set aside, budgets, batches, histories, comparisons, stored state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last(rows: DataFrame, most: int, *order: str) -> DataFrame:
    """The last rows in an order (each task keeps its own last ones)."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(most)


def page(rows: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    """A page of an ordered frame with its number; beyond the last page it is the last one.

    The number of rows is one number, read before the page is planned.
    """
    at = min(number, max(1, -(-rows.count() // size)))
    return rows.orderBy(*order).offset((at - 1) * size).limit(size).withColumn("page", F.lit(at).cast("long"))


def fold_history(queries: DataFrame) -> DataFrame:
    """Per strategy: how many queries, what they found, how many found nothing, and the source of the first (by ``at``)."""
    return queries.groupBy("strategy").agg(F.count("*").alias("queries"), F.round(F.sum("found"), 2).alias("found"), F.count_if("zero").alias("zero"), F.min_by("source", "at").alias("first_source"))


def paid_budget(direct: Column, least: float, changed: Column, budget: int) -> Column:
    """Paid queries that a run may send: none if the direct sources gave enough, or if none of them changed."""
    return F.when((direct >= least) | ~changed, 0).otherwise(budget)


def batches(rows: DataFrame, per: list[str], order: str, value: str, size: int) -> DataFrame:
    """``per``, ``batch``, ``asked``: values in order, ``size`` to a batch."""
    place = F.row_number().over(Window.partitionBy(*per).orderBy(order)) - 1
    put = rows.select(*per, order, value, F.floor(place / size).alias("batch")).groupBy(*per, "batch").agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("v"))
    return put.select(*per, "batch", F.transform("v", lambda x: x[value]).alias("asked"))


def due(checked: Column, days: Column, as_of: Column) -> Column:
    """Whether a check lies back further than its interval; what was never checked is due."""
    return F.coalesce(F.datediff(as_of, checked) > days, F.lit(True))


def seed(stored: DataFrame, fresh: DataFrame, key: str, switch: str) -> DataFrame:
    """Reference rows renewed: all of ``fresh``, with the stored switch where there is one, else on."""
    return fresh.join(stored.select(key, switch), key, "left").withColumn(switch, F.coalesce(switch, F.lit(True)))


def scoped_delete(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> DataFrame:
    """Counts of each table before and after the rows of the keys ``gone`` are left out (a dry run)."""

    def counts(name: str, rows: DataFrame) -> DataFrame:
        marked = rows.select(key).join(gone.select(key).distinct().withColumn("_gone", F.lit(1)), key, "left")
        return marked.agg(F.lit(name).alias("name"), F.count("*").alias("before"), F.count_if(F.col("_gone").isNull()).alias("after"))

    return reduce(DataFrame.unionByName, [counts(n, df) for n, df in tables.items()])


def kept_after_delete(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows that a scoped deletion leaves."""
    return rows.join(gone.select(key), key, "left_anti")


def shadow(old: DataFrame, new: DataFrame, tolerated: float) -> DataFrame:
    """Two ways by their keys: common, lost, gained, and a verdict (A nothing lost, B little, C too much, E nothing to compare)."""
    both = old.distinct().withColumn("o", F.lit(1)).join(new.distinct().withColumn("n", F.lit(1)), "key", "full")
    c = both.agg(F.count_if(F.expr("o = 1 AND n = 1")).alias("common"), F.count_if(F.expr("n IS NULL")).alias("lost"), F.count_if(F.expr("o IS NULL")).alias("gained"))
    verdict = F.when(F.col("common") + F.col("lost") + F.col("gained") == 0, "E").when(F.col("lost") == 0, "A").when(F.col("lost") <= tolerated * (F.col("common") + F.col("lost")), "B").otherwise("C")
    return c.withColumn("verdict", verdict)


def dataflow(collected: DataFrame, judged: DataFrame, most: int) -> DataFrame:
    """``doc_id``, ``stage`` for every collected row: failed (with ``error``), duplicate, rejected, review or saved.

    A bad row never stops the run.  The first row of each text stays; the gate reads what people said of it.
    """
    error = F.when(F.col("text").isNull() | (F.col("text") == ""), "empty").when(F.col("n_chars") > most, "too_long")
    checked = collected.select("doc_id", F.unhex(F.md5("text")).alias("key"), error.alias("error"))
    first = checked.filter("error IS NULL").groupBy("key").agg(F.min("doc_id").alias("first"))
    met = checked.join(first, "key", "left").join(judged, "doc_id", "left")
    stage = F.when(F.col("error").isNotNull(), "failed").when(F.col("doc_id") != F.col("first"), "duplicate").when(F.col("quality") == 0, "rejected").when(F.col("quality").isNull(), "review").otherwise("saved")
    return met.select("doc_id", "error", stage.alias("stage"))


def run_counts(staged: DataFrame) -> DataFrame:
    """Rows of each stage of a run, and of all as ``collected``; a stage without rows counts none."""
    names = ["failed", "duplicate", "rejected", "review", "saved"]
    one = staged.agg(F.count("*").alias("collected"), *[F.count_if(F.col("stage") == n).alias(n) for n in names])
    pairs = F.array(*[F.struct(F.lit(n).alias("stage"), F.col(n).alias("n")) for n in ["collected", *names]])
    return one.select(F.explode(pairs).alias("p")).select("p.*")


def fill_from_official(own: DataFrame, official: DataFrame, key: str, name: str, facts: list[str]) -> DataFrame:
    """Rows with the official record of their key (``name``) and its facts where their own are null; a key of several official records matches none."""
    one = official.groupBy(key).agg(F.count("*").alias("_n"), F.first(name).alias(name), *[F.first(f).alias(f"_{f}") for f in facts]).filter("_n = 1")
    met = own.join(one, key, "left")
    return met.withColumns({f: F.coalesce(f, f"_{f}") for f in facts}).drop("_n", *[f"_{f}" for f in facts])
