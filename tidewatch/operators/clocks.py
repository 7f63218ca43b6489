"""When a source is due again, what a run may still ask, and what makes rows of two collections the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reconciliation_due(runs: DataFrame, now: Column, hours: int) -> DataFrame:
    """``scope``, ``last``, ``due``: whether a whole comparison is due, ``hours`` after the latest completed run that did one.

    ``runs``: scope, status, started, finished, metadata (JSON text).  A scope without one is due; scopes with runs of
    any kind are listed.  One aggregation with partial sums.
    """
    whole = (F.get_json_object("metadata", "$.collector_metrics.pmmp_sync_mode") == "reconciliation") & (F.get_json_object("metadata", "$.collector_metrics.pmmp_sync_complete") == "true")
    did = F.when((F.col("status") == "completed") & F.coalesce(whole, F.lit(False)), F.struct("started", F.coalesce("finished", "started").alias("at")))
    last = runs.groupBy("scope").agg(F.max(did).alias("d")).select("scope", F.col("d.at").alias("last"))
    age = F.unix_seconds(now) - F.unix_seconds(F.col("last").cast("timestamp"))
    return last.withColumn("due", F.coalesce(age >= hours * 3600, F.lit(True)))


def allowed_calls(runs: DataFrame, planned: DataFrame, cap: int) -> DataFrame:
    """``planned`` (run, day, wanted, paid) with ``remaining`` and ``allowed``: what the day's cap leaves of a run's searches.

    ``runs``: run, day, search_calls.  Other runs of the day count, the run itself does not; one that uses no paid
    service, or any where ``cap`` is 0, is not bounded; nothing left is ``error``.
    """
    spent = runs.groupBy("day").agg(F.sum(F.coalesce("search_calls", F.lit(0))).alias("_all"))
    own = runs.groupBy("run", "day").agg(F.sum(F.coalesce("search_calls", F.lit(0))).alias("_own"))
    met = planned.join(spent, "day", "left").join(own, ["run", "day"], "left")
    left = F.greatest(F.lit(0), F.lit(cap) - (F.coalesce("_all", F.lit(0)) - F.coalesce("_own", F.lit(0))))
    bound = F.lit(cap > 0) & F.coalesce("paid", F.lit(False))
    out = met.withColumn("remaining", F.when(bound, left))
    return out.withColumn("allowed", F.coalesce(F.least("wanted", "remaining"), "wanted")).withColumn("error", F.when(F.col("remaining") == 0, "daily_search_limit_reached")).select(*planned.columns, "remaining", "allowed", "error")


def comparison_key(r: dict[str, Column]) -> Column:
    """What a row is compared by: its consultation, else its address, else reference and buyer, else its title.  ``r``: consultation, url, reference, buyer, title."""
    there = lambda c: F.nullif(c, F.lit(""))
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.coalesce(
        F.concat(F.lit("cid:"), there(r["consultation"])), F.when(there(r["url"]).isNotNull(), F.concat(F.lit("url:"), low(r["url"]))),
        F.when(there(r["reference"]).isNotNull(), F.concat(F.lit("ref:"), low(r["reference"]), F.lit("|"), low(r["buyer"]))), F.concat(F.lit("title:"), low(r["title"])),
    )
