"""A durable ledger of listings: versions, who works on what, what is to be done next.

Every function is a join or a projection of the ledger's rows: Spark writes the result as the next version of the
ledger (one writer), so claims need no locks.  Ledger rows: key, digest, first_seen, last_seen, last_changed, state,
owner, since, attempts, evaluated_digest, policy, reason, seq (order of the row's last version).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PENDING, PROCESSING, PROCESSED, RETRY, REJECTED = "PENDING_PROCESSING", "PROCESSING", "PROCESSED", "FAILED_RETRYABLE", "REJECTED"
TERMINAL = [PROCESSED, REJECTED]
SCHEMA = "key string, digest string, first_seen timestamp, last_seen timestamp, last_changed timestamp, state string, owner long, since timestamp, attempts int, evaluated_digest string, policy string, reason string, seq long"


def _owned(active: DataFrame | None):
    """Adds ``_active``: whether the row's owner is a run that is still active and began before the claim."""

    def add(rows: DataFrame) -> DataFrame:
        if active is None:
            return rows.withColumn("_active", F.col("owner").isNotNull())
        runs = active.filter("status IN ('initialized', 'running')").select(F.col("id").alias("_run"), F.col("started_at").alias("_started"))
        met = rows.join(F.broadcast(runs), (F.col("owner") == F.col("_run")) & (F.col("_started") <= F.col("since")), "left")  # runs that are active at once
        return met.withColumn("_active", F.col("_run").isNotNull()).drop("_run", "_started")

    return add


def absorb(ledger: DataFrame, batch: DataFrame, now: Column, active: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(next ledger, class of each key of the batch).  ``batch``: key, digest, seq; of several rows of a key the last counts.

    An unchanged listing is only seen again.  A changed one takes the new content and is queued, unless a live run works
    on it: then the owner keeps it and the changed digest queues it later.  A row older than the ledger's version
    (late data) is seen again but changes nothing.
    """
    newest = batch.groupBy("key").agg(F.max_by("digest", "seq").alias("_digest"), F.max("seq").alias("_seq"))
    met = _owned(active)(ledger).withColumn("_known", F.lit(True)).join(newest, "key", "full")
    known, seen = F.coalesce("_known", F.lit(False)), F.col("_digest").isNotNull()
    changed = known & seen & (F.col("_seq") > F.coalesce("seq", F.lit(-1))) & ~F.col("_digest").eqNullSafe(F.col("digest"))
    fresh = seen & ~known
    busy = changed & (F.col("state") == PROCESSING) & F.coalesce("_active", F.lit(False))
    queued = fresh | (changed & ~busy)
    free = lambda c: F.when(queued, None).otherwise(F.col(c))
    out = met.select(
        "key", F.when(fresh | changed, F.col("_digest")).otherwise(F.col("digest")).alias("digest"),
        F.when(fresh, now).otherwise(F.col("first_seen")).alias("first_seen"), F.when(seen, now).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(fresh | changed, now).otherwise(F.col("last_changed")).alias("last_changed"),
        F.when(queued, PENDING).otherwise(F.col("state")).alias("state"), free("owner").alias("owner"), free("since").alias("since"),
        F.coalesce("attempts", F.lit(0)).alias("attempts"), "evaluated_digest", "policy",
        F.when(busy, "changed_while_processing").when(changed, "content_changed").otherwise(F.col("reason")).alias("reason"),
        F.greatest("seq", "_seq").alias("seq"),
    )
    kind = F.when(fresh, "NEW").when(changed, "UPDATED").otherwise("UNCHANGED")
    return out, met.filter(seen).select("key", kind.alias("class"))


def waiting(ledger: DataFrame, policy: str) -> DataFrame:
    """Rows to work on: never judged, queued, to be tried again, or judged on other content or by another policy."""
    stale = F.col("state").isin(TERMINAL) & (F.col("evaluated_digest").isNull() | F.col("policy").isNull() | (F.col("evaluated_digest") != F.col("digest")) | (F.col("policy") != policy))
    return ledger.filter(F.col("state").isNull() | F.col("state").isin(PENDING, RETRY) | stale)


def queue(ledger: DataFrame, policy: str, most: int) -> DataFrame:
    """The next rows in a fair order: fewest attempts, then first seen, then key."""
    return waiting(ledger, policy).orderBy("attempts", F.asc_nulls_last("first_seen"), "key").limit(most)


def claim(ledger: DataFrame, wanted: DataFrame, run: int, now: Column) -> DataFrame:
    """Ledger with the wanted rows (key, digest) owned by a run: only where nobody works on the row and the digest still holds."""
    w = wanted.select("key", F.col("digest").alias("_wanted"))
    met = ledger.join(w, "key", "left")
    mine = F.col("_wanted").eqNullSafe(F.col("digest")) & ~F.col("state").eqNullSafe(F.lit(PROCESSING))
    return _set(met, mine, {"state": F.lit(PROCESSING), "owner": F.lit(run).cast("long"), "since": now, "attempts": F.coalesce("attempts", F.lit(0)) + 1}).drop("_wanted")


def finish(ledger: DataFrame, verdicts: DataFrame, run: int, policy: str) -> DataFrame:
    """Ledger with a run's verdicts (key, digest, verdict, reason): terminal, or to be tried again.

    A credible case without proof and every failure of parser, resolution or source is tried again.  A verdict counts
    only for the owner; if the row changed meanwhile it is queued again.
    """
    v = verdicts.select("key", F.col("digest").alias("_judged"), F.col("verdict").alias("_verdict"), F.col("reason").alias("_reason"))
    met = ledger.join(v, "key", "left")
    mine = F.col("_verdict").isNotNull() & (F.col("owner") == run) & (F.col("state") == PROCESSING)
    same = F.col("_judged").eqNullSafe(F.col("digest"))
    again = F.col("_verdict").isin("credible", "parser_error", "resolution_error", "source_error")
    state = F.when(~same, PENDING).when(again, RETRY).when(F.col("_verdict") == "rejected", REJECTED).otherwise(PROCESSED)
    judged = lambda x, c: F.when(same & ~again, x).otherwise(F.col(c))
    return _set(met, mine, {"state": state, "owner": F.lit(None).cast("long"), "since": F.lit(None).cast("timestamp"), "evaluated_digest": judged(F.col("_judged"), "evaluated_digest"), "policy": judged(F.lit(policy), "policy"), "reason": F.col("_reason")}).drop("_judged", "_verdict", "_reason")


def release(ledger: DataFrame, active: DataFrame) -> DataFrame:
    """Ledger in which claims of runs that are no longer active may be tried again."""
    met = _owned(active)(ledger)
    lost = (F.col("state") == PROCESSING) & ~F.col("_active")
    return _set(met, lost, {"state": F.lit(RETRY), "owner": F.lit(None).cast("long"), "since": F.lit(None).cast("timestamp"), "reason": F.lit("interrupted_owner_run")}).drop("_active")


def requeue(ledger: DataFrame, scan: Column, before: Column) -> DataFrame:
    """Ledger in which processed rows last judged before a time, and seen since the scan began, are queued again."""
    old = (F.col("state") == PROCESSED) & (F.col("last_changed") < before) & (F.col("last_seen") >= scan)
    return _set(ledger, old, {"state": F.lit(PENDING), "reason": F.lit("periodic_check")})


def _set(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    where = F.coalesce(where, F.lit(False))
    return df.withColumns({c: F.when(where, v.cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})


def report(ledger: DataFrame, policy: str) -> DataFrame:
    """One row: rows by state, and how many wait."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    todo = waiting(ledger, policy).agg(F.count("*").alias("waiting"))
    states = ledger.agg(F.count("*").alias("rows"), *[n(F.col("state") == s).alias(s.lower()) for s in (PENDING, PROCESSING, PROCESSED, RETRY, REJECTED)])
    return states.join(F.broadcast(todo))


def crawl_stop(pages: DataFrame, per: str, overlap: int) -> DataFrame:
    """``per``, ``page``, ``kept``, ``stop``: a crawl's pages up to the one that ends it, and why it ends.

    ``pages``: page, signature, rows, changed.  It ends at a page without rows, at one whose signature came before, or
    with the ``overlap``-th page in a row on which nothing changed.
    """
    w = Window.partitionBy(per).orderBy("page")
    marked = pages.withColumn("_new", (F.col("changed") > 0).cast("int")).withColumn("_run", F.sum("_new").over(w))
    streak = F.sum(1 - F.col("_new")).over(Window.partitionBy(per, "_run").orderBy("page"))
    again = F.row_number().over(Window.partitionBy(per, "signature").orderBy("page")) > 1
    why = F.when(F.col("rows") == 0, "empty").when(F.col("_again"), "loop").when(F.col("_streak") >= overlap, "overlap")
    seen = marked.withColumns({"_streak": streak, "_again": again}).withColumn("stop", why)
    first = F.min(F.when(F.col("stop").isNotNull(), F.col("page"))).over(Window.partitionBy(per))
    return seen.withColumn("_first", first).select(per, "page", (F.col("_first").isNull() | (F.col("page") <= F.col("_first"))).alias("kept"), F.when(F.col("page") == F.col("_first"), F.col("stop")).alias("stop"))
