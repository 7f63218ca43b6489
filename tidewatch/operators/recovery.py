"""Work that was interrupted or comes from before the ledger: what is proven done, what is released, what need not be read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from .ledger import PENDING, REJECTED

SNAPSHOT = ["title", "reference", "institution", "deadline", "publication_date", "source_status", "url"]
COMPLETE = ["title", "reference", "institution", "deadline", "url"]


def snapshot_digest(r: Column | None = None) -> Column:
    """Digest of what a notice says commercially; spelling of case and spaces does not count."""
    at = (lambda f: r[f]) if r is not None else F.col
    return F.sha2(F.to_json(F.struct(*[normalize_text(at(f).cast("string")).alias(f) for f in SNAPSHOT])), 256)


def complete(r: Column | None = None) -> Column:
    at = (lambda f: r[f]) if r is not None else F.col
    return F.forall(F.array(*[F.coalesce(normalize_text(at(f).cast("string")) != "", F.lit(False)) for f in COMPLETE]), lambda x: x)


def recover(rows: DataFrame, proofs: DataFrame, rejected: Column) -> DataFrame:
    """``key``, ``state``, ``reason``, ``evaluated_at`` of listings that the ledger has no state for.

    ``rows``: key, last_changed and the fields of a snapshot; ``proofs``: digest of the snapshot that a successful run
    judged, stamp, state.  Only a complete snapshot judged after the listing last changed proves anything; the latest
    such judgement counts.  ``rejected`` (a reason or null) tells what the gate turns away; all else is queued.  Proofs
    are one row per snapshot before the join.
    """
    last = proofs.groupBy("digest").agg(F.max_by(F.struct("stamp", "state"), F.struct("stamp", "state")).alias("p"))
    met = rows.withColumn("digest", F.when(complete(), snapshot_digest())).join(last, "digest", "left")
    proven = F.coalesce(F.col("p.stamp") >= F.col("last_changed"), F.lit(False))
    return met.select(
        "key", F.when(proven, F.col("p.state")).when(rejected.isNotNull(), REJECTED).otherwise(PENDING).alias("state"),
        F.when(proven, "recovered_exact_business_snapshot").when(rejected.isNotNull(), F.concat(F.lit("recovery_prefilter:"), rejected)).otherwise("legacy_without_successful_processing_evidence").alias("reason"),
        F.when(proven, F.col("p.stamp")).alias("evaluated_at"),
    )


def stale_minutes(limit: int, budget_seconds: int) -> int:
    """How long a run with a time budget may be silent: its budget and five minutes, ten at least, the limit at most."""
    return max(10, min(limit, budget_seconds // 60 + 5))


def end_stale(runs: DataFrame, now: Column, minutes: int) -> DataFrame:
    """Runs (id, status, started_at, ...) in which those still active after too long have failed; ``recovered`` tells which.

    The ledger's ``release`` frees their claims.
    """
    old = F.coalesce(F.col("status").isin("initialized", "running") & (F.col("started_at") < now - F.make_dt_interval(mins=F.lit(minutes))), F.lit(False))
    return runs.withColumns({"recovered": old, "status": F.when(old, "failed").otherwise(F.col("status")), "error": F.when(old, "stale_run_recovered")})


def lease_expired(status: Column, until: Column, heartbeat: Column, now: Column, ttl_seconds: int) -> Column:
    """Whether another worker may take a crawl over: nobody runs it, or its time is over and its heartbeat too."""
    over = until.isNull() | (until <= now)
    silent = heartbeat.isNull() | (heartbeat <= now - F.make_dt_interval(secs=F.lit(ttl_seconds)))
    return (status != "running") | (over & silent)


def known_early(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """``row``, ``known``: whether a candidate's page need not be read, as the matched record has the same complete snapshot.

    ``candidates``: row, match (id of the existing record or null) and the fields of a snapshot; ``existing``: id,
    digest, waiting (a fallback that may still find its official page, and is read again).
    """
    e = existing.select(F.col("id").alias("match"), F.col("digest").alias("_digest"), "waiting")
    met = candidates.join(e, "match", "left")
    needed = F.forall(F.array(*[F.coalesce(F.col(f).cast("string") != "", F.lit(False)) for f in ("reference", "institution", "deadline")]), lambda x: x)
    same = (F.col("_digest") == snapshot_digest()) & ~F.coalesce("waiting", F.lit(False)) & needed
    return met.select("row", F.coalesce(same, F.lit(False)).alias("known"))
