"""What becomes of candidates in the table of results: new, updated, unchanged, rejected, for a person to look at; and the yield of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import first

STICKY = ["ARCHIVED", "REJECTED", "MANUAL_REVIEW"]  # fixed values: states that a rediscovery does not change
ENRICHES = ["official_url", "official_confirmation"]  # fixed values: fields that evidence alone changes
PLANNED = ["RESOLUTION", "CONTROL"]  # fixed values: strategies that are no discovery


def saved(existing: DataFrame, incoming: DataFrame, content: list[str], now: Column) -> DataFrame:
    """The table after a run: key, ``content``, status, first_seen, last_seen, last_changed, state (of this run; null for rows it did not see), event.

    ``existing``: key, content, status, first_seen, last_seen, last_changed, resolution; ``incoming``: key, content,
    relevant, manual, analysed, resolution, one row a key.  A candidate without an analysis was unchanged: it is seen
    again, and a state that a person or a rule gave stays.  An archived row stays archived, whatever it becomes.  Where a
    credible row is confirmed and nothing else changes, evidence is added (``OFFICIAL_ENRICHED``) and the row is
    otherwise unchanged.  One full join by key; neither side is broadcast unless Spark's own size check says so.
    """
    e = existing.select("key", F.struct(*content, "status", "first_seen", "last_seen", "last_changed", "resolution").alias("e"))
    n = incoming.select("key", F.struct(*content, "relevant", "manual", "analysed", "resolution").alias("n"))
    both = e.join(n, "key", "full")
    has, came = F.col("e").isNotNull(), F.col("n").isNotNull()
    other = [c for c in content if c not in ENRICHES]
    same = F.lit(True)
    for c in other:
        same = same & F.col(f"e.{c}").eqNullSafe(F.col(f"n.{c}"))
    enriched = has & came & (F.col("e.resolution") == "UNVERIFIED_BUT_CREDIBLE") & (F.col("n.resolution") == "VERIFIED_OFFICIAL") & same
    quiet = has & came & (F.coalesce(enriched, F.lit(False)) | ~F.col("n.analysed"))
    state = F.when(came, first([("UNCHANGED", quiet), ("REJECTED", ~F.col("n.relevant")), ("MANUAL_REVIEW", F.col("n.manual")), ("UPDATED", has)], "NEW"))
    status = first([(F.col("e.status"), ~came | (quiet & F.col("e.status").isin(STICKY)) | (F.col("e.status") == "ARCHIVED")), (F.lit("UNCHANGED"), quiet)], F.col("state"))
    written = came & ~quiet
    out = both.withColumn("state", state)
    fields = [F.when(written | (F.coalesce(enriched, F.lit(False)) & F.lit(c in ENRICHES)), F.col(f"n.{c}")).otherwise(F.col(f"e.{c}")).alias(c) for c in content]
    return out.select(
        "key", *fields, status.alias("status"), F.coalesce("e.first_seen", now).alias("first_seen"), F.when(came, now).otherwise(F.col("e.last_seen")).alias("last_seen"),
        F.when(written, now).otherwise(F.col("e.last_changed")).alias("last_changed"), F.when(written | F.coalesce(enriched, F.lit(False)), F.col("n.resolution")).otherwise(F.col("e.resolution")).alias("resolution"),
        "state", F.when(F.coalesce(enriched, F.lit(False)), "OFFICIAL_ENRICHED").alias("event"),
    )


def query_yield(runs: DataFrame, latest: int = 10) -> DataFrame:
    """Per scope and ``strategy:family``: what the queries of the last completed runs gave.

    ``runs``: scope, run, status, started, metadata (JSON text).  Runs recorded other fields at other times, so their
    metadata is read as VARIANT: each query of ``collection_queries`` gives what it has, missing counts are 0, and
    metadata that is no JSON gives none.  Runs are ranked before anything is read of them.
    """
    w = Window.partitionBy("scope").orderBy(F.desc("started"), F.desc("run"))
    last = runs.filter("status = 'completed'").select("scope", "run", "started", "metadata", F.row_number().over(w).alias("n")).filter(F.col("n") <= latest)
    asked = last.select("scope", "run", "started", F.explode(F.try_variant_get(F.try_parse_json("metadata"), "$.collection_queries", "array<variant>")).alias("q"))
    text = lambda k: F.nullif(F.try_variant_get("q", f"$.{k}", "string"), F.lit(""))
    number = lambda k: F.coalesce(F.try_variant_get("q", f"$.{k}", "bigint"), F.lit(0))
    named = asked.select(
        "scope", "started", text("source_strategy").alias("strategy"), text("query_family").alias("family"), number("raw_results_count").alias("raw"), number("candidates_created").alias("usable"),
        *[number(k).alias(k) for k in ("relevant_candidates", "official_resolution_success", "duplicates_skipped", "generic_pages", "parser_failures")],
    )
    good = named.filter(F.col("strategy").isNotNull() & F.col("family").isNotNull() & ~F.col("strategy").isin(PLANNED))
    return good.groupBy("scope", F.concat("strategy", F.lit(":"), "family").alias("query")).agg(
        F.count("*").alias("executions"), F.sum("raw").alias("raw_results"), F.sum("usable").alias("usable_observations"),
        *[F.sum(k).alias(k) for k in ("relevant_candidates", "official_resolution_success", "duplicates_skipped", "generic_pages", "parser_failures")],
        F.count_if(F.col("raw") == 0).alias("zero_results"), F.max(F.when(F.col("raw") > 0, F.col("started"))).alias("last_successful_at"),
    )


def reopened(events: DataFrame, observations: DataFrame, fields: list[str]) -> DataFrame:
    """Per reopening (id, at): ``changed`` fields between the last observation before it and the first at or after it, ``justified``.

    ``events``: id, at, event; ``observations``: id, seen_at, fields.  Without an observation on both sides both are
    null.  Reopenings and observations are sorted together once (a window by record): no observation meets every event.
    """
    snap = F.struct(*fields)
    kinds = {c: observations.schema[c].dataType for c in fields}
    both = observations.select("id", F.col("seen_at").alias("at"), F.lit(1).alias("kind"), snap.alias("s")).unionByName(events.filter("event = 'REOPENED'").select("id", "at", F.lit(0).alias("kind"), F.lit(None).cast("struct<" + ",".join(f"`{c}`:{t.simpleString()}" for c, t in kinds.items()) + ">").alias("s")))
    w = Window.partitionBy("id").orderBy("at", "kind")
    around = both.select("id", "at", "kind", F.last("s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("s", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    changed = F.filter(F.array(*[F.when(~F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}")), c) for c in fields]), lambda c: c.isNotNull())
    known = F.col("before").isNotNull() & F.col("after").isNotNull()
    return around.filter("kind = 0").select("id", "at", F.when(known, changed).alias("changed"), F.when(known, F.size(changed) > 0).alias("justified"))
