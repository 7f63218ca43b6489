"""What is shown of runs and results: fixed fields of a run as JSON, and results that a run or a collection may show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fields of a run that are shown, in their order; states that a run's own list shows.
RUN_FIELDS = [
    "id", "radar_id", "agent_name", "status", "current_stage", "trigger_type", "triggered_by", "candidates_count", "duplicate_count", "analyzed_count", "new_results_count", "updated_results_count", "rejected_count",
    "candidate_errors_count", "input_tokens", "output_tokens", "cached_tokens", "ai_calls", "error_kind", "error_message", "direct_fetches", "search_calls", "resolution_search_calls", "queries_executed", "candidates_after_rules",
    "manual_review_count", "accepted_count", "run_metadata",
]
ACTIONABLE = ["NEW", "UPDATED", "MANUAL_REVIEW"]


def public_runs(runs: DataFrame, launchers: DataFrame) -> DataFrame:
    """``id``, ``shown``: a run as JSON, nulls too; times in ISO form, its cost as text, who launched it (id, name) or null.

    ``runs`` may lack some of ``RUN_FIELDS`` (shown as null); it has launcher_id, started_at, finished_at and
    estimated_ai_cost.  ``launchers``: id, name.
    """
    field = lambda c: F.col(c) if c in runs.columns else F.lit(None).cast("string").alias(c)
    iso = lambda c: F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias(c)
    who = launchers.select(F.col("id").alias("launcher_id"), F.struct("id", "name").alias("launched_by"))
    shown = F.struct(*[field(c) for c in RUN_FIELDS], iso("started_at"), iso("finished_at"), F.col("estimated_ai_cost").cast("string").alias("estimated_ai_cost"), "launched_by")
    return runs.join(who, "launcher_id", "left").select("id", F.to_json(shown, {"ignoreNullFields": "false"}).alias("shown"))


def visible_in(results: DataFrame, observations: DataFrame, runs: DataFrame, scope: str, run: int | None = None) -> DataFrame:
    """The results of a collection, or those that one completed run of it brought up in a state to act on.

    ``results``: id, scope; ``observations``: result_id, run_id, state; ``runs``: id, scope, status.  Semi-joins: a
    result that a run saw often is one row.
    """
    own = results.filter(F.col("scope") == scope)
    if run is None:
        return own
    good = runs.filter((F.col("id") == run) & (F.col("scope") == scope) & (F.col("status") == "completed")).select(F.col("id").alias("run_id"))
    seen = observations.filter((F.col("run_id") == run) & F.col("state").isin(ACTIONABLE)).join(good, "run_id", "left_semi").select(F.col("result_id").alias("id")).distinct()
    return own.join(seen, "id", "left_semi")
