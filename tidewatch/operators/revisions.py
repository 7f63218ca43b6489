"""What a new version of a record changes: differences of business fields with both values, and decisions about versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from ..sources.pages import plain

# fixed values: fields whose change is a change of the offer, and those of them that are numbers
CORE = ["title", "institution", "reference", "publication_date", "deadline", "source_status"]
NUMBERS = ["estimated_amount", "bond_amount", "prize_amount"]
LABELS_OF_AMOUNT = ["estimated_currency", "tax_mode"]


def canonical(c: Column, number: bool = False) -> Column:
    """A value as it is compared: markup, typographic signs, case and spaces do not count; a number loses its final zeros; empty is null."""
    said = F.translate(plain(c.cast("string")), "’‘–—", "''--")
    text = F.nullif(normalize_text(said), F.lit(""))
    if not number:
        return text
    exact = c.cast("string").try_cast("decimal(38,10)").cast("string")
    trimmed = F.regexp_replace(F.regexp_replace(exact, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.coalesce(trimmed, text)


def canonical_list(c: Column) -> Column:
    """A list as a set of compared values: its order does not count; an empty one is null."""
    values = F.array_sort(F.array_compact(F.transform(c, lambda x: canonical(x))))
    return F.when(F.size(values) > 0, F.to_json(values))


def business_changes(before: Column, after: Column, fields: list[str], lists: list[str] = (), known: Column | None = None) -> Column:
    """Array of (field, before, after) of two structs' fields that differ in value.

    ``known``: names that the old version had at all; without it all were.  Currency and tax wording count only where
    one of both versions has an amount.
    """

    def differs(f: str) -> Column:
        one, two = ((canonical_list(s[f]) if f in lists else canonical(s[f], f in NUMBERS)) for s in (before, after))
        changed = ~one.eqNullSafe(two)
        if f in LABELS_OF_AMOUNT and "estimated_amount" in fields:
            changed = changed & (before["estimated_amount"].isNotNull() | after["estimated_amount"].isNotNull())
        return changed & F.array_contains(known, f) if known is not None else changed

    said = lambda s, f: F.to_json(s[f]) if f in lists else s[f].cast("string")
    return F.array_compact(F.array(*[F.when(differs(f), F.struct(F.lit(f).alias("field"), said(before, f).alias("before"), said(after, f).alias("after"))) for f in fields]))


def snapshot(fields: list[str]) -> Column:
    """Struct of the named columns as text, for an audit entry."""
    return F.struct(*[F.col(f"`{f}`").cast("string").alias(f) for f in fields])


def decide(results: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decisions of people about versions: (results with status, reviewer and decided_at; refused decisions with a reason).

    ``results``: id, version, status, current; ``decisions``: id, version, verdict, reviewer, at.  A decision about
    another version than the present one, about a row that is not current (unless it rejects), or about none is
    refused.  Of several good ones the last counts.
    """
    met = decisions.alias("d").join(results.select("id", F.col("version").alias("present"), "current").alias("r"), "id", "left")
    reason = F.when(F.col("present").isNull(), "unknown_row").when(F.col("present") != F.col("version"), "changed_since_shown").when(~F.col("current") & (F.col("verdict") == "APPROVED"), "not_current")
    judged = met.withColumn("reason", reason)
    last = judged.filter("reason IS NULL").groupBy("id").agg(F.max_by(F.struct("verdict", "reviewer", "at"), F.struct("at", "reviewer", "verdict")).alias("d"))
    out = results.join(last, "id", "left").withColumns({"status": F.coalesce("d.verdict", "status"), "reviewer": F.col("d.reviewer"), "decided_at": F.col("d.at")}).drop("d")
    return out, judged.filter("reason IS NOT NULL").select("id", "version", "verdict", "reviewer", "at", "reason")


def unchanged(same_rules: Column, same_hash: Column, n_changes: Column) -> Column:
    """Whether an earlier analysis may be used again: made by the same rules, of the same content or without a change that matters."""
    return F.coalesce(same_rules & (same_hash | (n_changes == 0)), F.lit(False))
