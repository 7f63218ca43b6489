"""Hits and candidates before they are kept: sources in their order, fields in bounds, addresses canonical, analyses in range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import urls, values
from ..functions.money import finite
from ..functions.text import normalize_text
from . import evidence, notices, procurement
from .rules import first, reasons

# What a source has unless it says otherwise, bounds of fields, and fields that a compact record leaves out.
SOURCE_DEFAULTS = {"source_type": "official", "parser_type": "HTML_LIST", "refresh_days": 7, "priority": 50, "enabled": True}
PARSERS = ["HTML_LIST", "TABLE", "RSS", "ATOM", "JSON_API"]
LONGEST = {"reference": 255, "institution": 255, "location": 500, "official_date_evidence": 500, "procedure_type": 100, "status": 100}
UNKNOWN_BEYOND = ["status", "procedure_type"]
MOST_METADATA, MOST_ADDRESS, MOST_TITLE, MOST_EVIDENCE = 65536, 4000, 2000, 20000
VERBOSE = [
    "raw_text", "metadata", "architecture_heritage_relevance", "recent_activity", "responsibility_scope", "scope", "summary", "business_implications", "business_relevance", "morocco_relevance",
    "potential_procurement", "eligibility", "status_evidence", "evidence_summary", "signal_evidence",
]
METADATA_TEXTS = ["evidence", "excerpt", "description", "content", "text"]
SNAPSHOT = ["title", "reference", "institution", "deadline", "publication_date", "source_status", "url"]


def planned_sources(records: DataFrame) -> DataFrame:
    """Sources that are read, with what they leave unsaid filled in, by ``place`` (priority, then as given by ``position``).

    ``records``: position, name, index_url and any of the other fields.  A source without a name or address, or with
    a kind of page that no parser reads, is refused: it comes last with ``error`` and without a place.
    """
    filled = {k: F.coalesce(F.col(k), F.lit(v)) if k in records.columns else F.lit(v) for k, v in SOURCE_DEFAULTS.items()}
    every = records.select("position", "name", "index_url", *[c.alias(k) for k, c in filled.items()])
    known = F.split("parser_type", ":")[0].isin(PARSERS) | F.contains("parser_type", F.lit(":"))
    error = first([("no_name", F.coalesce(F.trim("name"), F.lit("")) == ""), ("no_address", ~urls.scheme(F.coalesce("index_url", F.lit(""))).isin("http", "https")), ("unknown_parser", ~known)])
    from pyspark.sql import Window

    kept = every.filter("enabled").withColumn("error", error)
    w = Window.partitionBy(F.col("error").isNull()).orderBy("priority", "position")  # a catalogue of sources, not their items
    return kept.withColumn("place", F.when(F.col("error").isNull(), F.row_number().over(w)))


def listing_gate(title: Column, procedure: Column, category: Column, deadline: Column, as_of: Column) -> Column:
    """Struct (decision, reason, priority) of a listing before its page is read: one that is surely over goes, the title decides the rest."""
    over = F.struct(F.lit("reject").alias("decision"), F.lit("closed_or_expired").alias("reason"), F.lit(9).alias("priority"))
    return F.when(F.coalesce(values.date_of(deadline) < as_of, F.lit(False)), over).otherwise(notices.select_title(title, procedure, category))


def _bounded(name: str) -> Column:
    beyond = F.lit("unknown") if name in UNKNOWN_BEYOND else F.lit(None).cast("string")
    return F.when(F.length(name) > LONGEST[name], beyond).otherwise(F.col(name))


def admitted(hits: DataFrame) -> DataFrame:
    """Hits with their fields in bounds and their figures read; what names nothing has ``error``, and nothing stops the rest.

    ``hits``: id, title, url, evidence, deadline_at, estimated_amount, provisional_bond, at_home, found_from and the
    fields of ``LONGEST``.  A field that is too long is left out (a status or procedure is unknown), a time without a
    zone too; on sites that gather national notices a notice is at home unless it says otherwise.
    """
    named = (F.trim(F.coalesce("title", F.lit(""))) != "") | (F.coalesce("reference", F.lit("")) != "")
    zoned = F.col("deadline_at").rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$") & F.col("deadline_at").try_cast("timestamp").isNotNull()
    role = F.coalesce(procurement.source_role(F.col("url")), F.lit("DISCOVERY_ONLY"))
    e, bond = values.amount(F.col("estimated_amount")), values.amount(F.col("provisional_bond"))
    told = F.coalesce(F.col("estimated_amount") != "", F.lit(False))
    source = F.when(F.contains(urls.domain(F.col("url")), F.lit("marchefacile")), "MARCHE_FACILE").otherwise("SECONDARY")
    some = told & (e["amount"].isNotNull() | e["currency"].isNotNull() | e["tax_mode"].isNotNull())
    return hits.select(
        "id", F.when(~named, "title_or_reference_required").alias("error"), F.left(F.coalesce(F.nullif("title", F.lit("")), "reference"), F.lit(MOST_TITLE)).alias("title"), "url",
        F.left("evidence", F.lit(MOST_EVIDENCE)).alias("evidence"), *[_bounded(c).alias(c) for c in LONGEST], F.when(zoned, F.col("deadline_at")).alias("deadline_at"), role.alias("source_role"),
        F.coalesce("at_home", F.when(role == "PROCUREMENT_AGGREGATOR", True)).alias("at_home"), F.when(some, finite(e["amount"].cast("double"))).alias("amount"), F.when(some, e["currency"]).alias("currency"), F.when(some, e["tax_mode"]).alias("tax_mode"),
        F.when(some, source).alias("amount_source"), finite(bond["amount"].cast("double")).alias("bond"), F.when(bond["amount"].isNotNull(), bond["currency"]).alias("bond_currency"), F.coalesce("found_from", "url").alias("found_from"),
    )


def checked(candidates: DataFrame, addresses: list[str], accept: float = 0.80, review: float = 0.55) -> DataFrame:
    """Candidates with canonical addresses, and ``errors``: every bound that the candidate or its analysis breaks.

    ``candidates``: url, metadata (JSON text), the other ``addresses``, and analysis: struct of relevant, priority,
    score, category, summary, reason, confidence, manual (null where none was made).
    """
    if not 0 <= review <= accept <= 1:
        raise ValueError("thresholds must be 0 <= review <= accept <= 1")
    a = F.col("analysis")
    short = lambda c, most: ~F.coalesce(F.length(c).between(1, most), F.lit(False))
    has = a.isNotNull()
    broken = reasons([
        ("bad_url", (F.coalesce("url", F.lit("")) != "") & urls.canonical_url(F.col("url")).isNull()), ("metadata_too_long", F.coalesce(F.length("metadata") > MOST_METADATA, F.lit(False))),
        ("metadata_no_json", F.col("metadata").isNotNull() & F.try_parse_json("metadata").isNull()), *[(f"{c}_too_long", F.coalesce(F.length(c) > MOST_ADDRESS, F.lit(False))) for c in addresses],
        ("priority", has & ~F.coalesce(a["priority"].between(1, 5), F.lit(False))), ("score", has & ~F.coalesce(a["score"].between(0, 100), F.lit(False))), ("confidence", has & ~F.coalesce(a["confidence"].between(0, 1) & ~F.isnan(a["confidence"]), F.lit(False))),
        ("category", has & short(a["category"], 100)), ("summary", has & short(a["summary"], 2000)), ("reason", has & short(a["reason"], 2000)),
    ])
    canonical = {c: urls.canonical_url(F.nullif(F.col(c), F.lit(""))) for c in ["url", *addresses]}
    return candidates.withColumn("errors", broken).withColumns(canonical)


def compact(candidates: DataFrame, fields: list[str], metadata: str = "metadata", snippet: int = 500) -> DataFrame:
    """``id``, ``payload``: a candidate as JSON without its long texts, with the words and sentences of those that matter.

    ``fields`` are the candidate's columns; those of ``VERBOSE`` are evidence only, null ones are left out.
    """
    texts = [F.coalesce(F.col(c), F.lit("")) for c in fields if c in VERBOSE and c != metadata] + [F.coalesce(F.get_json_object(metadata, f"$.{k}"), F.lit("")) for k in METADATA_TEXTS]
    whole = F.concat_ws(" ", *texts)
    low = F.lower(whole)
    words = F.array_sort(F.filter(F.array(*[F.lit(k) for k in L.EVIDENCE_KEYWORDS]), lambda k: F.contains(low, k)))
    strings = {c: candidates.schema[c].dataType.typeName() == "string" for c in fields}
    kept = F.struct(*[(F.left(c, F.lit(snippet)) if strings[c] else F.col(c)).alias(c) for c in fields if c not in VERBOSE])
    payload = F.to_json(F.struct(kept.alias("candidate"), words.alias("signal_keywords"), evidence.ranked_sentences(whole, sentence_chars=snippet).alias("evidence_snippets")))
    return candidates.select("id", payload.alias("payload"))


def snapshot(r: dict[str, Column]) -> Column:
    """What a discovery said, folded: equal snapshots are one discovery that has not changed.  ``r``: the fields of ``SNAPSHOT``."""
    return F.struct(*[(r[k].cast("string") if k in ("deadline", "publication_date") else normalize_text(r[k])).alias(k) for k in SNAPSHOT])
