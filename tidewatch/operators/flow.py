"""A notice from discovery to its outcome as one plan: copies, first look, relevance, own page, proof, verdict.

Every hit keeps its row and gets an outcome with the stage and reason that decided it; what fails at a stage carries
its error on and costs nothing at later ones (their expressions stand behind conditions).  Hits are read once, pages
joined once by address; first hits are found by an aggregation, so a discovery that a third of all hits share is
counted before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.procurement_terms import LARGE_ESTIMATE
from ..functions.text import fold_text
from ..functions.values import date_of
from ..sources import notice_pages
from . import details, gating, procurement
from .rules import first

OVER = ["closed", "expired", "awarded", "cancelled"]
UNNAMED = ["consultation pmmp", "details", "detail"]  # fixed values: titles that say nothing
LEAST_OBJECT, CUT_ENDS = 20, r"(\.\.\.|…)\s*$"
OFFICIAL = ["OFFICIAL_PROCUREMENT", "OFFICIAL_INSTITUTIONAL"]
STAGES = ["normalize", "duplicate", "known", "prefilter", "relevance", "page", "freshness", "proof", "verdict", "complete", "accepted"]

HIT = ("position", "reference", "institution", "title", "url", "evidence", "status", "deadline", "published", "found_at", "at_home", "amount", "amount_verified")


def signature(reference: Column, institution: Column, title: Column) -> Column:
    """Digest of what makes two hits one discovery; null where nothing is said."""
    parts = [fold_text(c) for c in (reference, institution, title)]
    return F.when(F.concat(*parts) != "", F.unhex(F.sha2(F.concat_ws("\n", *parts), 256)))


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def processed(hits: DataFrame, pages: DataFrame, known: DataFrame, as_of: Column, now: Column, indexed: bool = False, large: float = LARGE_ESTIMATE) -> DataFrame:
    """``position``, ``outcome``, ``stage``, ``reason``, ``resolution``, ``category``, ``priority``, ``official_url`` of every hit.

    ``hits``: the columns of ``HIT`` (``position`` is unique); ``pages``: url, page; ``known``: signature of
    discoveries that led to an outcome and have not changed.  Outcomes: accepted, rejected (for good), retry (nothing
    was decided), skipped (a copy, or known).  ``indexed``: hits come from the platform's index, so only their own
    page counts and its object must be whole; without it a well identified notice may wait for a person.
    """
    h = hits.select(*HIT).withColumn("sig", signature(F.col("reference"), F.col("institution"), F.col("title")))
    firsts = h.filter("sig IS NOT NULL").groupBy("sig").agg(F.min("position").alias("position"))
    seen = known.select(F.col("signature").alias("sig")).distinct().withColumn("_known", F.lit(True))
    marked = firsts.join(seen, "sig", "left").select("position", F.coalesce("_known", F.lit(False)).alias("_known"), F.lit(True).alias("_first"))
    own = pages.select(F.col("url").alias("_url"), F.col("page").alias("_page"))
    met = h.join(marked, "position", "left").join(own, F.col("url") == F.col("_url"), "left")

    role = procurement.source_role(F.col("url"))
    named = (F.trim(F.coalesce("title", F.lit(""))) != "") | (F.coalesce("reference", F.lit("")) != "")
    scope = F.concat_ws(" ", "evidence", "institution")
    early = first([
        ("normalize", ~named), ("duplicate", F.col("sig").isNotNull() & ~_yes(F.col("_first"))), ("known", _yes(F.col("_known"))),
    ])
    a = met.withColumn("_role", role).withColumn("_early", early)
    # the signs of the title as it was found serve the first look and the relevance
    a = a.withColumn("_signs", F.when(F.col("_early").isNull(), procurement.noted(F.col("title"), scope, F.lit(""))))
    a = a.withColumn("_look", F.when(F.col("_early").isNull(), procurement.first_look(F.col("_signs"))))
    a = a.withColumn("_early", F.coalesce("_early", F.when(F.col("_look.decision") == "reject", "prefilter")))
    told = fold_text(F.col("title"))
    meaningful = (told != "") & (told != fold_text(F.col("reference"))) & ~told.isin(UNNAMED)
    figures = (F.lit(""), F.col("amount"), F.col("amount_verified"), large)
    a = a.withColumn("_business", F.when(F.col("_early").isNull(), procurement.judged(F.col("_signs"), *figures)))
    waits = gating.read_before_rejecting(F.col("_business.reason"), F.col("_role"), F.col("url"), F.array_contains("_business.signals", "ARCHITECTURAL_SCOPE"), F.col("_business.role_fit"))
    a = a.withColumn("_early", F.coalesce("_early", F.when(meaningful & (F.col("_business.decision") == "reject") & ~waits, "relevance")))

    # the page: what it says goes before what was found elsewhere
    official = F.col("_early").isNull() & F.col("_role").isin(OFFICIAL) & procurement.notice_page(F.col("url"))
    a = a.withColumn("_facts", F.when(official & F.col("_page").isNotNull(), notice_pages.labelled(F.col("_page.texts"))))
    fact = lambda k: F.try_element_at("_facts", F.lit(k))
    read = F.col("_facts").isNotNull()
    clash = _yes((fold_text(fact("reference")) != fold_text(F.col("reference"))) & (fact("reference") != "") & (F.col("reference") != ""))
    a = a.withColumns({
        "_title": F.coalesce(fact("title"), F.col("title")), "_institution": F.coalesce(fact("institution"), F.col("institution")), "_reference": F.coalesce(fact("reference"), F.col("reference")),
        "_deadline": F.coalesce(date_of(fact("deadline")), F.col("deadline")), "_status": F.coalesce(fact("status"), F.col("status")),
    })
    r = F.struct(*[F.col(f"_{c}").alias(c) for c in ("title", "reference", "institution", "deadline")], F.col("url"), F.col("_page.text").alias("text"), F.transform(F.col("_page.rows"), lambda x: x["text"]).alias("rows"), F.col("_page.headings").alias("headings"))
    short = (F.length(fold_text(fact("title"))) < LEAST_OBJECT) | fact("title").rlike(CUT_ENDS) | fact("title").isNull()
    over = _yes(F.col("_status").isin(OVER)) | _yes(F.col("_deadline") < as_of)
    faults = [("not_read", ~read), ("reference_mismatch", clash), ("closed_or_expired", over)]
    if indexed:
        faults = [("not_read", ~read), ("reference_mismatch", clash), ("official_deadline_missing", date_of(fact("deadline")).isNull()), ("closed_or_expired", over), ("official_object_incomplete", short)]
    a = a.withColumn("_fault", F.when(F.col("_early").isNull(), F.coalesce(first(faults), details.unproven(r))))
    wait = F.struct(F.col("title"), F.col("reference"), F.col("institution"), F.col("url"), F.col("found_at"), F.col("status"), F.col("deadline"), F.lit(None).cast("timestamp").alias("deadline_at"), F.col("published"), F.col("at_home"), F.lit(False).alias("source_conflict"), F.lit(False).alias("reference_conflict"))
    may_wait = ~F.lit(indexed) & ~F.col("_fault").isin("reference_mismatch", "closed", "closed_or_expired") & gating.credible(wait, as_of, now)
    state = F.when(F.col("_early").isNull(), F.when(F.col("_fault").isNull(), "VERIFIED").when(may_wait, "CREDIBLE").otherwise("UNRESOLVED"))
    a = a.withColumn("resolution", state)

    verified, alive = F.col("resolution") == "VERIFIED", F.col("resolution").isin("VERIFIED", "CREDIBLE")
    last_title = F.when(verified, F.col("_title")).otherwise(F.col("title"))
    other = alive & ~last_title.eqNullSafe(F.col("title"))  # a title that stays has been judged
    a = a.withColumn("_business", F.when(other, procurement.relevance(last_title, scope, *figures)).otherwise(F.col("_business")))
    refused = (F.col("_business.decision") == "reject") | procurement.list_title(last_title)
    incomplete = verified & (~_yes(F.col("at_home")) | (F.coalesce("_institution", F.lit("")) == "") | F.col("_deadline").isNull())
    stage = F.coalesce("_early", first([
        ("freshness", F.col("_fault").isin("closed_or_expired", "closed")), (F.when(F.col("_fault") == "not_read", "page").otherwise("proof"), F.col("resolution") == "UNRESOLVED"),
        ("verdict", refused), ("complete", incomplete),
    ], "accepted"))
    a = a.withColumn("stage", stage)
    reason = first([
        ("missing_title_or_reference", F.col("stage") == "normalize"), ("duplicate_discovery_signature", F.col("stage") == "duplicate"), ("known_unchanged", F.col("stage") == "known"),
        ("irrelevant_business_purpose", F.col("stage").isin("prefilter", "relevance", "verdict")), ("closed_or_expired", F.col("stage") == "freshness"), (F.col("_fault"), F.col("stage").isin("page", "proof")),
        ("missing_geography_buyer_or_deadline", F.col("stage") == "complete"), ("verified_offer", verified),
    ], "credible_fallback")
    outcome = first([("accepted", F.col("stage") == "accepted"), ("skipped", F.col("stage").isin("duplicate", "known")), ("retry", F.col("stage").isin("page", "proof", "normalize"))], "rejected")
    kept = F.col("stage") == "accepted"
    return a.select(
        "position", outcome.alias("outcome"), "stage", reason.alias("reason"), "resolution", F.when(kept, F.col("_business.category")).otherwise("REJECT").alias("category"),
        F.when(kept, F.col("_business.priority")).alias("priority"), F.when(kept & verified, procurement.canonical_detail(F.col("url"))).alias("official_url"),
    )


def backfill(listings: DataFrame, pages: DataFrame, known: DataFrame, as_of: Column, now: Column) -> DataFrame:
    """Rows of the index through their own first look, then the indexed flow: the same columns as :func:`processed`.

    ``listings``: the columns of ``HIT``, procedure, category, location.  What the first look rejects is not read.
    """
    look = procurement.listing_plausible(*[F.col(c) for c in ("title", "institution", "procedure", "category", "location", "reference")])
    looked = listings.withColumn("_look", look)
    passed = processed(looked.filter("_look.decision <> 'reject'"), pages, known, as_of, now, indexed=True)
    out = looked.filter("_look.decision = 'reject'").select("position", F.lit("rejected").alias("outcome"), F.lit("prefilter").alias("stage"), F.col("_look.reason").alias("reason"))
    blank = out.select(*out.columns, *[F.lit(None).cast(passed.schema[c].dataType).alias(c) if c != "category" else F.lit("REJECT").alias(c) for c in passed.columns[4:]])
    return passed.unionByName(blank)


def observed(flow: DataFrame, name: str = "flow") -> tuple[DataFrame, Observation]:
    """The flow, and an observation of how many hits each stage decided, filled by whatever action reads the flow."""
    seen = Observation(name)
    return flow.observe(seen, F.count("*").alias("hits"), *[F.count_if(F.col("stage") == s).alias(s) for s in STAGES]), seen
