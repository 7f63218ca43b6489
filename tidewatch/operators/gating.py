"""What a model is asked, what a person must see, how an address and a judged row are labelled: decisions as Columns.

Rows are structs, as in ``conditions``; a missing flag counts as not set.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import procurement_terms as T
from ..functions import urls
from ..functions.text import fold_text
from . import procurement
from .conditions import FRESH_DAYS
from .rules import first, part

# fixed values: reasons that a reviewer sees under another name, words of pages about notices, closed states
REVIEW_CODES = {
    "home_unclear": "GEOGRAPHY_AMBIGUOUS",
    "geography_ambiguous": "GEOGRAPHY_AMBIGUOUS",
    "deadline_unknown": "DEADLINE_UNCLEAR",
    "official_confirmation_missing": "OFFICIAL_URL_NOT_CONFIRMED",
    "missing:url": "OFFICIAL_URL_NOT_CONFIRMED",
    "status_unclear": "STATUS_UNCLEAR",
    "official_or_reliable_source_missing": "SECONDARY_SOURCE_ONLY",
    "review:reference_conflict": "REFERENCE_CONFLICT",
    "review:source_conflict": "OFFICIAL_SOURCE_CONFLICT",
    "ai_confidence_requires_review": "MEDIUM_AI_CONFIDENCE",
    "medium_ai_confidence": "MEDIUM_AI_CONFIDENCE",
    "procedure_unclear": "PROCEDURE_UNCLEAR",
}
PROCUREMENT_WORDS = ["appel d offres", "marches publics", "consultations", "achats"]
OVER = ["closed", "expired", "awarded", "cancelled"]
VERIFIED, CREDIBLE, UNRESOLVED = "VERIFIED_OFFICIAL", "UNVERIFIED_BUT_CREDIBLE", "UNRESOLVED"


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _said(c: Column) -> Column:
    return _yes(c != "")


def question(o: Column) -> Column:
    """Struct (ask, why) of an outcome: whether a model is asked, and the reason that is kept for the audit."""
    why = first([("INSUFFICIENT_BUSINESS_VALUE", ~o["valid"]), ("MATERIAL_AMBIGUITY", o["ask"]), ("NO_AMBIGUITY", o["review"])], "DETERMINISTIC_CONFIDENCE")
    return F.struct((o["valid"] & o["ask"]).alias("ask"), why.alias("why"))


def review_code(reason: Column) -> Column:
    """Name of a reason as reviewers see it."""
    known = F.create_map(*[F.lit(x) for pair in REVIEW_CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, reason), F.upper(F.replace(reason, F.lit(":"), F.lit("_"))))


def review_codes(reasons: Column) -> Column:
    return F.array_distinct(F.transform(reasons, review_code))


def official_institution(url: Column) -> Column:
    """Whether an address is of a readable site that is no gathering site."""
    return urls.domain_match(url, [d for d in T.READABLE if d not in T.AGGREGATORS])


def strong_evidence(r: Column, as_of: Column) -> Column:
    """Whether official facts alone carry a notice: at home, confirmed on its own page, open, dated, named, wanted, without conflict."""
    facts = [
        r["at_home"], _said(r["home_evidence"]), r["confirmed"], procurement.direct_notice(r["official_url"]), r["status"] == "open", _said(r["reference"]),
        r["deadline"] > as_of, r["procedure"] != "unknown", r["business"] == "keep", ~_yes(r["source_conflict"]), ~_yes(r["reference_conflict"]),
    ]
    return F.forall(F.array(*[_yes(f) for f in facts]), lambda x: x)


def verdict(o: Column, model: Column, business: Column, strong: Column, accept: float = 0.80, review: float = 0.55) -> Column:
    """Struct (relevant, manual, reasons) of a notice from its outcome and a model's answer (relevant, confidence, manual).

    Rules outrank the model: a notice they reject stays out, one they keep is at most sent to a person where the model
    rejects it.  Middling confidence goes to a person unless official facts alone carry the notice.
    """
    middling = model["confidence"] < accept
    dropped = ~model["relevant"] | ((model["confidence"] < review) & ~o["review"])
    doubted = dropped | (business == "review")
    cleared = middling & ~o["review"] & strong & ~model["manual"]
    manual = o["review"] | model["manual"] | middling
    own = F.when(o["review"], o["reasons"]).when(model["manual"], F.array(F.lit("AI_REVIEW_REQUESTED"))).otherwise(F.array().cast("array<string>"))
    low = F.when(middling, F.array(F.lit("ai_confidence_requires_review"))).otherwise(F.array().cast("array<string>"))
    why = (
        F.when(~o["valid"], o["reasons"])
        .when(doubted, F.concat(o["reasons"], F.array(F.lit("BUSINESS_FIT_REQUIRES_HUMAN_REVIEW"))))
        .when(cleared | ~manual, F.array().cast("array<string>"))
        .otherwise(review_codes(F.concat(own, low)))
    )
    return F.struct(o["valid"].alias("relevant"), (o["valid"] & (doubted | (manual & ~cleared))).alias("manual"), why.alias("reasons"))


def without_model(o: Column) -> Column:
    """The row kept for a candidate that no model saw: (relevant, priority, score, category, confidence, manual, reason).

    A valid one waits for a person without confidence, a rejected one is certain.
    """
    return F.struct(
        o["valid"].alias("relevant"), F.lit(3).alias("priority"), F.lit(0).alias("score"), F.lit("other").alias("category"),
        F.when(o["valid"], 0.0).otherwise(1.0).alias("confidence"), o["valid"].alias("manual"), F.array_join(o["reasons"], "; ").alias("reason"),
    )


def memory(agent: str, rules: str, schema: str, prompt: str, o: Column) -> Column:
    """What an analysis was made by; it may be used again only for an equal one."""
    return F.struct(
        F.lit(agent).alias("agent"), F.lit(rules).alias("rules"), F.lit(schema).alias("schema"), F.substring(F.sha2(F.lit(prompt), 256), 1, 12).alias("prompt"),
        F.to_json(o, {"ignoreNullFields": "false"}).alias("outcome"),
    )


def page_type(url: Column, n_rows: Column, text: Column) -> Column:
    """What a page about notices is: one notice, an institution's list, a category, a list, an organisation's page, or none of them."""
    some = n_rows > 0
    return first([
        ("tender_detail", procurement.notice_page(url)),
        ("institutional_procurement", some & (procurement.source_role(url) == "OFFICIAL_INSTITUTIONAL")),
        ("procurement_category", some & (F.contains(url, F.lit("secteur/")) | F.contains(url, F.lit("category")))),
        ("tender_list", some),
        ("generic_org", part(fold_text(text), PROCUREMENT_WORDS)),
    ], "non_procurement")


def read_before_rejecting(code: Column, source_type: Column, url: Column, architectural: Column, role_fit: Column) -> Column:
    """Whether a listing's rejection waits for its page: only for want of domain, role or detail, on an official notice page, with some sign of the trade."""
    open_ = code.isin("REJECT_NO_HERITAGE_OR_ARCHITECTURE_CONTEXT", "REJECT_NO_ARCHITECTURAL_ROLE", "REJECT_GENERIC_ARCHITECTURE_NOT_STRATEGIC")
    return _yes(open_ & source_type.isin("OFFICIAL_PROCUREMENT", "OFFICIAL_INSTITUTIONAL") & procurement.notice_page(url) & (_yes(architectural) | _yes(role_fit)))


def address_status(r: Column) -> Column:
    """How well a notice's address is known: from its own official page to not at all.  ``found_at``: where it was discovered."""
    good = _yes(r["confirmed"]) & procurement.notice_page(r["official_url"]) & ~procurement.list_title(r["title"])
    seen = F.coalesce(F.nullif(r["found_at"], F.lit("")), F.nullif(r["url"], F.lit("")))
    platform = lambda u: urls.domain_match(u, [T.OFFICIAL_PLATFORM])
    return first([
        ("VERIFIED_DIRECT", good & procurement.direct_notice(r["official_url"])),
        ("VERIFIED_INSTITUTIONAL", good & official_institution(r["official_url"]) & ~platform(r["official_url"])),
        ("INDIRECT_PMMP", platform(seen)),
        ("SECONDARY_ONLY", seen.isNotNull()),
    ], "NOT_FOUND")


def strong_identity(r: Column) -> Column:
    """Whether two of reference, buyer and a telling title name a notice found on a known site, without conflict."""
    at = F.coalesce(F.nullif(r["found_at"], F.lit("")), r["url"])
    title, reference = fold_text(r["title"]), fold_text(r["reference"])
    telling = (F.size(F.split(title, " ")) >= 2) & (title != reference)
    signs = [_yes(r["reference"].rlike("[0-9]")), _yes(F.length(fold_text(r["institution"])) >= 3), telling]
    known = _yes(urls.scheme(at).isin("http", "https")) & procurement.source_role(at).isNotNull()
    clear = ~_yes(r["source_conflict"]) & ~_yes(r["reference_conflict"]) & ~procurement.list_title(r["title"])
    return known & clear & (sum((s.cast("int") for s in signs), F.lit(0)) >= 2)


def credible(r: Column, as_of: Column, now: Column) -> Column:
    """Whether a notice without an official page may wait for a person: well identified, at home, not over, its dates fresh or unknown."""
    age = F.datediff(as_of, r["published"])
    over = _yes(r["status"].isin(OVER)) | _yes(r["published"] > as_of) | _yes(r["deadline"] < as_of) | _yes(r["deadline_at"] <= now)
    fresh = (r["deadline"].isNull() & r["published"].isNull()) | _yes(r["deadline"] >= as_of) | _yes(age.between(0, FRESH_DAYS["procurement"]))
    return strong_identity(r) & _yes(r["at_home"]) & ~over & fresh


def resolution(state: Column, url: Column, found_at: Column, official_url: Column) -> Column:
    """Struct (url, official_url, confirmed, quality, access, confidence) that a resolution leaves: without proof the row falls back to where it was found."""
    proven = state == VERIFIED
    return F.struct(
        F.when(proven, url).otherwise(F.coalesce(found_at, url)).alias("url"), F.when(proven, official_url).alias("official_url"), proven.alias("confirmed"),
        F.when(proven, "OFFICIAL_PRIMARY").otherwise("RELIABLE_SECONDARY").alias("quality"), F.when(~proven, "SECONDARY_DISCOVERY").alias("access"),
        F.when(proven, 1.0).otherwise(0.0).alias("confidence"),
    )


def reliable_status(r: Column) -> Column:
    """Whether a legal status has evidence of an official source."""
    return _yes(r["reliable"]) & _yes(r["official"]) & _said(r["evidence"])


# fixed values: letters of legal and funding states, how far a claim of law goes
POLICY_LETTERS = {"ADOPTED": "A", "PUBLISHED": "A", "IN_FORCE": "A", "IMPLEMENTATION": "B", "DRAFT": "C", "UNDER_PREPARATION": "C", "PUBLIC_CONSULTATION": "C"}
FUNDING_LETTERS = {"open": "A", "active": "B", "preparation": "C", "pipeline": "D", "closed": "E"}
LEGAL_RANK = {"ADOPTED": 1, "PUBLISHED": 2, "IN_FORCE": 3}


def _of(values: dict, key: Column, other) -> Column:
    return first([(v, key == k) for k, v in values.items()], other)


def policy_class(r: Column, claimed: Column) -> Column:
    """Struct (status, letter, refused): evidence caps the claim; an analysis that claims more law than its source is refused whole."""
    said = F.upper(r["status"])
    proven = reliable_status(r)
    draft = F.upper(r["document_type"]).isin("DRAFT_LAW", "PUBLIC_CONSULTATION")
    more = _of(LEGAL_RANK, claimed, 0) > F.when(proven & ~_yes(draft), _of(LEGAL_RANK, said, 0)).otherwise(0)
    legal = F.when(proven, said).otherwise("POLICY_SIGNAL")
    return F.struct(F.when(~more, legal).alias("status"), F.when(~more, _of(POLICY_LETTERS, legal, "D")).alias("letter"), more.alias("refused"))


def funding_class(r: Column) -> Column:
    """Struct (letter, access): direct access needs confirmed eligibility from an official source."""
    sure = _yes(r["eligible"]) & _said(r["eligibility"]) & _yes(r["official"])
    return F.struct(_of(FUNDING_LETTERS, r["status"], "unknown").alias("letter"), F.when((r["mode"] == "DIRECT_ACCESS") & ~sure, "MONITORING_ONLY").otherwise(r["mode"]).alias("access"))


def deadline_class(deadline: Column, priority: Column, as_of: Column) -> Column:
    """Struct (deadline, fit) of a notice."""
    return F.struct(first([("unknown", deadline.isNull()), ("expired", deadline < as_of)], "active").alias("deadline"), F.when(priority == 1, "direct").otherwise("potential").alias("fit"))


# What a row says that no model saw, by the kind of its record.
REVIEW_SCORE, REVIEW_CONFIDENCE = 85, {"project": 0.9, "institution": 0.9, "policy": 0.92, "funding": 0.9}
PROJECT_REASON, PROJECT_NOTE = "Concrete pre-procurement signal supported by the cited source.", "Potential architecture or territorial mission is forming."
INSTITUTION_REASON = "Public professional institutional evidence."
POLICY_CATEGORIES, FUNDING_CATEGORIES = {"LAW": "law", "DRAFT_LAW": "draft_law"}, {"GRANT": "grant", "TECHNICAL_ASSISTANCE": "technical_assistance"}


def review_row(kind: str, r: Column, doubts: Column) -> Column:
    """The row kept for a candidate that rules alone send to a person: (priority, score, category, summary, reason, confidence, review_reason, note).

    ``r`` by kind: project: priority, summary; institution: verified, activity, summary; policy: status, document_type, summary, implications, evidence; funding:
    letter, mode, summary, relevance.
    """
    if kind == "project":
        parts = (r["priority"], F.lit("project_preparation"), r["summary"], F.lit(PROJECT_REASON), F.lit(PROJECT_NOTE))
    elif kind == "institution":
        new = r["activity"].isin("NEW_APPOINTMENT", "LEADERSHIP_CHANGE")
        parts = (F.when(_yes(r["verified"]), 1).otherwise(2), F.when(new, "appointment").otherwise("institutional_activity"), r["summary"], F.lit(INSTITUTION_REASON), r["activity"])
    elif kind == "policy":
        parts = (F.when(r["status"].isin("ADOPTED", "IN_FORCE"), 1).otherwise(2), _of(POLICY_CATEGORIES, r["document_type"], "other"), r["summary"], r["implications"], r["evidence"])
    elif kind == "funding":
        parts = (F.when(r["letter"] == "A", 1).otherwise(2), _of(FUNDING_CATEGORIES, r["mode"], "investment"), r["summary"], r["relevance"], r["mode"])
    else:
        raise ValueError(f"no such kind: {kind}")
    priority, category, summary, reason, note = parts
    return F.struct(
        priority.cast("int").alias("priority"), F.lit(REVIEW_SCORE).alias("score"), category.alias("category"), summary.alias("summary"), reason.alias("reason"), F.lit(REVIEW_CONFIDENCE[kind]).alias("confidence"),
        F.nullif(F.array_join(doubts, "; "), F.lit("")).alias("review_reason"), note.alias("note"),
    )
