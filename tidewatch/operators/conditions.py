"""Conditions that a record must meet, compiled to Columns: an outcome with its reasons.

An outcome is a struct (valid, review, ask, reasons): whether the record stands, whether a person must look at it,
whether a model may be asked, and why.  The first rejection decides alone; doubts add up.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import urls
from .rules import first, reasons

TEXT, FLAG = "string", "boolean"


@dataclass(frozen=True)
class Test:
    """A test of one field: ``equals`` a value, is ``present`` (not null, empty, false or zero), or is ``in`` a list."""

    name: str
    kind: str
    value: object = True

    def column(self, r: Column) -> Column:
        c = r[self.name]
        if self.kind == "equals":
            met = c == F.lit(self.value)
        elif self.kind == "in":
            met = c.isin(list(self.value))
        elif self.kind == "present":
            met = ~c.cast(TEXT).isin("", "false", "0", "0.0")
        else:
            raise ValueError(f"no such test: {self.kind}")
        return F.coalesce(met, F.lit(False))


@dataclass(frozen=True)
class Conditions:
    """What one kind of record must meet.  Of each group of ``mandatory`` fields one must be present."""

    include: tuple[Test, ...] = ()
    exclude: tuple[Test, ...] = ()
    sources: tuple[str, ...] = ()
    mandatory: tuple[tuple[str, ...], ...] = ()
    doubts: tuple[Test, ...] = ()
    fresh_days: int = 30
    fresh_by: str = "publication_date"
    home: bool = True
    accept: float = field(default=0.80)
    review: float = field(default=0.55)

    def __post_init__(self):
        if not 0 <= self.review <= self.accept <= 1:
            raise ValueError("thresholds must satisfy 0 <= review <= accept <= 1")

    def evaluate(self, r: Column, as_of: Column) -> Column:
        """The outcome for a record struct; it has ``at_home``, ``source_quality``, ``current_evidence`` and the named fields."""
        any_ = lambda tests: F.exists(F.array(*[t.column(r) for t in tests]), lambda x: x)
        seen = r[self.fresh_by]
        rejected = [(f"excluded:{t.name}", t.column(r)) for t in self.exclude]
        if self.home:
            rejected.append(("outside_home", F.coalesce(~r["at_home"], F.lit(False))))
        if self.include:
            rejected.append(("no_concrete_inclusion_signal", ~any_(self.include)))
        rejected.append(("old_without_current_evidence", F.coalesce((F.datediff(as_of, seen) > self.fresh_days) & ~F.coalesce(r["current_evidence"], F.lit(False)), F.lit(False))))
        doubts = [("missing:" + "|".join(group), ~any_([Test(n, "present") for n in group])) for group in self.mandatory]
        if self.home:
            doubts.append(("home_unclear", ~F.coalesce(r["at_home"], F.lit(False))))
        doubts.append(("source_not_reliable", ~F.coalesce(r["source_quality"].isin(list(self.sources)), F.lit(False))))
        doubts.append(("date_in_future", F.coalesce(seen > as_of, F.lit(False))))
        doubts += [(f"review:{t.name}", t.column(r)) for t in self.doubts]
        return outcome(rejected, doubts)


#: Days after which a record of each kind is old.
FRESH_DAYS = {"procurement": 30, "project": 90, "institution": 180, "policy": 365, "funding": 180}


def outcome(rejected: list[tuple[str, Column]], doubts: list[tuple[str, Column]], ask: Column | None = None) -> Column:
    """First rejection, else all doubts.  Without ``ask`` a model may be asked only where there is no doubt."""
    why, doubt = first(rejected), reasons(doubts)
    sure = F.size(doubt) == 0
    return F.struct(
        why.isNull().alias("valid"),
        (why.isNull() & ~sure).alias("review"),
        (why.isNull() & (sure if ask is None else ask)).alias("ask"),
        F.when(why.isNotNull(), F.array(why)).otherwise(doubt).alias("reasons"),
    )


def both(a: Column, b: Column) -> Column:
    """Two outcomes as one: both must stand, either may doubt, both must allow a question; reasons in order, each once."""
    return F.struct(
        (a["valid"] & b["valid"]).alias("valid"), (a["review"] | b["review"]).alias("review"),
        (a["ask"] & b["ask"]).alias("ask"), F.array_distinct(F.concat(a["reasons"], b["reasons"])).alias("reasons"),
    )


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _said(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def project(r: Column) -> Column:
    """Outcome of an announced project; ``business`` is the decision of the shared boundary."""
    weak = (r["maturity"] == "C") & (r["source_quality"] == "RELIABLE_SECONDARY")
    doubts = [("signal_evidence_missing", ~_said(r["evidence"])), ("ambiguous_secondary_signal", _said(r["evidence"]) & (_yes(weak) | (r["business"] == "review")))]
    return outcome([
        ("outside_scope", r["business"] == "reject"), ("already_published_tender", _yes(r["tender"])),
        ("completed_without_new_phase", _yes(r["completed"]) & ~_yes(r["new_phase"])), ("weak_or_vague_signal", _yes(r["maturity"] == "D") | _yes(r["vague"])),
    ], doubts, F.size(reasons(doubts)) > 0)


def institution(r: Column, as_of: Column) -> Column:
    """Outcome of an institution or of a person in it; a role counts as verified for 180 days."""
    proven = _yes(r["official"]) & _said(r["person"]) & _said(r["position"]) & _yes(F.datediff(as_of, r["verified_on"]).between(0, FRESH_DAYS["institution"]))
    named = _said(r["person"])
    status = r["status"]
    profile = _yes(r["official"]) & ((_said(r["mission"]) & _yes(r["profile_evidence"])) | (_said(r["activity"]) & r["activity_date"].isNotNull()))
    return outcome([
        ("outside_scope", r["business"] == "reject"), ("private_personal_data", ~_yes(r["public_only"])), ("institution_not_relevant", ~_yes(r["relevant"])),
        ("obsolete_role_holder", _yes(r["obsolete"]) | (named & _yes(status == "OBSOLETE"))),
        ("current_role_evidence_missing_or_stale", named & _yes(status == "VERIFIED_CURRENT") & ~proven),
        ("unverified_named_profile", named & ~_yes(status.isin("VERIFIED_CURRENT", "PROBABLY_CURRENT")) & ~proven),
    ], [
        ("current_role_not_confirmed", named & _yes(status == "PROBABLY_CURRENT")), ("institutional_relevance_requires_review", ~named & ~profile),
    ], ~named & ~profile)


def bulletin_page(url: Column) -> Column:
    """Whether an address is of an issue of the official bulletin."""
    return (urls.domain(url) == "sgg.gov.ma") & F.contains(F.lower(urls.path(url)), F.lit("/bo/")) & F.endswith(F.lower(urls.path(url)), F.lit(".pdf"))


def policy(r: Column, as_of: Column) -> Column:
    """Outcome of a policy: what it claims to be in law must be proven by an official publication."""
    status, kind = F.upper(r["status"]), F.upper(r["document_type"])
    claimed = _yes(status.isin("ADOPTED", "PUBLISHED", "IN_FORCE"))
    proven = _yes(r["reliable"]) & _yes(r["official"]) & _said(r["evidence"])
    doubt = ~proven | _yes(status == "POLICY_SIGNAL") | (r["business"] == "review")
    return outcome([
        ("outside_scope", r["business"] == "reject"),
        ("publication_not_verified", _yes(status.isin("PUBLISHED", "IN_FORCE")) & ~(_yes(r["published"]) & _yes(bulletin_page(r["status_url"])))),
        ("effective_date_not_verified", _yes(status == "IN_FORCE") & ~_yes(r["effective"] <= as_of)),
        ("contradictory_legal_status", claimed & _yes(kind.isin("DRAFT_LAW", "PUBLIC_CONSULTATION"))),
        ("legal_claim_without_reliable_status", claimed & ~proven),
    ], [("policy_status_requires_review", doubt)], doubt)


def funding(r: Column) -> Column:
    """Outcome of a funding notice."""
    doubts = [
        ("business_relevance_requires_review", r["business"] == "review"), ("home_unclear", r["at_home"].isNull()),
        ("direct_eligibility_unverified", _yes(r["mode"] == "DIRECT_ACCESS") & ~(_yes(r["eligible"]) & _said(r["eligibility"]) & _yes(r["official"]))),
    ]
    return outcome([
        ("outside_scope", r["business"] == "reject"), ("closed_without_strategic_relevance", _yes(r["status"] == "closed") & ~_yes(r["strategic"])),
        ("unrelated_to_home", _yes(~r["at_home"])),
    ], doubts, F.size(reasons(doubts)) > 0)


def notice(r: Column, as_of: Column, now: Column) -> Column:
    """Outcome of a procurement notice; ``business`` is its relevance, ``detail`` its address facts (see ``procurement``)."""
    age, due = F.datediff(as_of, r["published"]), r["deadline"]
    open_ = _yes(due >= as_of)
    waiting = _yes(r["credible"]) & _yes(r["attempted"])
    doubts = [
        ("official_url_not_confirmed", waiting), ("business_fit_requires_human_review", ~waiting & (r["business"] == "review")), ("home_unclear", ~waiting & r["at_home"].isNull()),
        ("deadline_unknown", due.isNull()), ("status_unclear", ~waiting & ~_yes(r["status"] == "open")), ("procedure_unclear", ~waiting & ~_yes(r["procedure"] != "unknown")),
    ]
    return outcome([
        ("not_relevant_individual_procurement", _yes(r["list_title"]) | (r["business"] == "reject")), ("future_publication", _yes(r["published"] > as_of)),
        ("old_without_active_deadline", _yes(age > FRESH_DAYS["procurement"]) & ~open_), ("unresolved_identity_or_stale_evidence", waiting & ~_yes(r["fallback_sound"])),
        ("unverified_procurement_detail", ~waiting & (~_yes(r["detail_verified"]) | ~_yes(r["confirmed"]) | ~_yes(r["official_page"]) | _yes(~r["at_home"]))),
        ("expired_opportunity", ~waiting & (_yes(due < as_of) | _yes(F.lower(r["status"]).isin("expired", "closed")))), ("expired_deadline_time", ~waiting & _yes(r["deadline_at"] < now)),
    ], doubts, ~waiting & (r["business"] == "keep") & _yes(r["confirmed"]) & _yes(r["status"] == "open"))


def obsolete(r: Column, as_of: Column, now: Column) -> Column:
    """Whether a queued notice has lost its sense: a list, unverified, closed, abroad, past its deadline, or old without new evidence."""
    due = r["deadline"]
    old = _yes(F.datediff(as_of, r["published"]) > FRESH_DAYS["procurement"]) & ~_yes(r["current_evidence"]) & ~_yes(due >= as_of)
    return (
        _yes(r["list_title"]) | (~_yes(r["detail_verified"]) & ~_yes(r["credible"])) | _yes(r["status"].isin("closed", "expired", "awarded", "cancelled"))
        | _yes(~r["at_home"]) | _yes(due < as_of) | _yes(r["deadline_at"] <= now) | old
    )


def current(r: Column, as_of: Column, now: Column) -> Column:
    """Whether a notice can be answered today: relevant, not obsolete, open, and dated or proven."""
    dated = _yes(r["deadline"] >= as_of) | _yes(r["current_evidence"]) | _yes(F.datediff(as_of, r["published"]).between(0, FRESH_DAYS["procurement"]))
    return (r["business"] != "reject") & ~obsolete(r, as_of, now) & _yes(r["status"] == "open") & dated


def in_range(day: Column, since: Column, until: Column, archive: Column) -> Column:
    """Whether a dated row lies in a wished range; undated rows pass only where no range is wished or all of the archive is."""
    bounded = since.isNotNull() | until.isNotNull()
    inside = F.coalesce(day >= since, F.lit(True)) & F.coalesce(day <= until, F.lit(True))
    return F.when(day.isNull(), ~bounded | archive).otherwise(inside)
